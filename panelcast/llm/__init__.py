"""Training-data operators: the numbered operators, their queries and SQL.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it. Its
functions are shipped to Python workers by value, so workers need no copy of
the package on their path.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
