"""Property: chunked windows equal the plain per-station window on random
panels (random chunk sizes, missing readings, duplicate timestamps, a null
station), for every windowed column of the labelling + feature step."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import PANEL_SCHEMA
from panelcast.plans import jobs
from panelcast.spec import PanelSpec

T0 = dt.datetime(2024, 1, 1)


@st.composite
def panels(draw):
    rows = []
    rid = 0
    for station in draw(st.lists(st.sampled_from(["A", "B", "C", None]), min_size=1, max_size=4, unique=True)):
        n = draw(st.integers(min_value=0, max_value=120))
        step = 0
        for _ in range(n):
            step += draw(st.sampled_from([0, 1, 1, 1, 2]))        # 0 = duplicate timestamp
            rain = draw(st.sampled_from([None, 0.0, 0.0, 0.254, 0.508, 1.27]))
            rows.append((station, T0 + dt.timedelta(minutes=15 * step), rain, rid))
            rid += 1
    return rows, draw(st.integers(min_value=25, max_value=90))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(panels())
def test_chunked_equals_plain(spark, case):
    rows, chunk = case
    df = spark.createDataFrame(rows, PANEL_SCHEMA)
    spec = PanelSpec(tie="rid", holdout="1 DAY", chunk_rows=chunk)
    a = jobs.labelled_features(df, spec, method="chunked", context=False)
    b = jobs.labelled_features(df, spec, method="plain", context=False)
    cols = sorted(a.columns)
    ra = {r["rid"]: tuple(r[c] for c in cols) for r in a.collect()}
    rb = {r["rid"]: tuple(r[c] for c in cols) for r in b.collect()}
    assert ra.keys() == rb.keys()
    for k in ra:
        for x, y in zip(ra[k], rb[k]):
            assert (x == y) or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 1e-9)
