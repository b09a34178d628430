"""Golden figures of the proxy panel (FIXTURES.md §D): complete rows, class
counts per horizon and hold-out rows after dropping incomplete horizons."""

import pytest
from pyspark.sql import functions as F

from panelcast.plans import registry as R

GOLDEN = {
    "/root/testdata/sf0.001": (664, {"1h": (567, 59, 38), "3h": (432, 189, 43), "6h": (307, 303, 54)}, 58),
    "/root/testdata/sf0.01": (7521, {"1h": (6216, 791, 514), "3h": (4161, 2598, 762), "6h": (2393, 3916, 1212)}, 1679),
}


@pytest.mark.parametrize("sf_dir", sorted(GOLDEN))
def test_fixture_figures(spark, sf_dir):
    rows, classes, holdout = GOLDEN[sf_dir]
    lab = R.labelled(spark, sf_dir)
    assert lab.count() == rows
    assert lab.filter(F.col("is_last_year") == 1).count() == holdout
    dist = {(r["horizon"], r["obs_class"]): r["n"] for r in R.QUERIES["class_distribution"](spark, sf_dir).collect()}
    for h, counts in classes.items():
        assert tuple(dist.get((h, c), 0) for c in (0, 1, 2)) == counts
