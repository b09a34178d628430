"""Leak test: no feature at t changes when rows after t change."""

from pyspark.sql import functions as F

from conftest import SF_MID
from panelcast.plans import jobs
from panelcast.sources import proxy
from panelcast.spec import PROXY_SPEC

FEATURE_PREFIXES = ("Rain_mm_Tot_lag_", "Rain_mm_Tot_roll", "trail_", "rain_allstations_", "rain_otherstations_")


def test_features_do_not_look_ahead(spark):
    spec = PROXY_SPEC.with_(chunk_rows=128)
    p = proxy.load_panel(spark, SF_MID)
    mid = p.select(F.max("TIMESTAMP")).first()[0]
    # perturb every present reading of the last 5 days (missing ones stay
    # missing, so the set of complete rows is unchanged)
    late = (F.col("TIMESTAMP") >= F.lit(mid).cast("timestamp_ntz") - F.expr("INTERVAL 5 DAYS")) \
        & F.col("Rain_mm_Tot").isNotNull()
    changed = p.withColumn("Rain_mm_Tot", F.when(late, F.lit(7.62)).otherwise(F.col("Rain_mm_Tot")))
    a = jobs.labelled_features(p, spec, method="chunked")
    b = jobs.labelled_features(changed, spec, method="chunked")
    cols = [c for c in a.columns if c.startswith(FEATURE_PREFIXES)]
    early = F.col("TIMESTAMP") < F.lit(mid).cast("timestamp_ntz") - F.expr("INTERVAL 5 DAYS") - F.expr("INTERVAL 1 HOUR")
    ra = {r["event_id"]: tuple(r[c] for c in cols) for r in a.filter(early).select("event_id", *cols).collect()}
    rb = {r["event_id"]: tuple(r[c] for c in cols) for r in b.filter(early).select("event_id", *cols).collect()}
    assert ra and ra == rb


def test_cross_station_other_mean(spark):
    from helpers import PANEL_SCHEMA, T0
    from panelcast.operators import features as ft
    from panelcast.spec import PanelSpec
    rows = [("A", T0, 1.0, 0), ("B", T0, 3.0, 1), ("C", T0, None, 2), ("D", T0, 5.0, 3)]
    df = spark.createDataFrame(rows, PANEL_SCHEMA)
    cs = {r["station"]: r for r in ft.cross_station(df, PanelSpec(tie="rid")).collect()}
    assert cs["A"]["rain_otherstations_mean_t"] == 4.0
    assert cs["C"]["rain_otherstations_mean_t"] == 3.0       # own missing → mean of the rest
    assert cs["A"]["rain_allstations_sum_t"] == 9.0
    assert abs(cs["A"]["rain_allstations_std_t"] - 2.0) < 1e-12
