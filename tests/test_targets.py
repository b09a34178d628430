"""Hand fixtures for the labelling step (FIXTURES.md §E)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import SPEC, by_rid, panel, ts
from panelcast.functions.scalar import classify_precip
from panelcast.operators import targets as tg
from panelcast.spec import STATION_SPEC, PanelSpec


def test_gap_in_window_is_null_strict(spark):
    rows = [("A", i, 0.254 if i % 5 == 0 else 0.0) for i in range(30)]
    rows[10] = ("A", 10, None)
    out = by_rid(tg.with_targets(panel(spark, rows), SPEC.with_(chunk_rows=32)), "obs_precip_1h", "obs_precip_6h")
    # rows 6..9 see the gap within their next 4 rows
    for r in range(6, 10):
        assert out[r][0] is None
    assert out[5][0] == 0.0              # rows 6..9 hold no tip
    assert out[1][0] == 0.254            # rows 2..5 hold the tip at row 5
    assert out[10][0] == 0.0             # the gap row itself looks forward only
    for r in range(26, 30):
        assert out[r][0] is None        # series ends
    assert all(out[r][1] is None for r in range(0, 10))


def test_short_series_has_no_complete_6h_row(spark):
    rows = [("A", i, 0.0) for i in range(20)]
    lab = tg.label_panel(panel(spark, rows), SPEC)
    assert lab.count() == 0


def test_boundary_totals(spark):
    # one reading then 4 zeros: obs_precip_1h of row 0 = sum of rows 1..4
    cases = [0.0, 0.254, 0.508, 0.762, 0.763]
    rows = []
    for s, v in enumerate(cases):
        rows += [(f"S{s}", 0, 0.0), (f"S{s}", 1, v), (f"S{s}", 2, 0.0), (f"S{s}", 3, 0.0), (f"S{s}", 4, 0.0)]
    df = tg.with_targets(panel(spark, rows), SPEC)
    got = {r["station"]: r["obs_class_1h"] for r in df.filter(F.col("TIMESTAMP") == ts(0)).collect()}
    assert got == {"S0": 0, "S1": 1, "S2": 2, "S3": 2, "S4": 2}
    df3 = df.select(classify_precip(F.lit(0.508), 0.508).alias("c3"), classify_precip(F.lit(0.762), 0.762).alias("c6"),
                    classify_precip(F.lit(0.254 + 0.254 + 0.254), 0.762).alias("c6b")).first()
    assert (df3["c3"], df3["c6"], df3["c6b"]) == (1, 1, 1)


def test_negative_total_is_light(spark):
    rows = [("A", 0, 0.0), ("A", 1, -0.1), ("A", 2, 0.0), ("A", 3, 0.0), ("A", 4, 0.0)]
    df = tg.with_targets(panel(spark, rows), SPEC)
    assert by_rid(df, "obs_class_1h")[0] == (1,)


def test_null_station_gets_null_targets(spark):
    rows = [(None, i, 0.254) for i in range(6)] + [("A", i, 0.254) for i in range(6)]
    df = tg.with_targets(panel(spark, rows), SPEC)
    out = by_rid(df, "obs_precip_1h")
    assert all(out[r][0] is None for r in range(6))
    assert out[6][0] is not None


def test_null_timestamp_sorts_last_and_flag_zero(spark):
    rows = [("A", i, 0.0) for i in range(5)] + [("A", None, 0.254)]
    df = tg.with_holdout_flag(panel(spark, rows), SPEC)
    flags = by_rid(df, "is_last_year")
    assert flags[5] == (0,)
    t = by_rid(tg.with_targets(panel(spark, rows), SPEC), "obs_precip_1h")
    assert abs(t[1][0] - 0.254) < 1e-12  # rows 2,3,4 then the NaT row


def test_leap_day_calendar_year(spark):
    spec = PanelSpec(tie="rid", holdout="1 YEAR")
    rows = [("A", dt.datetime(2024, 2, 29, 12, 0), 0.0), ("A", dt.datetime(2023, 2, 28, 12, 0), 0.0),
            ("A", dt.datetime(2023, 2, 28, 11, 45), 0.0)]
    flags = by_rid(tg.with_holdout_flag(panel(spark, rows), spec), "is_last_year")
    assert flags == {0: (1,), 1: (1,), 2: (0,)}


@pytest.mark.parametrize("end, per_station", [
    (dt.datetime(2026, 3, 5, 23, 0), 35_017),   # hold-out year without 29 Feb
    (dt.datetime(2024, 3, 6, 23, 0), 35_113),   # hold-out year spanning 29 Feb 2024
])
def test_full_grid_row_arithmetic(spark, end, per_station):
    """4 stations, 15-minute grid over two years: the calendar-year hold-out
    keeps 365 (or 366) days of steps + 1, minus the 24 incomplete last rows."""
    start = end.replace(year=end.year - 2)
    n = int((end - start).total_seconds() // 900) + 1
    stations = F.array(*[F.lit(s) for s in ["CER", "JUN", "MERC", "MIRA"]])
    grid = (spark.range(0, n).select(
        F.expr(f"timestamp_ntz'{start}' + make_dt_interval(0, 0, id * 15)").alias("TIMESTAMP"),
        F.explode(stations).alias("station"))
        .withColumn("Rain_mm_Tot", F.lit(0.0)))
    lab = tg.label_panel(grid, STATION_SPEC)
    counts = {r["is_last_year"]: r["count"] for r in lab.groupBy("is_last_year").count().collect()}
    assert counts[1] == per_station * 4


def test_duplicate_key_uses_tie_break(spark):
    rows = [("A", 0, 0.0), ("A", 0, 0.254), ("A", 1, 0.0), ("A", 2, 0.0), ("A", 3, 0.0), ("A", 4, 0.0)]
    out = by_rid(tg.with_targets(panel(spark, rows), SPEC), "obs_precip_1h")
    assert abs(out[0][0] - 0.254) < 1e-12     # rid 0 comes first, so rid 1 is its next row
    assert out[1][0] == 0.0


def test_duplicates_without_tie_keep_file_order(spark):
    """No tie column (the station master): rows with equal (station,
    TIMESTAMP) keep file order, and a burst of equal keys is still split
    across chunks with results equal to the plain window."""
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("station", T.StringType()), T.StructField("TIMESTAMP", T.TimestampNTZType()),
                           T.StructField("Rain_mm_Tot", T.DoubleType())])
    rows = [("A", ts(0), 0.0), ("A", ts(0), 0.254)] + [("A", ts(i), 0.0) for i in range(1, 6)]
    spec = STATION_SPEC.with_(holdout="1 HOUR")
    for method in ("chunked", "plain"):
        got = [r["obs_precip_1h"] for r in tg.with_targets(spark.createDataFrame(rows, schema), spec, method)
               .orderBy("TIMESTAMP", F.col("Rain_mm_Tot")).collect()]
        assert abs(got[0] - 0.254) < 1e-12 and got[1] == 0.0, method   # 0.0 row first, its next row is the tip
    burst = [("B", ts(0), 0.254 * (i % 3)) for i in range(3000)] + [("B", ts(i), 0.0) for i in range(1, 30)]
    df = spark.createDataFrame(burst, schema)
    spec = STATION_SPEC.with_(holdout="1 HOUR", chunk_rows=500)
    def rows_of(method):
        out = tg.with_targets(df, spec, method).collect()
        return sorted((r["TIMESTAMP"], r["Rain_mm_Tot"], -1.0 if r["obs_precip_6h"] is None
                       else round(r["obs_precip_6h"], 9)) for r in out)
    a, b = rows_of("chunked"), rows_of("plain")
    assert len(a) == 3029 and a == b
