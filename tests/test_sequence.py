"""Chunked windows equal plain windows; the global index equals row_number."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_MID
from panelcast.operators import features as ft
from panelcast.operators import sequence as seq
from panelcast.operators import targets as tg
from panelcast.plans import jobs
from panelcast.sources import proxy
from panelcast.spec import PROXY_SPEC


def _rows(df, key, cols):
    return {r[key]: tuple(r[c] for c in cols) for r in df.select(key, *cols).collect()}


def test_global_index_is_row_number(spark):
    p = proxy.load_panel(spark, SF_MID)
    order = seq.order_columns(PROXY_SPEC)
    g = seq.with_global_index(p, PROXY_SPEC.with_(chunk_rows=300), "g")
    ref = p.withColumn("r", F.row_number().over(Window.orderBy(*order)) - 1)
    a = _rows(g, "event_id", ["g"])
    b = _rows(ref, "event_id", ["r"])
    assert a == b


def test_chunked_equals_plain_with_small_chunks(spark):
    spec = PROXY_SPEC.with_(chunk_rows=64)
    p = proxy.load_panel(spark, SF_MID)
    a = jobs.labelled_features(p, spec, method="chunked", context=False)
    b = jobs.labelled_features(p, spec, method="plain", context=False)
    cols = [c for c in a.columns if c not in ("event_id",)]
    ra = _rows(a, "event_id", cols)
    rb = _rows(b, "event_id", cols)
    assert ra.keys() == rb.keys()
    for k in ra:
        for x, y in zip(ra[k], rb[k]):
            if isinstance(x, float) and isinstance(y, float):
                assert abs(x - y) < 1e-9
            else:
                assert x == y


def test_frame_sum_equals_sum_of_leads(spark):
    spec = PROXY_SPEC.with_(chunk_rows=100)
    p = proxy.load_panel(spark, SF_MID)
    t = tg.with_targets(tg.with_leads(p, spec), spec)
    for h in spec.horizons:
        total = None
        for k in range(1, h.steps + 1):
            c = F.col(f"Rain_mm_Tot_lead_{k}")
            total = c if total is None else total + c
        bad = t.filter(~F.col(f"obs_precip_{h.name}").eqNullSafe(total)).count()
        assert bad == 0, h.name


def test_halo_too_small_is_refused(spark):
    p = proxy.load_panel(spark, SF_MID)
    with pytest.raises(ValueError):
        ft.with_history(p, PROXY_SPEC.with_(chunk_rows=8))


def _burst(spark, tie=True):
    """A station with a burst of equal TIMESTAMPs, one of TIMESTAMPs within a second, a gap of
    months, rows without TIMESTAMP or station, and a repeated tie-break."""
    at = "timestamp_ntz'2024-03-10 01:00:00.5'"
    parts = [spark.range(0, 3000).selectExpr("'A' AS station", f"{at} AS TIMESTAMP", "id % 5 * 0.254 AS Rain_mm_Tot", "(id * 7919) % 3000 AS rid"),
             spark.range(0, 2000).selectExpr("'A'", f"{at} + make_dt_interval(0, 0, 0, id * 0.000317 + 1)", "id % 7 * 0.254", "id + 5000"),
             spark.range(0, 500).selectExpr("'A'", f"{at} + make_dt_interval(90, 0, id * 15)", "if(id % 50 = 0, null, id % 3 * 0.254)", "id + 8000"),
             spark.range(0, 700).selectExpr("'B'", f"{at} + make_dt_interval(0, 0, id * 15)", "id % 4 * 0.254", "id + 9000"),
             spark.range(0, 600).selectExpr("'B'", "CAST(NULL AS timestamp_ntz)", "id % 4 * 0.254", "id + 10000"),
             spark.range(0, 400).selectExpr("CAST(NULL AS string)", f"{at} + make_dt_interval(0, 0, id)", "1.0", "id + 11000")]
    df = parts[0]
    for p in parts[1:]:
        df = df.union(p)
    return df


@pytest.mark.parametrize("few", [seq.BROADCAST_ROWS, 0])
def test_bursts_and_gaps_are_split_and_equal_plain(spark, monkeypatch, few):
    monkeypatch.setattr(seq, "BROADCAST_ROWS", few)
    spec = PROXY_SPEC.with_(tie="rid", chunk_rows=100)
    df = _burst(spark).repartition(5).cache()
    rows, cells, held = seq.with_cells(df, spec, 100)
    assert (held is None) == (few == 0)
    assert cells.agg(F.max("n")).first()[0] <= 50 and cells.agg(F.sum("n")).first()[0] == df.count()
    assert rows.groupBy("station", *seq.CELL).count().join(cells, ["station", *seq.CELL]).filter("count <> n").count() == 0
    chunks = seq.chunk_table(cells, spec, 100, 12, 24)
    if held is not None:
        dealt = seq.chunk_table(cells, spec, 100, 12, 24, held)
        assert sorted(map(str, dealt.collect())) == sorted(map(str, chunks.collect()))
    per_chunk = chunks.join(cells, ["station", *seq.CELL]).groupBy("station", "_home").agg(F.sum("n").alias("n"))
    assert per_chunk.agg(F.max("n")).first()[0] <= 150
    a, b = (ft.with_history(tg.with_targets(df, spec, m), spec, m) for m in ("chunked", "plain"))
    cols = [c for c in a.columns if c != "rid"]
    ra, rb = _rows(a, "rid", cols), _rows(b, "rid", cols)
    assert ra.keys() == rb.keys() and len(ra) == 7200
    for k in ra:
        assert all(x == y or abs(x - y) < 1e-9 for x, y in zip(ra[k], rb[k]) if x is not None or y is not None), k
    g = seq.with_global_index(df, spec, "g")
    ref = df.withColumn("r", F.row_number().over(Window.orderBy(*seq.order_columns(spec))) - 1)
    assert _rows(g, "rid", ["g"]) == _rows(ref, "rid", ["r"])


def test_burst_without_a_tie_break_is_split(spark):
    spec = PROXY_SPEC.with_(tie=None, chunk_rows=100)
    df = _burst(spark).drop("rid").filter("station = 'A'")
    numbered = df.withColumn("_t", F.monotonically_increasing_id())
    _, cells, _ = seq.with_cells(numbered, spec.with_(tie="_t"), 100)
    assert cells.agg(F.max("n")).first()[0] <= 60
    a, b = (tg.with_targets(df, spec, m).groupBy("TIMESTAMP").agg(F.count("obs_precip_6h").alias("n"), F.sum("obs_precip_1h").alias("s")) for m in ("chunked", "plain"))
    assert {r.TIMESTAMP: (r.n, round(r.s or 0, 6)) for r in a.collect()} == {r.TIMESTAMP: (r.n, round(r.s or 0, 6)) for r in b.collect()}


def test_empty_panel_and_one_without_timestamps(spark):
    spec = PROXY_SPEC.with_(tie="rid", chunk_rows=100)
    df = _burst(spark)
    assert tg.with_targets(df.limit(0), spec).count() == 0 and seq.with_global_index(df.limit(0), spec).count() == 0
    lost = df.filter("TIMESTAMP IS NULL")
    assert tg.with_targets(lost, spec).filter("obs_precip_1h IS NOT NULL").count() == 596


def test_nothing_is_written_for_the_windows(spark, monkeypatch):
    from panelcast.plans import registry as R

    def refused(*a, **k):
        raise AssertionError("a copy was written")

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", refused)
    for key in ("class_distribution", "submission", "station_panel", "sorted_panel", "feature_matrix"):
        assert R.QUERIES[key](spark, SF_MID).count() > 0, key
