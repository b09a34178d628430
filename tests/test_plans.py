"""Plan shape: the scale properties the design relies on."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from conftest import SF_MID
from panelcast.operators import products as PR
from panelcast.operators import sequence as seq
from panelcast.operators import targets as tg
from panelcast.plans import registry as R
from panelcast.sources import proxy
from panelcast.spec import PROXY_SPEC


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_labelling_windows_partition_by_station_and_chunk(spark):
    p = plan(R.labelled(spark, SF_MID))
    # rows are shuffled by (station, chunk) only; the cell table by station and cell
    exch = [ln for ln in p.splitlines() if "hashpartitioning(station" in ln]
    assert sum("_chunk" in ln for ln in exch) == 1
    # every data window is partitioned by (station, chunk), never by station alone
    wins = [ln for ln in p.splitlines() if "windowspecdefinition(station#" in ln and "Rain_mm_Tot" in ln]
    assert wins and all("_chunk" in ln for ln in wins)
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_top_k_is_limited_before_shuffle(spark):
    p = plan(PR.recent_readings(proxy.load_panel(spark, SF_MID), PROXY_SPEC))
    head = p.split("\n\n")[0]
    assert head.count("WindowGroupLimit") == 2      # partial (map side) + final


def test_scan_prunes_columns(spark):
    p = plan(proxy.load_panel(spark, SF_MID).select("station", "TIMESTAMP"))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in p


def test_holdout_flag_needs_no_join(spark):
    """The max arrives as a scalar subquery: the row plan is scan + project,
    and the subquery's only exchange carries partial maxima."""
    p = plan(tg.with_holdout_flag(proxy.load_panel(spark, SF_MID), PROXY_SPEC))
    main, _, sub = p.partition("Subquery:1")
    tree = main.split("\n\n")[0]
    assert "Join" not in tree and "Exchange" not in tree
    assert "partial_max" in sub and "ReadSchema: struct<ts:timestamp_ntz>" in sub


def test_skewed_station_is_spread_over_chunks(spark):
    """One station holds ~90 % of the rows: chunked windows still equal the
    plain form, and the hot station is split into many window partitions."""
    hot = spark.range(0, 9000).select(F.lit("HOT").alias("station"),
                                      F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 15)").alias("TIMESTAMP"),
                                      (F.col("id") % 7 * 0.254).alias("Rain_mm_Tot"), F.col("id").alias("event_id"))
    cold = spark.range(0, 1000).select(F.lit("COLD").alias("station"),
                                       F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 15)").alias("TIMESTAMP"),
                                       (F.col("id") % 3 * 0.254).alias("Rain_mm_Tot"), (F.col("id") + 100000).alias("event_id"))
    df = hot.unionByName(cold)
    spec = PROXY_SPEC.with_(chunk_rows=500)
    a = tg.with_targets(df, spec, method="chunked")
    b = tg.with_targets(df, spec, method="plain")
    ra = {r["event_id"]: r["obs_precip_6h"] for r in a.collect()}
    rb = {r["event_id"]: r["obs_precip_6h"] for r in b.collect()}
    assert ra.keys() == rb.keys()
    assert all((ra[k] is None and rb[k] is None) or abs(ra[k] - rb[k]) < 1e-9 for k in ra)
    _, cells, _ = seq.with_cells(df, spec, 500)
    table = seq.chunk_table(cells, spec, 500, 0, 24)
    assert table.filter(F.col("station") == "HOT").select("_home").distinct().count() >= 18
