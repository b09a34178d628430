"""Hand fixtures for the dashboard products' rules."""

import datetime as dt

from pyspark.sql import functions as F

from helpers import PANEL_SCHEMA
from panelcast.functions import scalar as S
from panelcast.operators import products as PR
from panelcast.spec import PanelSpec

SPEC = PanelSpec(tie="rid")
T0 = dt.datetime(2024, 5, 1, 12, 0)


def _panel(spark, rows):
    return spark.createDataFrame([(s, T0 + dt.timedelta(minutes=m), r, i) for i, (s, m, r) in enumerate(rows)],
                                 PANEL_SCHEMA)


def test_trend_status_and_recent(spark):
    rows = ([("UP", m, v) for m, v in [(0, 0.0), (15, 0.0), (30, 0.254), (45, 0.508)]]
            + [("DOWN", m, v) for m, v in [(0, 0.762), (15, 0.254), (30, 0.0), (45, 0.0)]]
            + [("FLAT", m, 0.0) for m in (0, 15, 30, 45, 60)]
            + [("LATE", m, v) for m, v in [(-120, 0.0), (-105, None)]])
    rec = {r["station"]: r for r in PR.recent_readings(_panel(spark, rows), SPEC).collect()}
    assert rec["UP"]["trend"] == "up" and rec["DOWN"]["trend"] == "down" and rec["FLAT"]["trend"] == "stable"
    assert rec["UP"]["recent_mm_x1000"] == "0,0,254,508"          # oldest → newest
    assert rec["LATE"]["recent_mm_x1000"] == "0,NA" and rec["LATE"]["trend"] == "stable"
    now = spark.createDataFrame([(s, "1h", 0.5, 1) for s in rec], "station string, horizon string, p_rain double, pred_class int")
    sp = {r["station_id"]: r for r in PR.station_panel(_panel(spark, rows), now, SPEC).collect()}
    assert sp["LATE"]["status"] == "warning" and sp["FLAT"]["status"] == "active"
    assert sp["UP"]["n_active"] == 3 and sp["UP"]["n_stations"] == 4


def test_alert_levels_and_bands(spark):
    df = spark.createDataFrame([(2, 0.75), (2, 0.69), (1, 0.9), (0, 0.39), (2, 0.4)], "c int, p double")
    got = [(r["lvl"], r["band"]) for r in df.select(S.alert_level("c", "p").alias("lvl"),
                                                     S.probability_band("p").alias("band")).collect()]
    assert got == [("alto", "high"), ("medio", "medium"), ("medio", "high"), ("bajo", "low"), ("medio", "medium")]


def test_histogram_edges_and_zero_fill(spark):
    df = spark.createDataFrame([("1h", 0.7), ("1h", 1.0), ("1h", 0.0), ("1h", 0.69999)], "horizon string, p double")
    h = {r["bin"]: r for r in PR.prob_histogram(df, "p", ["horizon"]).collect()}
    assert len(h) == 10 and h[7]["count"] == 1 and h[6]["count"] == 1 and h[9]["count"] == 1 and h[0]["count"] == 1
    assert h[3]["count"] == 0 and h[7]["label"] == "0.7–0.8"


def test_now_is_one_moment(spark):
    """The card reads each station's newest reading; a station silent for hours
    stays in the panel as a warning and leaves the card."""
    from panelcast.plans import jobs

    spec = SPEC
    rows = [("A", m, 0.0) for m in range(0, 600, 15)] + [("B", m, 0.0) for m in range(0, 555, 15)] + [("B", 570, 2.54)]
    rows += [("SILENT", m, 5.08) for m in range(-3000, -2400, 15)]
    p = _panel(spark, rows)
    cells = spark.createDataFrame([("1h", 0, 0, 0, 3), ("1h", 0, 1, 0, 1), ("1h", 0, 2, 2, 4)],
                                  "horizon string, is_last_year int, obs_class int, persist_class int, _n_rows bigint")
    now = jobs.newest_scored(p, spec, cells)
    one = {r["station"]: r for r in now.filter("horizon = '1h'").collect()}
    assert one["A"]["active"] and one["B"]["active"] and not one["SILENT"]["active"]
    assert (one["A"]["pred_class"], one["A"]["p_rain"]) == (0, 0.25)
    assert (one["B"]["pred_class"], one["B"]["p_rain"]) == (2, 1.0)
    active = now.filter("active")
    card = {r["horizon"]: r for r in PR.horizon_card(active, PR.station_bootstrap(active, spec, 50), spec).collect()}
    assert card["1h"]["n_stations"] == 2 and card["1h"]["probability"] == 0.625
    assert card["1h"]["timestamp"] == (T0 + dt.timedelta(minutes=585)).strftime("%Y-%m-%d %H:%M:%S")
    status = {r["station_id"]: r["status"] for r in PR.station_panel(p, now, spec).filter("horizon = '1h'").collect()}
    assert status == {"A": "active", "B": "active", "SILENT": "warning"}
