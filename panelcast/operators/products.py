"""Dashboard data products (A6-A8, W8-W10, C2-C7, O6, B5) as tables.

The reference's dashboard reads hand-exported constants; here every figure
is derived from the scored predictions and the panel:

* ``now`` rows (O6): each station's newest reading, scored per horizon; stations
  whose newest reading is old are inactive and leave the card.
* station panel (W8-W10, F4): last 4 readings, latest reading, trend, status
  (active when its newest reading is within ``active_within`` of the
  network's newest), P(rain) now; network active / total counts.
* horizon card (A7, C2, B5): mean station probabilities now, network class,
  a 90 % interval from a hash bootstrap over the stations' P(rain) now.
* network series (A6, C6, C7): mean and 10 / 90 % quantiles across stations
  of the last HISTORY_STEPS grid steps, then the FORECAST steps carrying the
  card interval, the second scaled by its factor.
* probability histogram (A8, C5): zero-filled 10-bin histogram of P(pred).
* alerts (C3, C4): level, band and message per horizon.
* dashboard bundle: all of the above nested per horizon, with its JSON.

Per-station top-k uses ``row_number() <= k`` so Spark inserts a partial
group limit before the shuffle (``WindowGroupLimit``): at most k rows per
station and partition move, however many rows a station holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..spec import PanelSpec
from . import features as ft
from .baselines import trailing_columns
from .bootstrap import hash_index
from .targets import scalar_like

# Fixed dashboard values: 4 recent readings, 13 history steps of 15 minutes
# ("-180min" … "Ahora"), forecast steps "+30min" and "+60min", second forecast
# band = 0.8 × first, interval level 0.90, 10 histogram bins over [0, 1].
RECENT = 4
HISTORY_STEPS = 13
STEP_MINUTES = 15
FORECAST = (("+30min", 1.0), ("+60min", 0.8))
CI_LEVEL = 0.90
BINS = 10
NOW_LABEL = "Ahora"
ACTIVE_WITHIN = "1 hour"


def newest_readings(panel: DataFrame, spec: PanelSpec, active_within: str = ACTIVE_WITHIN) -> DataFrame:
    """Each station's newest reading with its trailing totals, as input of
    the persistence model (its truth isn't known yet, hence NULL), and whether
    it is ``active``: within ``active_within`` of the network's newest reading.

    A trailing total needs the last ``max_backward`` + 1 readings of a station;
    only those pass the partial group limit, so the windows see bounded groups."""
    k = spec.max_backward + 1
    order = [F.col(spec.ts).desc()] + ([F.col(spec.tie).desc()] if spec.tie else [])
    last = (panel.filter(F.col(spec.ts).isNotNull() & F.col(spec.station).isNotNull())
            .withColumn("_rn", F.row_number().over(Window.partitionBy(spec.station).orderBy(*order)))
            .filter(F.col("_rn") <= k))
    w = Window.partitionBy(spec.station).orderBy(F.desc("_rn"))
    sums = trailing_columns(spec)(w)
    newest = last.select("*", *[e.alias(name) for name, e in sums.items()]).filter(F.col("_rn") == 1).drop("_rn")
    latest = F.max(spec.ts).over(Window.partitionBy())          # one row per station
    newest = newest.withColumn("active", F.col(spec.ts) >= latest - F.expr(f"INTERVAL {active_within}"))
    for h in spec.horizons:
        newest = (newest.withColumn(f"obs_precip_{h.name}", F.lit(None).cast("double"))
                  .withColumn(f"obs_class_{h.name}", F.lit(None).cast("int")))
    return newest


def recent_readings(panel: DataFrame, spec: PanelSpec, k: int = RECENT) -> DataFrame:
    """W8 + W9 + W10: last k readings per station (oldest → newest, as text
    of whole thousandths of a mm, missing = NA), latest reading and time,
    trend of newest vs oldest."""
    order = [F.col(spec.ts).desc()] + ([F.col(spec.tie).desc()] if spec.tie else [])
    w = Window.partitionBy(spec.station).orderBy(*order)
    top = (panel.filter(F.col(spec.ts).isNotNull() & F.col(spec.station).isNotNull())
           .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k))
    r = F.col(spec.rain)
    agg = top.groupBy(spec.station).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_rn"), r.alias("v"))), asc=False).alias("_recent"),
        F.max(F.when(F.col("_rn") == 1, r)).alias("last_reading"),
        F.max(F.when(F.col("_rn") == 1, F.col(spec.ts))).alias("last_ts"),
        F.max_by(r, F.col("_rn")).alias("_oldest"),
    )
    txt = F.transform("_recent", lambda x: F.coalesce(
        F.round(x["v"] * 1000).cast("bigint").cast("string"), F.lit("NA")))
    trend = (F.when(F.col("last_reading") > F.col("_oldest"), F.lit("up"))
             .when(F.col("last_reading") < F.col("_oldest"), F.lit("down")).otherwise(F.lit("stable")))
    return agg.select(spec.station, F.array_join(txt, ",").alias("recent_mm_x1000"), "last_reading", "last_ts",
                      trend.alias("trend"))


def station_panel(panel: DataFrame, now: DataFrame, spec: PanelSpec, active_within: str = ACTIVE_WITHIN) -> DataFrame:
    """F4 + W8-W10 per (horizon, station) with network active / total counts."""
    rec = recent_readings(panel, spec)
    net = F.max("last_ts").over(Window.partitionBy())
    rec = rec.withColumn("status", F.when(F.col("last_ts") >= net - F.expr(f"INTERVAL {active_within}"),
                                          F.lit("active")).otherwise(F.lit("warning")))
    out = now.select("horizon", spec.station, F.col("p_rain").alias("probability"), "pred_class").join(
        rec, spec.station)
    wh = Window.partitionBy("horizon")
    return out.select(
        "horizon", F.col(spec.station).alias("station_id"), "status", "trend", "last_reading", "probability",
        "pred_class", "recent_mm_x1000",
        F.sum(F.when(F.col("status") == "active", 1).otherwise(0)).over(wh).alias("n_active"),
        F.count(F.lit(1)).over(wh).alias("n_stations"),
    )


def station_bootstrap(now: DataFrame, spec: PanelSpec, B: int = 1000, value: str = "p_rain") -> DataFrame:
    """Replicate means of the stations' current probability, drawn with
    the shared hash index. Cost B × stations (rows: one per station now)."""
    w = Window.partitionBy("horizon").orderBy(spec.station)
    idx = now.select("horizon", spec.station, F.col(value).alias("v"),
                     (F.row_number().over(w) - 1).alias("idx"),
                     F.count(F.lit(1)).over(Window.partitionBy("horizon")).alias("n"))
    names = [h.name for h in spec.horizons]
    H = len(names)
    # one row per (replicate, horizon) from a single range; then the n draws
    # of a replicate by exploding 0..n-1 (n = stations now, tiny)
    reps = now.sparkSession.range(0, B * H).select(
        F.expr(f"id div {H}").alias("b"),
        F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("id") % H).cast("int") + 1).alias("horizon"))
    sizes = idx.select("horizon", "n").distinct()
    draws = (reps.join(F.broadcast(sizes), "horizon")
             .withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
             .withColumn("idx", hash_index(F.col("b"), F.col("j"), F.col("n"))))
    means = (draws.join(idx.select("horizon", "idx", "v"), ["horizon", "idx"])
             .groupBy("horizon", "b").agg(F.avg("v").alias("rep_mean")))
    return means


def horizon_card(now: DataFrame, reps: DataFrame, spec: PanelSpec, model_name: str = "persistence") -> DataFrame:
    """A7 + C2 + B5: the prediction card per horizon from the active stations."""
    lo_q, hi_q = (1 - CI_LEVEL) / 2, 1 - (1 - CI_LEVEL) / 2
    ci = reps.groupBy("horizon").agg(
        F.percentile("rep_mean", F.array(F.lit(lo_q), F.lit(hi_q))).alias("_ci"))
    minutes = F.create_map(*[x for h in spec.horizons for x in (F.lit(h.name), F.lit(h.minutes))])
    card = now.groupBy("horizon").agg(
        F.max(spec.ts).alias("now_ts"),
        F.avg("p_rain").alias("probability"),
        F.avg("pred_prob").alias("pred_prob_mean"),
        F.max("pred_class").alias("pred_class"),
        F.count(F.lit(1)).alias("n_stations"),
    )
    return card.join(ci, "horizon", "left").select(
        "horizon", F.date_format("now_ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "pred_class", S.will_rain("pred_class").alias("will_rain"), "probability", "pred_prob_mean",
        S.intensity_label("pred_class").alias("intensity"),
        F.col("_ci")[0].alias("ci_lower"), F.col("_ci")[1].alias("ci_upper"),
        F.lit(CI_LEVEL).alias("ci_level"), minutes[F.col("horizon")].alias("horizon_minutes"),
        "n_stations", F.concat(F.lit(f"{model_name} "), F.col("horizon")).alias("model_version"),
    )


def network_series(panel: DataFrame, card: DataFrame, spec: PanelSpec) -> DataFrame:
    """A6 + C6 + C7: last HISTORY_STEPS grid steps (avg, q10, q90 across
    stations) and the forecast steps per horizon."""
    live = panel.filter(F.col(spec.station).isNotNull() & F.col(spec.ts).isNotNull())
    # The newest step is one scalar (a partial/final max over one column). As
    # a literal, the window start becomes a filter that reaches the scan, so
    # only the last HISTORY_STEPS steps are aggregated.
    newest = live.select(ft.bucket_col(spec).alias("b")).agg(F.max("b")).first()[0]
    last = scalar_like(newest, live.select(ft.bucket_col(spec).alias("b")).schema["b"].dataType)
    start = last - F.expr(f"INTERVAL {(HISTORY_STEPS - 1) * STEP_MINUTES} MINUTES")
    recent = ft.station_grid(live.filter(F.col(spec.ts) >= start), spec).withColumn("_last", last)
    q = F.percentile(F.col(spec.rain), F.array(F.lit(0.1), F.lit(0.9)))
    hist = recent.groupBy("bucket_ts", "_last").agg(F.avg(spec.rain).alias("avg"), q.alias("_q"))
    mins = F.expr("timestampdiff(MINUTE, _last, bucket_ts)").cast("int")
    label = F.when(mins == 0, F.lit(NOW_LABEL)).otherwise(F.format_string("%dmin", mins))
    past = hist.select(F.lit(None).cast("string").alias("horizon"), label.alias("time"), mins.alias("offset_min"),
                       "avg", F.col("_q")[0].alias("q10"), F.col("_q")[1].alias("q90"),
                       F.lit(False).alias("forecast"))
    fut = None
    for i, (lab, factor) in enumerate(FORECAST):
        f = card.select("horizon", F.lit(lab).alias("time"), F.lit(30 * (i + 1)).alias("offset_min"),
                        F.lit(0.0).alias("avg"), (F.col("ci_lower") * F.lit(factor)).alias("q10"),
                        (F.col("ci_upper") * F.lit(factor)).alias("q90"), F.lit(True).alias("forecast"))
        fut = f if fut is None else fut.unionByName(f)
    return past.unionByName(fut)


def prob_histogram(values: DataFrame, col: str, group: list[str], card: DataFrame | None = None) -> DataFrame:
    """A8 + C5: zero-filled 10-bin histogram of a [0, 1] column per group;
    bin = least(floor(p · 10), 9) (multiply, never divide by 0.1)."""
    b = F.least(F.floor(F.col(col) * BINS), F.lit(BINS - 1)).cast("int")
    counts = values.filter(F.col(col).isNotNull()).groupBy(*group, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    groups = counts.select(*group).distinct()
    full = (groups.select(*group, F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
            .join(counts, [*group, "bin"], "left"))
    lo = F.col("bin") / F.lit(float(BINS))
    hi = (F.col("bin") + 1) / F.lit(float(BINS))
    out = full.select(*group, "bin", F.format_string("%.1f–%.1f", lo, hi).alias("label"), lo.alias("lo"),
                      hi.alias("hi"), F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))
    if card is not None:
        out = (out.join(card.select("horizon", "ci_lower", "ci_upper"), "horizon", "left")
               .withColumn("in_ci", (F.col("hi") >= F.col("ci_lower")) & (F.col("lo") <= F.col("ci_upper")))
               .drop("ci_lower", "ci_upper"))
    return out


def alerts(card: DataFrame) -> DataFrame:
    """C3 + C4: level, probability band and message per horizon."""
    level = S.alert_level("pred_class", "probability")
    return card.select(
        "horizon", level.alias("level"), S.probability_band("probability").alias("band"),
        S.alert_message(level, F.col("horizon_minutes")).alias("message"))


# Fixed sentences of the dashboard's alerts.
ALL_STABLE = "Condiciones estables en todas las estaciones."
ROUTINE = "Continuar monitoreo de rutina."


def dashboard_bundle(card: DataFrame, stations: DataFrame, series: DataFrame, histogram: DataFrame,
                     alert_rows: DataFrame, metrics_card: DataFrame, horizons: list[str],
                     names: dict[str, str] | None = None) -> DataFrame:
    """The dashboard's nested per-horizon document as one row per horizon:
    ``prediction`` struct (``intensityMmH``: the active stations' mean reading as a rate per hour), ``stations`` / ``time_series`` / ``bootstrap``
    arrays of structs, ``alerts`` and ``metrics`` structs, plus its JSON text.
    Every collected list is bounded (stations, HISTORY_STEPS + forecast
    steps, BINS), so no group grows with the data."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None
    name = F.coalesce(F.try_element_at(known, F.col("station_id")), F.col("station_id")) if names else F.col("station_id")
    rate = F.avg(F.when(F.col("status") == "active", F.col("last_reading"))) * (60 / STEP_MINUTES)
    st = stations.groupBy("horizon").agg(rate.alias("_rate"), F.sort_array(F.collect_list(F.struct(
        F.col("station_id").alias("id"), name.alias("name"), "status", "trend", F.col("last_reading").alias("lastReading"),
        "probability", F.col("recent_mm_x1000").alias("recentReadings")))).alias("stations"),
        F.first("n_active").alias("_n_active"), F.first("n_stations").alias("_n_stations"))
    # history steps are shared by all horizons: fan them out over the horizon list
    past = series.filter(F.col("horizon").isNull()).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    ts = past.unionByName(series.filter(F.col("horizon").isNotNull())).groupBy("horizon").agg(
        F.sort_array(F.collect_list(F.struct("offset_min", "time", "avg", "q10", "q90", "forecast"))).alias("_ts"))
    ts = ts.select("horizon", F.transform("_ts", lambda x: x.dropFields("offset_min")).alias("time_series"))
    hb = histogram.groupBy("horizon").agg(F.sort_array(F.collect_list(F.struct(
        "bin", F.col("label").alias("bin_label"), "count", "in_ci"))).alias("bootstrap"))
    out = (card.join(st, "horizon", "left").join(ts, "horizon", "left").join(hb, "horizon", "left")
           .join(alert_rows, "horizon", "left").join(metrics_card, "horizon", "left"))
    calm = F.col("level") == S.ALERT_LOW
    station_msg = F.when(calm & (F.col("_n_active") == F.col("_n_stations")), F.lit(ALL_STABLE)).otherwise(
        F.format_string("%d de %d estaciones activas.", F.col("_n_active"), F.col("_n_stations")))
    doc = out.select(
        "horizon",
        F.struct("timestamp", F.col("will_rain").alias("willRain"), "probability", "intensity", F.col("_rate").alias("intensityMmH"),
                 "ci_lower", "ci_upper", "ci_level", F.col("horizon_minutes").alias("horizon"), F.col("horizon").alias("horizonLabel"),
                 F.col("n_stations").alias("nStations"), F.col("model_version").alias("modelVersion")).alias("prediction"),
        "stations", "time_series", "bootstrap",
        F.struct(F.col("level").alias("current"),
                 F.array_compact(F.array(
                     F.struct(F.col("level"), F.col("message").alias("text")),
                     F.struct(F.col("level"), station_msg.alias("text")),
                     F.when(calm, F.struct(F.col("level"), F.lit(ROUTINE).alias("text"))))).alias("messages")).alias("alerts"),
        F.struct("accuracy", "f1_weighted", "f1_macro", "best_model", "test_rows").alias("metrics"),
    )
    return doc.withColumn("json", F.to_json(F.struct("prediction", "stations", "time_series", "bootstrap",
                                                       "alerts", "metrics")))


def bundle_fields(bundle: DataFrame) -> DataFrame:
    """(horizon, section, item, field, value): the document of :func:`dashboard_bundle` field by field, as
    text (numbers with 6 digits); fields without a value are left out."""
    def text(c, kind: str):
        return F.format_string("%.6f", F.round(c, 6) + F.lit(0.0)) if kind == "double" else c.cast("string")

    def rows(section: str, item, struct, schema):
        return [F.struct(F.lit(section).alias("section"), item.cast("string").alias("item"), F.lit(f.name).alias("field"),
                         F.when(struct[f.name].isNotNull(), text(struct[f.name], f.dataType.typeName())).alias("value"))
                for f in schema.fields if f.name not in ("id", "time", "bin", "bin_label", "level", "messages")]

    kinds = {f.name: f.dataType for f in bundle.schema.fields}
    all_ = [F.array(*rows(s, F.lit(""), F.col(s), kinds[s])) for s in ("prediction", "alerts", "metrics")]

    def each(section: str, key: str):
        return F.flatten(F.transform(F.col(section), lambda x: F.array(*rows(section, x[key], x, kinds[section].elementType))))

    all_ += [each("stations", "id"), each("time_series", "time"), each("bootstrap", "bin_label")]
    messages = kinds["alerts"]["messages"].dataType.elementType
    all_.append(F.flatten(F.transform(F.col("alerts.messages"), lambda x, i: F.array(*rows("alerts", i + 1, x, messages)))))
    out = bundle.select("horizon", F.explode(F.concat(*[F.coalesce(a, F.array().cast(
        "array<struct<section:string,item:string,field:string,value:string>>")) for a in all_])).alias("r"))
    return out.select("horizon", "r.*").filter("value IS NOT NULL")
