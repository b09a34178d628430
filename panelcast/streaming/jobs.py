"""Structured Streaming jobs (T1-T3): the real-time early-warning use.

* T1 :func:`ingest_stream` — readings with a watermark; duplicates of
  (station, TIMESTAMP) inside the watermark are dropped.
* T2 :func:`accumulate_stream` — totals per station and 15-minute bucket, one
  state store; :func:`windows_from_buckets` turns them into the trailing 1 / 3 /
  6 h totals (sliding by 15 minutes). State is bounded by the watermark: a bucket
  leaves it once closed. Written per epoch in *update* mode, the newest epoch of
  a bucket holds; in *append* mode only buckets and windows closed by the
  watermark are emitted. A reading behind the watermark of the batch before is
  dropped from all three window lengths alike.
* T3 :func:`alert_stream` / :func:`model_alert_job` — ``foreachBatch``: each
  reading is scored together with a history table kept by time, so that alerts
  equal batch scoring of the same readings, duplicates and late ones included.

With a ``base`` folder (one that driver and executors share) T2 and T3 go on where
they ended: checkpoint, history and results live below it, a second run reads only the
files that came since, and a run that was broken off repeats its last micro-batch
without scoring a reading twice (:mod:`.tables`). Without one a run is complete in
itself and its working tables are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import drop_path, shared_path
from ..sources import proxy
from ..sources.proxy import EVENTS_SCHEMA
from ..spec import PanelSpec
from .tables import EpochTable

# Fixed trailing accumulation windows of the early-warning stream.
WINDOWS = (("1h", "1 hour"), ("3h", "3 hours"), ("6h", "6 hours"))
SLIDE = "15 minutes"


def events_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(EVENTS_SCHEMA)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    # a glob naming the one file: the streaming file source wants a directory
    # or a pattern, and later files matching it are picked up as new input
    return r.parquet(f"{sf_dir.rstrip('/')}/event[s].parquet")


def panel_stream(spark: SparkSession, sf_dir: str, spec: PanelSpec) -> DataFrame:
    """Proxy panel as a stream; event time as ``timestamp`` (watermarks need it)."""
    p = proxy.events_panel(events_stream(spark, sf_dir), spec)
    return p.withColumn("event_time", F.col(spec.ts).cast("timestamp"))


def ingest_stream(stream: DataFrame, spec: PanelSpec, delay: str = "1 hour") -> DataFrame:
    """Watermark + de-duplication of (station, TIMESTAMP)."""
    return (stream.withWatermark("event_time", delay)
            .dropDuplicatesWithinWatermark([spec.station, spec.ts]))


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session of its own for a streaming query, with ``spark``'s settings.

    Stateful streaming operators keep ``spark.sql.shuffle.partitions`` state
    partitions, fixed in the checkpoint at the first start and not coalesced by
    AQE. The count is therefore chosen here (default: the cluster's parallelism)
    without touching the caller's session."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.shuffle.partitions", str(state_partitions or spark.sparkContext.defaultParallelism))
    return own


def accumulate_stream(stream: DataFrame, spec: PanelSpec, delay: str = "1 hour") -> DataFrame:
    """T2, streaming part: rain total and readings per station and bucket."""
    return (stream.withWatermark("event_time", delay)
            .groupBy(F.window("event_time", SLIDE).alias("win"), F.col(spec.station))
            .agg(F.sum(spec.rain).alias("rain_sum"), F.count(spec.rain).alias("n_readings"))
            .select(spec.station, F.col("win.start").alias("bucket_start"), "rain_sum", "n_readings"))


def windows_from_buckets(buckets: DataFrame, spec: PanelSpec, closed_by: str | None = None) -> DataFrame:
    """1 / 3 / 6 h sliding totals from bucket totals. Each bucket lies in
    length / slide windows; the fan-out multiplies buckets (one row per station
    and step), not readings. ``closed_by``: keep windows that end by this time."""
    step = int(SLIDE.split()[0])

    def fan_out(name: str, length: str) -> Column:
        def window(k: Column) -> Column:
            start = F.col("bucket_start") - F.make_dt_interval(F.lit(0), F.lit(0), k * step)
            return F.struct(F.lit(name).alias("window_len"), start.alias("window_start"),
                            (start + F.expr(f"INTERVAL {length}")).alias("window_end"))
        return F.transform(F.sequence(F.lit(0), F.lit(int(length.split()[0]) * 60 // step - 1)), window)

    fan = [fan_out(name, length) for name, length in WINDOWS]
    wide = (buckets.select(spec.station, "rain_sum", "n_readings", F.explode(F.concat(*fan)).alias("w"))
            .select("w.*", spec.station, "rain_sum", "n_readings"))
    if closed_by is not None:
        wide = wide.filter(F.col("window_end") <= F.to_timestamp(F.lit(closed_by)))
    return (wide.groupBy("window_len", spec.station, "window_start", "window_end")
            .agg(F.sum("rain_sum").alias("rain_sum"), F.sum("n_readings").alias("n_readings")))


def run_accumulation(stream: DataFrame, spec: PanelSpec, name: str, mode: str = "update",
                     delay: str = "1 hour", base: str | None = None) -> DataFrame:
    """T2 to its end (``availableNow``): the window totals of all readings so far
    (``update``) or of the windows closed by the watermark (``append``). With ``base``,
    those of all runs over it (``update``)."""
    spark = stream.sparkSession
    path = base or shared_path(spark, name)
    ckpt = f"{base}/checkpoint" if base else shared_path(spark, name + "-ckpt")
    buckets = accumulate_stream(stream, spec, delay)
    writer = buckets.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "append":
        if base:
            raise ValueError("append mode has no table to go on with")
        q = writer.format("parquet").option("path", path).start()
        q.awaitTermination()
        marks = [p["eventTime"]["watermark"] for p in q.recentProgress if "watermark" in p["eventTime"]]
        drop_path(spark, ckpt)
        return windows_from_buckets(spark.read.schema(buckets.schema).parquet(path), spec,
                                    closed_by=max(marks, default="1970-01-01T00:00:00.000Z"))
    table = EpochTable(spark, f"{path}/buckets", [spec.station, "bucket_start"])

    def write(batch: DataFrame, epoch: int) -> None:      # a re-run epoch replaces its own rows only
        table.write(batch, epoch)
        table.compact(before=epoch)

    writer.foreachBatch(write).start().awaitTermination()
    if not base:
        drop_path(spark, ckpt)
    return windows_from_buckets(table.latest(buckets.schema), spec)


def run_to_table(query_df: DataFrame, name: str) -> str:
    """Run an append-mode streaming query to completion (``availableNow``) into a
    parquet table in the shared folder; return the table path."""
    spark = query_df.sparkSession
    path, ckpt = shared_path(spark, name), shared_path(spark, name + "-ckpt")
    q = (query_df.writeStream.outputMode("append").format("parquet").option("path", path)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return path


# --- T3: micro-batches of readings scored as they arrive ----------------------------

def scored_stream(stream: DataFrame, spec: PanelSpec, score: Callable[[DataFrame], DataFrame], name: str,
                  delay: str = "1 hour", base: str | None = None, out_keys: list[str] | None = None) -> EpochTable:
    """Every reading of the stream scored with the readings before it.

    Each micro-batch drops repeated readings (by station, TIMESTAMP and tie) and
    readings older than the watermark (``delay`` behind the newest one of the
    batches before), joins the rest with the kept history and scores both with
    ``score``. Written are the new readings and, since a late reading changes the
    look-back of what follows it, every kept reading from the oldest new one on;
    the newest epoch of a reading holds (:meth:`EpochTable.latest`).

    History is kept by time, not by a number of rows: all readings from two grid
    steps before the watermark on (cross-station context), and below that the
    last ``max_backward`` of each station (lags and trailing sums need no more).
    Its size follows the readings of the delay, so does the work of a batch; the
    batch itself is bounded by the source's trigger limits. The rows' windows run
    chunked, so a hot station is spread.

    Scores and history are tables by epoch. The snapshot a batch starts from stays
    until the batch after it has ended, so a batch that is run again finds what it
    found before. With ``base`` they and the checkpoint stay, and the next run goes on
    from them. Returns the table of scores, keyed by ``out_keys`` (default: the
    reading's keys)."""
    spark = stream.sparkSession
    home = base or shared_path(spark, name)
    keys = [spec.station, spec.ts] + ([spec.tie] if spec.tie else [])
    cols = [*keys, spec.rain]
    out, hist = EpochTable(spark, f"{home}/scores", out_keys or keys), EpochTable(spark, f"{home}/history", keys)

    def batch(df: DataFrame, epoch: int) -> None:
        new = (df.select(*cols).filter(F.col(spec.station).isNotNull() & F.col(spec.ts).isNotNull()).dropDuplicates(keys))
        last = max(hist.epochs(before=epoch), default=None)         # else: no batch before this one
        both = new.withColumn("_new", F.lit(True))
        if last is not None:
            prev = hist.epoch(last).select(*cols)
            newest = prev.agg(F.max(spec.ts)).first()[0]
            fresh = new.filter(F.col(spec.ts) >= F.lit(newest) - F.expr(f"INTERVAL {delay}"))
            same = [fresh[k].eqNullSafe(prev[k]) for k in keys]
            both = (fresh.join(prev, same, "left_anti").withColumn("_new", F.lit(True))
                    .unionByName(prev.withColumn("_new", F.lit(False))))
        both = both.checkpoint(eager=True)
        span = both.agg(F.min(F.when(F.col("_new"), F.col(spec.ts))).alias("first"), F.max(spec.ts).alias("newest")).first()
        if span["newest"] is None:
            return
        if span["first"] is not None:
            scores = score(both.select(*cols))
            out.write(scores.filter(F.col(spec.ts) >= F.lit(span["first"])), epoch)
            out.compact(before=epoch)
        cutoff = F.lit(span["newest"]) - F.expr(f"INTERVAL {delay}") - F.expr(f"INTERVAL {spec.resample or '15 minutes'}") * 2
        recent = F.col(spec.ts) >= cutoff
        order = [F.col(spec.ts).desc()] + ([F.col(spec.tie).desc()] if spec.tie else [])
        older = (both.filter(~recent).withColumn("_rn", F.row_number().over(Window.partitionBy(spec.station).orderBy(*order)))
                 .filter(F.col("_rn") <= spec.max_backward))          # limited before the shuffle
        hist.write(both.filter(recent).select(*cols).unionByName(older.select(*cols)), epoch)
        if last is not None:
            hist.forget(before=last)

    ckpt = f"{home}/checkpoint"
    q = (stream.writeStream.foreachBatch(batch).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if not base:
        hist.drop()
        drop_path(spark, ckpt)
    return out


def latest_scores(scores: EpochTable, score: Callable[[DataFrame], DataFrame], stream: DataFrame, spec: PanelSpec) -> DataFrame:
    """The newest score of every reading; an empty table has the columns of ``score``."""
    if scores.epochs() or scores.compacted() >= 0:
        return scores.latest()
    cols = [spec.station, spec.ts, *([spec.tie] if spec.tie else []), spec.rain]
    return scores.latest(score(scores.spark.createDataFrame([], stream.select(*cols).schema)).schema)


def alert_stream(stream: DataFrame, spec: PanelSpec, fitted: DataFrame, name: str, delay: str = "1 hour",
                 base: str | None = None) -> DataFrame:
    """T3 with the persistence table: per reading and horizon the trailing
    total, the persistence class, P(rain) and the alert level, scored by the
    batch operators (with their fallback for a class unseen in training).
    ``fitted`` has at most horizons x classes rows."""
    from ..functions.scalar import alert_level
    from ..operators import baselines as bl
    from ..operators import sequence as seq

    spark = stream.sparkSession
    table = spark.createDataFrame(fitted.collect(), fitted.schema)
    keys = [spec.station, spec.ts] + ([spec.tie] if spec.tie else [])

    def score(rows: DataFrame) -> DataFrame:
        d = seq.over_series(rows, spec, bl.trailing_columns(spec), back=spec.max_backward, fwd=0)
        for h in spec.horizons:      # the truth isn't known yet
            d = d.withColumn(f"obs_precip_{h.name}", F.lit(None).cast("double")).withColumn(f"obs_class_{h.name}", F.lit(None).cast("int"))
        trailing = F.create_map(*[c for h in spec.horizons for c in (F.lit(h.name), F.col(f"trail_{h.name}"))])
        long = bl.long_scored_input(d.withColumn("trailing", trailing), spec, [*keys, "trailing"])
        out = bl.score_persistence(long, table)
        return out.select(*keys, "horizon", F.element_at("trailing", F.col("horizon")).alias("trailing"), "persist_class", "p_rain",
                          alert_level("persist_class", "p_rain").alias("level"))

    out = scored_stream(stream, spec, score, name, delay, base, [*keys, "horizon"])
    return latest_scores(out, score, stream, spec)


def model_alert_job(stream: DataFrame, spec: PanelSpec, model, medians: dict[str, float], name: str,
                    delay: str = "1 hour", base: str | None = None) -> DataFrame:
    """T3 with a fitted MLlib pipeline: the batch features (lags, rolling,
    trailing sums, calendar, cross-station) of every reading, its predicted
    class, P(rain) and alert level."""
    from ..functions.scalar import alert_level
    from ..operators.modeling import score as predict
    from ..plans.jobs import feature_frame

    keys = [spec.station, spec.ts] + ([spec.tie] if spec.tie else [])

    def score(rows: DataFrame) -> DataFrame:
        return predict(model, medians, feature_frame(rows, spec)).select(
            *keys, "pred_class", "pred_prob", "p_rain", alert_level("pred_class", "p_rain").alias("level"))

    return latest_scores(scored_stream(stream, spec, score, name, delay, base), score, stream, spec)


def evaluate_alerts(alerts: DataFrame, labelled: DataFrame, spec: PanelSpec, horizon: str) -> DataFrame:
    """Streamed predictions against labels that matured later: alerts are
    scored when a reading arrives, its class is known only ``steps`` rows
    afterwards. Joining the alerts table to the labelled rows on the row key
    (a shuffle join on keys; labels still open simply do not match yet) gives
    the confusion-based metrics of what was actually alerted."""
    from ..operators import metrics as M
    keys = [spec.station, spec.ts] + ([spec.tie] if spec.tie else [])
    truth = labelled.select(*keys, F.col(f"obs_class_{horizon}").alias("obs_class"))
    matched = alerts.select(*keys, "pred_class").join(truth, keys)
    return M.evaluate(matched, []).withColumn("horizon", F.lit(horizon))
