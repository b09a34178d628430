"""Feature operators: calendar features (P1-P3), rain lags (W3), rolling
statistics (W4, W5) and cross-station context (W6, W7).

All row features look only backwards (lags, trailing windows that include
the current row), so no feature at t depends on rows after t; the targets
start at row t+1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..spec import PanelSpec
from . import sequence as seq

CROSS_STATS = ("mean", "max", "min", "std", "sum")


def with_time_features(df: DataFrame, spec: PanelSpec) -> DataFrame:
    ts = F.col(spec.ts)
    return df.select(
        "*",
        S.hour(ts).alias("hour"),
        S.day_of_week(ts).alias("day_of_week"),
        S.month(ts).alias("month"),
        S.hour_sin(ts).alias("hour_sin"),
        S.hour_cos(ts).alias("hour_cos"),
    )


def lag_names(spec: PanelSpec) -> list[str]:
    return [f"{spec.rain}_lag_{k}" for k in spec.lags]


def roll_names(spec: PanelSpec) -> list[str]:
    out = []
    for n in spec.rolls:
        out += [f"{spec.rain}_rollmean_{n}", f"{spec.rain}_rollstd_{n}"]
    return out


def history_columns(spec: PanelSpec):
    """W3-W5 builder: lags and rolling mean / std over one window spec."""
    r = spec.rain

    def build(w):
        cols = {f"{r}_lag_{k}": F.lag(F.col(r), k).over(w) for k in spec.lags}
        for n in spec.rolls:
            cols[f"{r}_rollmean_{n}"] = seq.rolling_mean(r, n, w)
            cols[f"{r}_rollstd_{n}"] = seq.rolling_std(r, n, w)
        return cols
    return build


def with_history(df: DataFrame, spec: PanelSpec, method: str = "chunked") -> DataFrame:
    back = max([*spec.lags, *(n - 1 for n in spec.rolls)])
    return seq.over_series(df, spec, history_columns(spec), back=back, fwd=0, method=method)


# --- cross-station context ------------------------------------------------------

def bucket_col(spec: PanelSpec):
    """The time key shared by stations: TIMESTAMP itself on a regular grid, or
    its ``spec.resample`` bucket start on an irregular panel."""
    if spec.resample:
        return F.window(F.col(spec.ts), spec.resample).start
    return F.col(spec.ts)


def station_grid(panel: DataFrame, spec: PanelSpec, bucket: str = "bucket_ts") -> DataFrame:
    """(station, bucket) grid with the bucket's rain total (NULL if all
    readings missing). Partial aggregation shrinks the data before the
    shuffle; each bucket afterwards holds at most one row per station."""
    return (panel.filter(F.col(spec.ts).isNotNull())
            .groupBy(F.col(spec.station), bucket_col(spec).alias(bucket))
            .agg(F.sum(F.col(spec.rain)).alias(spec.rain)))


def cross_station(panel: DataFrame, spec: PanelSpec, bucket: str = "bucket_ts") -> DataFrame:
    """W6 + W7 on the station grid: network mean / max / min / sample std /
    sum at each time step, and the mean over the *other* stations.
    ``Window.partitionBy(bucket)`` holds one row per station, so a group is
    bounded by the station count however the data grows."""
    grid = station_grid(panel, spec, bucket).filter(F.col(spec.station).isNotNull())
    r = F.col(spec.rain)
    w = Window.partitionBy(bucket)
    total, cnt = F.sum(r).over(w), F.count(r).over(w)
    others = (F.when(r.isNull(), F.when(cnt > 0, total / cnt))
              .otherwise(F.when(cnt > 1, (total - r) / (cnt - 1))))
    return grid.select(
        spec.station, bucket, spec.rain,
        F.avg(r).over(w).alias("rain_allstations_mean_t"),
        F.max(r).over(w).alias("rain_allstations_max_t"),
        F.min(r).over(w).alias("rain_allstations_min_t"),
        F.stddev_samp(r).over(w).alias("rain_allstations_std_t"),
        total.alias("rain_allstations_sum_t"),
        others.alias("rain_otherstations_mean_t"),
    )


CROSS_NAMES = [f"rain_allstations_{s}_t" for s in CROSS_STATS] + ["rain_otherstations_mean_t"]


def context_bound(panel: DataFrame, spec: PanelSpec) -> float:
    """The most rows the context grid can have, from one narrow aggregate: no more than the panel,
    and on a resampled one no more than stations (with 30 % for the sketch's error) times steps."""
    span = (F.max(spec.ts) - F.min(spec.ts)).cast("interval second").cast("bigint")
    row = panel.agg(F.count(F.lit(1)).alias("n"), span.alias("seconds"), F.approx_count_distinct(spec.station).alias("stations")).first()
    if not spec.resample:
        return row["n"]
    n, unit = spec.resample.split()
    step = int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return min(row["n"], 1.3 * (row["stations"] + 1) * ((row["seconds"] or 0) / step + 2))


def with_cross_station(df: DataFrame, spec: PanelSpec, source: DataFrame | None = None) -> DataFrame:
    """Attach cross-station context (computed from ``source``, default ``df``)
    to every row of ``df``. On a regular grid the step at t is used; on a
    resampled panel the last *completed* bucket before t, since the bucket
    holding t also holds later readings. A grid of few rows (checked) is broadcast, so
    the rows aren't shuffled for it; a larger one is joined by shuffles."""
    source = df if source is None else source
    cs = cross_station(source, spec).drop(spec.rain)
    key = bucket_col(spec)
    if spec.resample:
        key = key - F.expr(f"INTERVAL {spec.resample}")
    left = df.withColumn("_ctx_bucket", key)
    right = cs.withColumnRenamed("bucket_ts", "_ctx_rbucket").withColumnRenamed(spec.station, "_ctx_station")
    if context_bound(source, spec) <= seq.BROADCAST_ROWS:
        right = F.broadcast(right)
    cond = (F.col(spec.station) == F.col("_ctx_station")) & (F.col("_ctx_bucket") == F.col("_ctx_rbucket"))
    return left.join(right, cond, "left").drop("_ctx_bucket", "_ctx_rbucket", "_ctx_station")


def build_features(panel: DataFrame, spec: PanelSpec, method: str = "chunked") -> DataFrame:
    """Time features + lags + rolling statistics + cross-station context."""
    return with_cross_station(with_time_features(with_history(panel, spec, method), spec), spec, source=panel)
