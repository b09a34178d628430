"""Data-set shaping and summaries: per-horizon projections (P5-P8, S4),
distributions and counts (A2-A4), split (F2), sorts and preview (O1, O4)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import PanelSpec

# Columns the reference's training step drops when present.
TRAINING_DROP = [
    "TIMESTAMP",
    "obs_precip_1h", "obs_class_1h",
    "obs_precip_3h", "obs_class_3h",
    "obs_precip_6h", "obs_class_6h",
    "target_rain_t1",
    "target_heavy_rain_t1",
    "target_rain_next_1h",
    "target_rain_event_next_1h",
    "target_heavy_next_1h",
    "split",
]
CATEGORICAL = ["station"]


def long_targets(df: DataFrame, spec: PanelSpec, keep: Iterable[str] = ()) -> DataFrame:
    """S4 long form: one row per (row, horizon) with ``obs_precip``/``obs_class``."""
    items = F.array(*[
        F.struct(F.lit(h.name).alias("horizon"),
                 F.col(f"obs_precip_{h.name}").alias("obs_precip"),
                 F.col(f"obs_class_{h.name}").alias("obs_class"))
        for h in spec.horizons])
    return (df.select(*keep, F.explode(items).alias("_t"))
            .select(*keep, "_t.horizon", "_t.obs_precip", "_t.obs_class"))


def horizon_dataset(df: DataFrame, spec: PanelSpec, horizon: str) -> DataFrame:
    """Keep every column but the other horizons' targets."""
    others = [c for h in spec.horizons if h.name != horizon
              for c in (f"obs_precip_{h.name}", f"obs_class_{h.name}")]
    return df.drop(*others)


def normalized_counts(df: DataFrame, group: list[str], col: str, count_col: str = "n",
                      share_col: str = "share") -> DataFrame:
    """A2: ``value_counts(normalize=True)`` per group; missing values excluded.
    The count is a partial/final aggregate; the share divides by the group
    total over the already tiny result."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*group, col).agg(F.count(F.lit(1)).alias(count_col))
    total = F.sum(count_col).over(Window.partitionBy(*group)) if group else F.sum(count_col).over(Window.partitionBy())
    return counts.withColumn(share_col, F.col(count_col) / total)


def class_distribution(labelled: DataFrame, spec: PanelSpec) -> DataFrame:
    """A2 for every horizon at once: one shuffle of (horizon, class) partials."""
    return normalized_counts(long_targets(labelled, spec), ["horizon"], "obs_class")


def value_counts(df: DataFrame, col: str, count_col: str = "n") -> DataFrame:
    """A3: counts per value (order by count desc is applied by callers that
    publish it; ordering a distributed result is only for display)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(count_col))


def train_test_split(df: DataFrame, flag: str = "is_last_year") -> tuple[DataFrame, DataFrame]:
    """temporal split on the hold-out flag."""
    return df.filter(F.col(flag) == 0), df.filter(F.col(flag) == 1)


def feature_columns(df: DataFrame, drop: Iterable[str] = TRAINING_DROP,
                    categorical: Iterable[str] = CATEGORICAL, label: str | None = None) -> tuple[list[str], list[str]]:
    """P7 + P8: drop-if-exists against the static list (plus the label), then
    split the rest into categorical and numeric columns from the schema."""
    drop = set(drop) | ({label} if label else set())
    kept = [f for f in df.schema.fields if f.name not in drop]
    cats = [f.name for f in kept if f.name in set(categorical)]
    nums = [f.name for f in kept if f.name not in set(categorical)
            and isinstance(f.dataType, T.NumericType)]
    return cats, nums


def dataset_summary(labelled: DataFrame, spec: PanelSpec, flag: str = "is_last_year") -> DataFrame:
    """S5 / A2-A4 as one table (section, item, value): shapes of the master
    and per-horizon sets, class shares per horizon, rows per station and per
    hold-out flag. Every figure comes from one pass of partial aggregates."""
    n_cols = len(labelled.columns)
    per_h_cols = n_cols - 2 * (len(spec.horizons) - 1)
    keyed = long_targets(labelled, spec, keep=[spec.station, flag])
    # One aggregate at the finest grain (horizon, class, station, flag); every
    # section below re-aggregates this small table, which is written once so
    # the labelled data is not re-computed per section.
    g = (keyed.groupBy("horizon", "obs_class", spec.station, flag)
         .agg(F.count(F.lit(1)).alias("n"))).checkpoint(eager=True)
    first_h = spec.horizons[0].name
    one = g.filter(F.col("horizon") == first_h)  # each input row once
    rows = one.agg(F.sum("n").alias("n"))
    shape = rows.select(F.lit("shape").alias("section"), F.lit("master").alias("item"),
                        F.col("n").cast("double").alias("rows"), F.lit(float(n_cols)).alias("value"))
    shapes = [shape] + [
        rows.select(F.lit("shape").alias("section"), F.lit(f"dataset_{h.name}").alias("item"),
                    F.col("n").cast("double").alias("rows"), F.lit(float(per_h_cols)).alias("value"))
        for h in spec.horizons]
    cls = (g.groupBy("horizon", "obs_class").agg(F.sum("n").alias("n"))
           .withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("horizon")))
           .select(F.lit("class_share").alias("section"),
                   F.concat_ws(":", "horizon", F.col("obs_class").cast("string")).alias("item"),
                   F.col("n").cast("double").alias("rows"), F.col("share").alias("value")))
    st = (one.groupBy(spec.station).agg(F.sum("n").alias("n"))
          .select(F.lit("station").alias("section"), F.coalesce(F.col(spec.station), F.lit("nan")).alias("item"),
                  F.col("n").cast("double").alias("rows"), F.col("n").cast("double").alias("value")))
    fl = (one.groupBy(flag).agg(F.sum("n").alias("n"))
          .select(F.lit("split").alias("section"), F.col(flag).cast("string").alias("item"),
                  F.col("n").cast("double").alias("rows"), F.col("n").cast("double").alias("value")))
    out = shapes[0]
    for d in shapes[1:] + [cls, st, fl]:
        out = out.unionByName(d)
    return out


def preview(df: DataFrame, spec: PanelSpec, cols: list[str], n: int = 5) -> DataFrame:
    """First n rows in series order (top-k: each task keeps n rows)."""
    order = [F.col(spec.station).asc_nulls_last(), F.col(spec.ts).asc_nulls_last()]
    if spec.tie:
        order.append(F.col(spec.tie).asc_nulls_last())
    return df.orderBy(*order).limit(n).select(*cols)


def summary_lines(summary: DataFrame) -> DataFrame:
    """S5 text form: one line per summary row, in section order, e.g.
    ``class_share 1h:0 rows=6216 value=0.826486``."""
    order = F.when(F.col("section") == "shape", 0).when(F.col("section") == "class_share", 1) \
        .when(F.col("section") == "station", 2).otherwise(3)
    line = F.format_string("%s %s rows=%d value=%.6f", "section", "item", F.col("rows").cast("bigint"), "value")
    # counts within the station / split sections descend, like value_counts()
    by_count = F.when(F.col("section").isin("station", "split"), -F.col("rows")).otherwise(F.lit(0.0))
    return (summary.select(order.alias("_o"), by_count.alias("_c"), "item", line.alias("value"))
            .orderBy("_o", "_c", "item").select("value"))
