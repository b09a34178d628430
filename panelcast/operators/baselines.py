"""Deterministic baseline classifiers (test device of SURVEY §7.3).

* ``persistence``: the class of the *trailing* K rows (current row included)
  predicts the class of the next K rows. Probabilities are the conditional
  class shares P(obs_class | persistence class) counted on the training split.
* ``climatology``: always the training majority class (ties → smallest),
  probabilities = training class shares.

Both are SQL-expressible, so submission, metrics and bootstrap get exact
oracles before any MLlib model is fitted. Fits and metrics only need the row
counts per (horizon, split, truth, persistence class): :func:`count_cells` is
one partial/final aggregate of at most horizons × 2 × (K + 1) × K rows, whose
result is a local table. The fitted tables derived from it have at most
horizons × K rows and are broadcast under that bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import classify_precip
from ..spec import PanelSpec
from . import sequence as seq

CLASSES = (0, 1, 2)
# Fixed smoothing for a persistence class never seen in training:
# own class 0.8, each other class 0.1.
FALLBACK_OWN, FALLBACK_OTHER = 0.8, 0.1


def trailing_columns(spec: PanelSpec):
    def build(w):
        return {f"trail_{h.name}": seq.trailing_sum(spec.rain, h.steps, w) for h in spec.horizons}
    return build


def long_scored_input(lf: DataFrame, spec: PanelSpec, keep: list[str]) -> DataFrame:
    """One row per (row, horizon): truth and the persistence class."""
    items = F.array(*[
        F.struct(F.lit(h.name).alias("horizon"),
                 F.col(f"obs_precip_{h.name}").alias("obs_precip"),
                 F.col(f"obs_class_{h.name}").alias("obs_class"),
                 F.coalesce(classify_precip(f"trail_{h.name}", h.light_threshold), F.lit(0)).alias("persist_class"))
        for h in spec.horizons])
    return (lf.select(*keep, F.explode(items).alias("_t"))
            .select(*keep, "_t.horizon", "_t.obs_precip", "_t.obs_class", "_t.persist_class"))


def count_cells(long: DataFrame, flag: str = "is_last_year") -> DataFrame:
    """Rows per (horizon, flag, truth, persistence class) as a local table with
    ``_n_rows``: the classes bound its size, whatever the number of rows. In one
    partition, so that fits and metrics over it need no shuffle."""
    cells = long.groupBy("horizon", flag, "obs_class", "persist_class").agg(F.count(F.lit(1)).alias("_n_rows"))
    return long.sparkSession.createDataFrame(cells.collect(), cells.schema).coalesce(1)


def _probs_from_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    tot = F.sum("n").over(Window.partitionBy(*keys))
    shares = counts.withColumn("p", F.col("n") / tot)
    wide = shares.groupBy(*keys).pivot("obs_class", list(CLASSES)).agg(F.first("p"))
    return wide.select(*keys, *[F.coalesce(F.col(str(c)), F.lit(0.0)).alias(f"p{c}") for c in CLASSES])


def fit_persistence(train: DataFrame) -> DataFrame:
    """``train``: the training part of :func:`count_cells`."""
    counts = train.groupBy("horizon", "persist_class", "obs_class").agg(F.sum("_n_rows").alias("n"))
    return _probs_from_counts(counts, ["horizon", "persist_class"])


def fit_climatology(train: DataFrame) -> DataFrame:
    counts = train.groupBy("horizon", "obs_class").agg(F.sum("_n_rows").alias("n"))
    best = (counts.withColumn("_r", F.row_number().over(
        Window.partitionBy("horizon").orderBy(F.desc("n"), F.asc("obs_class"))))
        .filter(F.col("_r") == 1).select("horizon", F.col("obs_class").alias("major_class")))
    return _probs_from_counts(counts, ["horizon"]).join(best, "horizon")


def _finish(df: DataFrame, model: str) -> DataFrame:
    probs = F.array(*[F.col(f"p{c}") for c in CLASSES])
    return (df.withColumn("model", F.lit(model))
            .withColumn("pred_prob", F.element_at(probs, F.col("pred_class") + 1))
            .withColumn("p_rain", F.lit(1.0) - F.col("p0")))


def score_persistence(long: DataFrame, fitted: DataFrame) -> DataFrame:
    joined = long.join(F.broadcast(fitted), ["horizon", "persist_class"], "left")
    own = F.col("persist_class")
    probs = [F.coalesce(F.col(f"p{c}"), F.when(own == c, F.lit(FALLBACK_OWN)).otherwise(F.lit(FALLBACK_OTHER)))
             .alias(f"p{c}") for c in CLASSES]
    out = joined.select(*[c for c in long.columns], *probs).withColumn("pred_class", own)
    return _finish(out, "persistence")


def score_climatology(long: DataFrame, fitted: DataFrame) -> DataFrame:
    out = (long.join(F.broadcast(fitted), "horizon", "left")
           .withColumn("pred_class", F.col("major_class")).drop("major_class"))
    return _finish(out, "climatology")


def score_baselines(long: DataFrame, cells: DataFrame, flag: str = "is_last_year") -> DataFrame:
    """Both baselines fitted on the training cells (flag = 0), scoring ``long``:
    rows, or the cells themselves (then each with its ``_n_rows``)."""
    train = cells.filter(F.col(flag) == 0)
    pers = score_persistence(long, fit_persistence(train))
    clim = score_climatology(long, fit_climatology(train))
    return pers.unionByName(clim)
