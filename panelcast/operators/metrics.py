"""Classification metrics (E1-E8, A5) from one confusion aggregate.

Every metric starts from ``groupBy(group, label, prediction).count()``: at
most K² rows per group however many predictions there are, so everything
after the first partial/final aggregate works on a tiny table.

Definitions follow scikit-learn: macro-F1 averages over the labels present
in truth *or* prediction; F1 = 2·tp / (true + predicted) with 0/0 → 0;
weighted F1 weights by true support; micro-F1 = 2·Σtp / (Σtrue + Σpred).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import round_metric


def confusion(df: DataFrame, group: list[str], label: str = "obs_class", pred: str = "pred_class") -> DataFrame:
    """Row counts per (group, label, prediction). Rows may be counted already: a
    column ``_n_rows`` then says how many rows each stands for."""
    return (df.filter(F.col(label).isNotNull() & F.col(pred).isNotNull())
            .groupBy(*group, F.col(label).alias("label"), F.col(pred).alias("pred"))
            .agg(_rows(df).alias("n")))


def _rows(df: DataFrame):
    return F.sum("_n_rows") if "_n_rows" in df.columns else F.count(F.lit(1))


def _div0(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class(conf: DataFrame, group: list[str]) -> DataFrame:
    """tp, true / predicted support, precision, recall, F1 per class."""
    roles = F.explode(F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"),
                 F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"),
                 F.lit(0).cast("bigint").alias("tp")),
    ))
    s = (conf.select(*group, roles.alias("r"))
         .groupBy(*group, F.col("r.cls").alias("cls"))
         .agg(F.sum("r.tp").alias("tp"), F.sum("r.t").alias("support"), F.sum("r.p").alias("predicted")))
    return s.select(
        *group, "cls", "tp", "support", "predicted",
        _div0(F.col("tp"), F.col("predicted")).alias("precision"),
        _div0(F.col("tp"), F.col("support")).alias("recall"),
        _div0(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def summary(pc: DataFrame, group: list[str]) -> DataFrame:
    """E1-E4 per group: accuracy, macro / weighted / micro F1 and row count."""
    n = F.sum("support")
    return pc.groupBy(*group).agg(
        (F.sum("tp") / n).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"),
        (2 * F.sum("tp") / (n + F.sum("predicted"))).alias("f1_micro"),
        n.alias("n_rows"),
    )


def evaluate(df: DataFrame, group: list[str], label: str = "obs_class", pred: str = "pred_class") -> DataFrame:
    return summary(per_class(confusion(df, group, label, pred), group), group)


def classification_report(df: DataFrame, group: list[str], label: str = "obs_class",
                          pred: str = "pred_class") -> DataFrame:
    """E5: per-class precision / recall / F1 / support plus ``accuracy``,
    ``macro avg`` and ``weighted avg`` rows."""
    pc = per_class(confusion(df, group, label, pred), group)
    cls_rows = pc.select(*group, F.col("cls").cast("string").alias("item"), "precision", "recall",
                         F.col("f1").alias("f1_score"), F.col("support"))
    n = F.sum("support")
    macro = pc.groupBy(*group).agg(
        F.lit("macro avg").alias("item"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1_score"), n.alias("support"))
    weighted = pc.groupBy(*group).agg(
        F.lit("weighted avg").alias("item"),
        (F.sum(F.col("precision") * F.col("support")) / n).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_score"), n.alias("support"))
    acc = pc.groupBy(*group).agg(
        F.lit("accuracy").alias("item"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), (F.sum("tp") / n).alias("f1_score"), n.alias("support"))
    return cls_rows.unionByName(acc).unionByName(macro).unionByName(weighted)


def confusion_matrix(df: DataFrame, group: list[str], classes=(0, 1, 2), label: str = "obs_class",
                     pred: str = "pred_class") -> DataFrame:
    """Zero-filled matrix, one row per label seen in truth or prediction
    (scikit-learn's label set), one column per predicted class."""
    conf = confusion(df, group, label, pred)
    labels = (conf.select(*group, F.col("label").alias("cls"))
              .union(conf.select(*group, F.col("pred").alias("cls"))).distinct())
    wide = (conf.groupBy(*group, F.col("label").alias("cls"))
            .pivot("pred", list(classes)).agg(F.sum("n")))
    out = labels.join(wide, [*group, "cls"], "left")
    return out.select(*group, F.col("cls").alias("obs_class"),
                      *[F.coalesce(F.col(str(c)), F.lit(0)).cast("bigint").alias(f"pred_{c}") for c in classes])


def prediction_distribution(df: DataFrame, group: list[str], pred: str = "pred_class") -> DataFrame:
    """A5: share of each predicted class per group."""
    c = df.filter(F.col(pred).isNotNull()).groupBy(*group, pred).agg(_rows(df).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))


def overfitting_gap(train_scored: DataFrame, test_scored: DataFrame, group: list[str]) -> DataFrame:
    """Macro-F1 train − test next to the test metrics."""
    te = evaluate(test_scored, group)
    tr = evaluate(train_scored, group).select(*group, F.col("f1_macro").alias("f1_macro_train"))
    return (te.join(tr, group, "left")
            .select(*group, "accuracy", "f1_macro", "f1_micro", "f1_weighted", "f1_macro_train",
                    (F.col("f1_macro_train") - F.col("f1_macro")).alias("overfitting_gap"),
                    F.col("n_rows").alias("test_rows")))


def rounded(df: DataFrame, cols: list[str], digits: int = 4) -> DataFrame:
    """Metrics rounded half-to-even like Python's ``round``."""
    return df.select(*[round_metric(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])
