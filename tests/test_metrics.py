"""Metric definitions against hand-computed scikit-learn values."""

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from conftest import SF_MID
from panelcast.operators import metrics as M


def _df(spark, pairs):
    return spark.createDataFrame([(t, p) for t, p in pairs], "obs_class int, pred_class int")


def test_macro_f1_label_union_and_zero_division(spark):
    # truth has no class 2; prediction has class 2 once → label set {0,1,2}
    pairs = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 2)]
    s = M.evaluate(_df(spark, pairs), []).first()
    # class 0: tp 2, t 3, p 2 → f1 = 4/5; class 1: tp 1, t 2, p 2 → 1/2; class 2: tp 0, t 0, p 1 → 0
    assert abs(s["f1_macro"] - (0.8 + 0.5 + 0.0) / 3) < 1e-12
    assert abs(s["accuracy"] - 3 / 5) < 1e-12
    assert abs(s["f1_weighted"] - (0.8 * 3 + 0.5 * 2) / 5) < 1e-12


def test_class_absent_everywhere(spark):
    pairs = [(0, 0), (1, 1), (1, 0)]
    pc = {r["cls"]: r for r in M.per_class(M.confusion(_df(spark, pairs), []), []).collect()}
    assert set(pc) == {0, 1}


def test_micro_equals_accuracy_and_weighted_matches_mllib(spark):
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet").select(
        F.col("quality").alias("obs_class"), F.col("toxic").alias("pred_class"))
    s = M.evaluate(labels, []).first()
    assert abs(s["f1_micro"] - s["accuracy"]) < 1e-12
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="f1")
    d = labels.select(F.col("obs_class").cast("double").alias("label"), F.col("pred_class").cast("double").alias("prediction"))
    assert abs(ev.evaluate(d) - s["f1_weighted"]) < 1e-9


def test_confusion_matrix_zero_filled(spark):
    pairs = [(0, 0), (0, 1), (1, 1)]
    cm = {r["obs_class"]: (r["pred_0"], r["pred_1"], r["pred_2"])
          for r in M.confusion_matrix(_df(spark, pairs), []).collect()}
    assert cm == {0: (1, 1, 0), 1: (0, 1, 0)}


def test_classification_report_rows(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (2, 2)]
    items = {r["item"] for r in M.classification_report(_df(spark, pairs), []).collect()}
    assert items == {"0", "1", "2", "accuracy", "macro avg", "weighted avg"}


def test_rounding_half_even(spark):
    v = M.rounded(spark.createDataFrame([(0.125,), (0.135,)], "x double"), ["x"], 2).collect()
    assert [r["x"] for r in v] == [0.12, 0.14]
