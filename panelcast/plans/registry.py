"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key of
``events`` and friends) so its work grows with them."""

from __future__ import annotations

from collections.abc import Callable

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import percent
from ..operators import baselines as bl
from ..operators import bootstrap as bs
from ..operators import datasets as ds
from ..operators import features as ft
from ..operators.forest import ForestSpec, bag_weights
from ..operators import metrics as M
from ..operators import modeling as MD
from ..operators import products as PR
from ..operators import sequence as seq
from ..operators import targets as tg
from ..session import shared_path
from ..sources import proxy
from ..sources.observations import TS_FORMAT, csv_rejects, read_observations_csv
from ..spec import PROXY_SPEC
from ..streaming import jobs as sj
from . import jobs

SPEC = PROXY_SPEC
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c):
    """Round to 6 digits for engine-independent comparison (sums and
    transcendental functions differ in the last bits between engines)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxy.load_panel(spark, sf_dir, SPEC)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tg.label_panel(panel(spark, sf_dir), SPEC)


def target_out():
    out = []
    for h in SPEC.horizons:
        out += [r6(f"obs_precip_{h.name}").alias(f"obs_precip_{h.name}"), F.col(f"obs_class_{h.name}")]
    return out


@register("scan_observations")
def q_scan_observations(spark, sf_dir):
    return panel(spark, sf_dir).select("station", "TIMESTAMP", "Rain_mm_Tot", "event_id")


@register("holdout_flag")
def q_holdout_flag(spark, sf_dir):
    return tg.with_holdout_flag(panel(spark, sf_dir), SPEC).select(
        "event_id", "station", "TIMESTAMP", "year", "is_last_year")


@register("rain_leads")
def q_rain_leads(spark, sf_dir):
    out = tg.with_leads(panel(spark, sf_dir), SPEC)
    return out.select("event_id", "station", *[f"Rain_mm_Tot_lead_{k}" for k in range(1, SPEC.max_forward + 1)])


@register("obs_precip")
def q_obs_precip(spark, sf_dir):
    out = tg.with_targets(panel(spark, sf_dir), SPEC)
    return out.select("event_id", "station", *[
        r6(f"obs_precip_{h.name}").alias(f"obs_precip_{h.name}") for h in SPEC.horizons])


@register("obs_class")
def q_obs_class(spark, sf_dir):
    out = tg.with_targets(panel(spark, sf_dir), SPEC)
    return out.select("event_id", "station", *[f"obs_class_{h.name}" for h in SPEC.horizons])


@register("complete_horizons")
def q_complete_horizons(spark, sf_dir):
    return labelled(spark, sf_dir).select(
        "event_id", "station", "TIMESTAMP", "Rain_mm_Tot", "year", "is_last_year", *target_out())


@register("class_distribution")
def q_class_distribution(spark, sf_dir):
    return ds.class_distribution(labelled(spark, sf_dir), SPEC)


# --- labelling variants, sorts, splits, summaries ------------------------------


KEEP = ["event_id", "station", "TIMESTAMP", "is_last_year"]
B_REPLICATES = 1000   # the reference's B


def lf(spark, sf_dir, **kw):
    return jobs.labelled_features(panel(spark, sf_dir), SPEC, **kw)


def scored(spark, sf_dir):
    return jobs.scored_baselines(lf(spark, sf_dir, history=False, context=False), SPEC, keep=KEEP)


def scored_cells(spark, sf_dir):
    """Both baselines on the class counts: enough for every metric."""
    cells = jobs.baseline_cells(lf(spark, sf_dir, history=False, context=False), SPEC)
    return bl.score_baselines(cells, cells)


def holdout_cells(spark, sf_dir):
    return scored_cells(spark, sf_dir).filter(F.col("is_last_year") == 1)


def holdout_scored(spark, sf_dir):
    return scored(spark, sf_dir).filter(F.col("is_last_year") == 1)


@register("horizon_wide")
def q_horizon_wide(spark, sf_dir):
    """P5: the reference's way — K lead columns, their sum (missing if any
    lead is missing), classes, then every ``*_lead_*`` column dropped."""
    p = tg.with_holdout_flag(panel(spark, sf_dir), SPEC)
    p = tg.with_leads(p, SPEC)
    for h in SPEC.horizons:
        total = None
        for k in range(1, h.steps + 1):
            c = F.col(f"Rain_mm_Tot_lead_{k}")
            total = c if total is None else total + c
        p = p.withColumn(f"obs_precip_{h.name}", total)
        p = p.withColumn(f"obs_class_{h.name}", tg.classify_precip(f"obs_precip_{h.name}", h.light_threshold))
    p = tg.drop_prefix(tg.complete_horizons(p, SPEC), "Rain_mm_Tot_lead_")
    return p.select("event_id", "station", "TIMESTAMP", "Rain_mm_Tot", "year", "is_last_year", *target_out())


# The data set of a horizon keeps only its own target pair.
for _key, _h in (("horizon_dataset_1h", "1h"), ("horizon_dataset", "3h"), ("horizon_dataset_6h", "6h")):
    def _q_horizon(spark, sf_dir, _h=_h):
        d = ds.horizon_dataset(labelled(spark, sf_dir), SPEC, _h)
        return d.select(*[r6(c).alias(c) if c.startswith("obs_precip") else F.col(c) for c in d.columns])
    register(_key)(_q_horizon)


@register("horizon_long")
def q_horizon_long(spark, sf_dir):
    """One output per horizon as one dataset partitioned by horizon,
    written to the shared folder and scanned back."""
    long = ds.long_targets(labelled(spark, sf_dir), SPEC, keep=["event_id", "station", "TIMESTAMP"])
    path = shared_path(spark, "horizon_long")
    long.write.mode("overwrite").partitionBy("horizon").parquet(path)
    back = spark.read.parquet(path)
    return back.select("event_id", "station", "TIMESTAMP", "horizon", r6("obs_precip").alias("obs_precip"), "obs_class")


@register("csv_roundtrip")
def q_csv_roundtrip(spark, sf_dir):
    """S1 + S2 + S3: write the panel as header CSV, read it back with an
    explicit schema and parse the timestamp."""
    p = panel(spark, sf_dir)
    path = shared_path(spark, "panel_csv")
    (p.select(F.date_format("TIMESTAMP", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("TIMESTAMP"), "station",
              "Rain_mm_Tot", "event_id")
     .write.mode("overwrite").option("header", True).csv(path))
    schema = T.StructType([T.StructField("TIMESTAMP", T.StringType()), T.StructField("station", T.StringType()),
                           T.StructField("Rain_mm_Tot", T.DoubleType()), T.StructField("event_id", T.LongType())])
    back = read_observations_csv(spark, path, SPEC, schema=schema, ts_format=TS_FORMAT + ".SSSSSS")
    return back.select("station", "TIMESTAMP", "Rain_mm_Tot", "event_id")


@register("csv_rejects")
def q_csv_rejects(spark, sf_dir):
    """Fields that can't be read, in a CSV of the panel where every 50th reading and every 211th
    time is no number or time; missing readings aren't among them."""
    path = shared_path(spark, "damaged_csv")
    text = F.col("event_id").cast("string")
    (panel(spark, sf_dir).select(
        F.when(F.col("event_id") % 211 == 0, F.concat(text, F.lit("h"))).otherwise(F.date_format("TIMESTAMP", TS_FORMAT)).alias("TIMESTAMP"),
        "station", F.when(F.col("event_id") % 50 == 0, F.concat(text, F.lit("x"))).when(F.col("Rain_mm_Tot").isNull(), F.lit("NA"))
        .otherwise(F.col("Rain_mm_Tot").cast("string")).alias("Rain_mm_Tot"), "event_id")
     .write.mode("overwrite").option("header", True).csv(path))
    schema = T.StructType([T.StructField("TIMESTAMP", T.StringType()), T.StructField("station", T.StringType()),
                           T.StructField("Rain_mm_Tot", T.DoubleType()), T.StructField("event_id", T.LongType())])
    return csv_rejects(spark, path, SPEC, schema=schema, ts_format=TS_FORMAT).select("column_name", "value")


@register("sorted_panel")
def q_sorted_panel(spark, sf_dir):
    """O1: position of every row in (station, TIMESTAMP missing last, tie) order."""
    out = seq.with_global_index(panel(spark, sf_dir), SPEC, "row_index")
    return out.select("row_index", "event_id", "station", "TIMESTAMP")


@register("preview")
def q_preview(spark, sf_dir):
    """First 5 rows of the labelled master."""
    cols = ["TIMESTAMP", "station", *[c for h in SPEC.horizons for c in (f"obs_precip_{h.name}", f"obs_class_{h.name}")],
            "is_last_year"]
    out = ds.preview(labelled(spark, sf_dir), SPEC, cols, 5)
    return out.select(*[r6(c).alias(c) if c.startswith("obs_precip") else F.col(c) for c in cols])


@register("train_test_split")
def q_train_test_split(spark, sf_dir):
    train, test = ds.train_test_split(labelled(spark, sf_dir))
    return (train.select("event_id", "station", F.lit("train").alias("split"))
            .unionByName(test.select("event_id", "station", F.lit("test").alias("split"))))


@register("station_counts")
def q_station_counts(spark, sf_dir):
    return ds.value_counts(labelled(spark, sf_dir), "station").orderBy(F.desc("n"), F.asc_nulls_last("station"))


@register("split_counts")
def q_split_counts(spark, sf_dir):
    return ds.value_counts(labelled(spark, sf_dir), "is_last_year").orderBy(F.desc("n"), F.asc("is_last_year"))


@register("dataset_summary")
def q_dataset_summary(spark, sf_dir):
    return ds.dataset_summary(labelled(spark, sf_dir), SPEC)


# --- features --------------------------------------------------------------------

@register("time_features")
def q_time_features(spark, sf_dir):
    p = ft.with_time_features(panel(spark, sf_dir), SPEC).withColumn("year", F.year("TIMESTAMP"))
    return p.select("event_id", "station", "year", "hour", "day_of_week", "month",
                    r6("hour_sin").alias("hour_sin"), r6("hour_cos").alias("hour_cos"))


@register("rain_lags")
def q_rain_lags(spark, sf_dir):
    p = ft.with_history(panel(spark, sf_dir), SPEC)
    return p.select("event_id", "station", *ft.lag_names(SPEC))


@register("rain_rolling")
def q_rain_rolling(spark, sf_dir):
    p = ft.with_history(panel(spark, sf_dir), SPEC)
    return p.select("event_id", "station", *[r6(c).alias(c) for c in ft.roll_names(SPEC)])


@register("cross_station")
def q_cross_station(spark, sf_dir):
    cs = ft.cross_station(panel(spark, sf_dir), SPEC)
    return cs.select("station", "bucket_ts", *[r6(c).alias(c) for c in ["Rain_mm_Tot", *ft.CROSS_NAMES]])


def feature_table(spark, sf_dir, horizon="1h"):
    d = ds.horizon_dataset(lf(spark, sf_dir), SPEC, horizon)
    # the split flag is constant within each split: dropped by default
    cats, nums = ds.feature_columns(d, drop=[*ds.TRAINING_DROP, "event_id", "is_last_year"],
                                    label=f"obs_class_{horizon}")
    return d, cats, nums


# P7 + P8: drop-if-exists list, categorical / numeric split; the table handed to the vector
# assembler (with the row key and label).
for _key, _h in (("feature_matrix", "1h"), ("feature_matrix_3h", "3h"), ("feature_matrix_6h", "6h")):
    def _q_features(spark, sf_dir, _h=_h):
        d, cats, nums = feature_table(spark, sf_dir, _h)
        floats = {f.name for f in d.schema.fields if f.dataType.typeName() in ("double", "float")}
        return d.select("event_id", *cats, *[r6(c).alias(c) if c in floats else F.col(c) for c in nums], f"obs_class_{_h}")
    register(_key)(_q_features)


@register("assembled_vector")
def q_assembled_vector(spark, sf_dir):
    """M3: the vector handed to the models, 1 h hold-out rows: imputed numeric columns, then station slots."""
    d, _, nums = feature_table(spark, sf_dir)
    d = d.checkpoint(eager=True)
    train, test = ds.train_test_split(d)
    medians = MD.exact_medians(train, nums)
    stages = Pipeline(stages=MD.feature_stages(sorted(medians))).fit(MD.fill_medians(train, medians))
    out = stages.transform(MD.fill_medians(test, medians)).select("event_id", F.posexplode(vector_to_array("features")).alias("slot", "v"))
    return out.select("event_id", "slot", r6("v").alias("value"))


# --- baselines, submission, metrics ----------------------------------------------

@register("submission")
def q_submission(spark, sf_dir):
    sub = jobs.submission(scored(spark, sf_dir), SPEC)
    return sub.select("horizon", "timestamp", "station_id", "pred_class", r6("pred_prob").alias("pred_prob"),
                      "obs_class", r6("obs_precip_mm").alias("obs_precip_mm"))


@register("submission_files")
def q_submission_files(spark, sf_dir):
    """S3 + S4 + S6: the sorted submission written as one CSV folder per
    horizon and scanned back as one dataset."""
    path = shared_path(spark, "submission")
    jobs.write_submission(jobs.submission(scored(spark, sf_dir), SPEC, sort=True), path)
    sub = jobs.read_submissions(spark, path)
    return sub.select("horizon", "timestamp", "station_id", "pred_class", r6("pred_prob").alias("pred_prob"),
                      "obs_class", r6("obs_precip_mm").alias("obs_precip_mm"))


@register("pred_prob")
def q_pred_prob(spark, sf_dir):
    """Probability of the predicted class indexed out of the vector."""
    s = holdout_scored(spark, sf_dir).filter(F.col("model") == "persistence")
    probs = F.array("p0", "p1", "p2")
    return s.select("event_id", "horizon", "pred_class",
                    r6(F.element_at(probs, F.col("pred_class") + 1)).alias("pred_prob"),
                    r6("p_rain").alias("p_rain"))


def _evaluated(spark, sf_dir):
    return M.evaluate(holdout_cells(spark, sf_dir), ["model", "horizon"])


for _m in ("accuracy", "f1_macro", "f1_weighted", "f1_micro"):
    def _q(spark, sf_dir, _m=_m):
        return _evaluated(spark, sf_dir).select("model", "horizon", r6(_m).alias(_m))
    register(_m)(_q)


@register("label_pair_metrics")
def q_label_pair_metrics(spark, sf_dir):
    """E1-E4 on the ``labels`` table read as a two-class truth / prediction
    pair (quality vs toxic): the label-union and 0/0 edge cases on real data."""
    lab = proxy.load_table(spark, sf_dir, "labels").select(
        F.col("quality").alias("obs_class"), F.col("toxic").alias("pred_class"))
    e = M.evaluate(lab, [])
    return e.select(*[r6(c).alias(c) for c in ("accuracy", "f1_macro", "f1_weighted", "f1_micro")], "n_rows")


@register("baseline_results")
def q_baseline_results(spark, sf_dir):
    """U1 / M9 for the SQL-checkable baselines: one row per (model, horizon)."""
    e = _evaluated(spark, sf_dir)
    return e.select("model", "horizon", *[r6(c).alias(c) for c in ("accuracy", "f1_macro", "f1_weighted")])


@register("metrics_rounded")
def q_metrics_rounded(spark, sf_dir):
    """4-digit half-even rounding and whole percentages."""
    e = _evaluated(spark, sf_dir)
    out = M.rounded(e.select("model", "horizon", "accuracy", "f1_macro", "f1_weighted"),
                    ["accuracy", "f1_macro", "f1_weighted"])
    return out.withColumn("accuracy_pct", percent("accuracy"))


@register("classification_report")
def q_classification_report(spark, sf_dir):
    r = M.classification_report(holdout_cells(spark, sf_dir), ["model", "horizon"])
    return r.select("model", "horizon", "item", *[r6(c).alias(c) for c in ("precision", "recall", "f1_score")],
                    "support")


@register("confusion_matrix")
def q_confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(holdout_cells(spark, sf_dir), ["model", "horizon"])


@register("prediction_distribution")
def q_prediction_distribution(spark, sf_dir):
    return M.prediction_distribution(holdout_cells(spark, sf_dir), ["model", "horizon"])


@register("overfitting_gap")
def q_overfitting_gap(spark, sf_dir):
    s = scored_cells(spark, sf_dir)
    g = M.overfitting_gap(s.filter(F.col("is_last_year") == 0), s.filter(F.col("is_last_year") == 1),
                          ["model", "horizon"])
    return g.select("model", "horizon", *[r6(c).alias(c) for c in (
        "accuracy", "f1_macro", "f1_micro", "f1_weighted", "f1_macro_train", "overfitting_gap")], "test_rows")


def best_models(evaluated):
    """Model with the highest macro-F1 per horizon (ties → name order)."""
    w = Window.partitionBy("horizon").orderBy(F.desc("f1_macro"), F.asc("model"))
    return (evaluated.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
            .select("horizon", F.col("model").alias("best_model"), "f1_macro", "accuracy", "f1_weighted", "n_rows"))


@register("best_model")
def q_best_model(spark, sf_dir):
    b = best_models(_evaluated(spark, sf_dir))
    return b.select("horizon", "best_model", r6("f1_macro").alias("f1_macro"))


@register("metric_card")
def q_metric_card(spark, sf_dir):
    """Rounded metrics of the best model per horizon and its test rows."""
    b = best_models(_evaluated(spark, sf_dir))
    return M.rounded(b.select("horizon", "accuracy", "f1_weighted", "f1_macro", "best_model",
                              F.col("n_rows").alias("test_rows")), ["accuracy", "f1_weighted", "f1_macro"])


# --- bootstrap -------------------------------------------------------------------

def _persistence_cells(spark, sf_dir):
    return holdout_cells(spark, sf_dir).filter(F.col("model") == "persistence")


@register("bootstrap_macro_f1")
def q_bootstrap_macro_f1(spark, sf_dir):
    reps = bs.bootstrap_hash(_persistence_cells(spark, sf_dir), ["horizon"], B_REPLICATES)
    return reps.select("horizon", "b", r6("f1_macro").alias("f1_macro"))


@register("bootstrap_ci")
def q_bootstrap_ci(spark, sf_dir):
    t = _persistence_cells(spark, sf_dir)
    reps = bs.bootstrap_hash(t, ["horizon"], B_REPLICATES)
    n_test = t.groupBy("horizon").agg(F.sum("_n_rows").alias("n_test"))
    ci = bs.bootstrap_ci(reps, ["horizon"], n_test=n_test).orderBy("horizon")
    return ci.select("horizon", *[r6(c).alias(c) for c in ("macro_f1_mean", "ci_2_5", "ci_97_5")], "B", "n_test")


@register("bootstrap_multinomial")
def q_bootstrap_multinomial(spark, sf_dir):
    t = _persistence_cells(spark, sf_dir)
    reps = bs.bootstrap_multinomial(t, ["horizon"], B_REPLICATES)
    n_test = t.groupBy("horizon").agg(F.sum("_n_rows").alias("n_test"))
    ci = bs.bootstrap_ci(reps, ["horizon"], n_test=n_test)
    return ci.select("horizon", *[r6(c).alias(c) for c in ("macro_f1_mean", "ci_2_5", "ci_97_5")], "B", "n_test")


@register("bootstrap_cells")
def q_bootstrap_cells(spark, sf_dir):
    """The confusion cells of every multinomial replicate."""
    return bs.multinomial_cells(_persistence_cells(spark, sf_dir), ["horizon"], B_REPLICATES)


# --- modelling -----------------------------------------------------------------------


FOREST = ForestSpec()       # 300 trees, as the original has


# Exact training-split median of every numeric feature of a horizon's data set.
for _key, _h in (("impute_median", "1h"), ("impute_median_3h", "3h"), ("impute_median_6h", "6h")):
    def _q_median(spark, sf_dir, _h=_h):
        d, _, nums = feature_table(spark, sf_dir, _h)
        train = d.filter(F.col("is_last_year") == 0).select(*nums).checkpoint(eager=True)       # read by every pass
        rows = [(c, float(v)) for c, v in MD.exact_medians(train, nums).items()]
        return spark.createDataFrame(rows, "column_name string, median double").select("column_name", r6("median").alias("median"))
    register(_key)(_q_median)


@register("impute_mode")
def q_impute_mode(spark, sf_dir):
    """A10: most frequent station in the training split (ties → smallest)."""
    train = labelled(spark, sf_dir).filter(F.col("is_last_year") == 0)
    return MD.most_frequent(train, "station")


@register("one_hot_station")
def q_one_hot_station(spark, sf_dir):
    """M2: station one-hot fitted on the training split, applied to all rows."""
    d = labelled(spark, sf_dir)
    model = Pipeline(stages=MD.station_encoder("station")).fit(d.filter(F.col("is_last_year") == 0))
    out = model.transform(d)
    bits = F.transform(vector_to_array("station_vec"), lambda x: x.cast("int").cast("string"))
    return out.select("event_id", "station", F.array_join(bits, "").alias("station_onehot"))


@register("class_weights")
def q_class_weights(spark, sf_dir):
    """Balanced weights per horizon and class on the training split."""
    long = ds.long_targets(labelled(spark, sf_dir), SPEC, keep=["is_last_year"])
    return MD.class_weights(long.filter(F.col("is_last_year") == 0), "obs_class", ["horizon"])


def _training_table(spark, sf_dir):
    """Rows, features and training medians shared by every horizon's fit: only
    the target differs. Labelled once and written once to the shared folder,
    since medians, weights, fits and scoring all read it."""
    d = lf(spark, sf_dir).checkpoint(eager=True)
    _, nums = ds.feature_columns(d, drop=[*ds.TRAINING_DROP, "event_id", "is_last_year"])
    return d, nums, MD.exact_medians(d.filter(F.col("is_last_year") == 0), nums)


def _predict_query(spark, sf_dir, name):
    d, _, nums = feature_table(spark, sf_dir, "1h")
    d = d.checkpoint(eager=True)
    train, test = ds.train_test_split(d)
    model, medians, _ = MD.fit_one(train, "obs_class_1h", nums, name, forest=FOREST)
    return MD.score(model, medians, test).select("event_id", "station", "pred_class", "pred_prob", "p_rain",
                                                 F.col("obs_class_1h").alias("obs_class"))


@register("logreg_predict")
def q_logreg_predict(spark, sf_dir):
    """M5 + M7 + M8: weighted multinomial logistic regression, 1 h."""
    return _predict_query(spark, sf_dir, "logreg")


@register("rf_predict")
def q_rf_predict(spark, sf_dir):
    """M6 + M7 + M8: random forest balanced per bag (300 trees), 1 h."""
    return _predict_query(spark, sf_dir, "rf")


@register("forest_bag_weights")
def q_forest_bag_weights(spark, sf_dir):
    """M6: draws and balanced weight of each class in each of the forest's bags, 1 h training rows."""
    train = labelled(spark, sf_dir).filter(F.col("is_last_year") == 0)
    w = bag_weights(train, "obs_class_1h", "event_id", FOREST.bags)
    return w.select("bag", F.col("label").alias("obs_class"), "n_draws", r6("weight").alias("weight"))


@register("logreg_optimality")
def q_logreg_optimality(spark, sf_dir):
    """M5: largest gradient component and value of the penalised loss at the fitted coefficients, per horizon."""
    d, nums, medians = _training_table(spark, sf_dir)

    def one(h):
        label = f"obs_class_{h.name}"
        train, _ = ds.train_test_split(ds.horizon_dataset(d, SPEC, h.name))
        train = MD.with_class_weight(train, MD.class_weights(train, label), label)
        model, _, _ = MD.fit_one(train.drop("weight"), label, nums, "logreg", medians=medians)
        return (h.name, *MD.gradient_norm(model, MD.fill_medians(train, medians), label))

    with ThreadPoolExecutor(max_workers=len(SPEC.horizons)) as pool:
        rows = list(pool.map(one, SPEC.horizons))
    return spark.createDataFrame(rows, "horizon string, gradient double, loss double")


@register("model_results")
def q_model_results(spark, sf_dir):
    """M9 + U1: both models on every horizon, one results table. The
    horizons' fits are independent Spark jobs, submitted from threads so
    they share the executors instead of queueing."""
    d, nums, medians = _training_table(spark, sf_dir)

    def one(h):
        train, test = ds.train_test_split(ds.horizon_dataset(d, SPEC, h.name))
        res, _, _ = MD.fit_and_evaluate(train, test, f"obs_class_{h.name}", nums, forest=FOREST, medians=medians)
        rows = res.collect()            # one row per model: materialise inside the thread
        return [(h.name, *[r[c] for c in RESULT_COLS]) for r in rows]

    with ThreadPoolExecutor(max_workers=len(SPEC.horizons)) as pool:
        rows = [r for part in pool.map(one, SPEC.horizons) for r in part]
    return spark.createDataFrame(rows, "horizon string, model string, accuracy double, f1_macro double, "
                                       "f1_micro double, f1_weighted double, f1_macro_train double, "
                                       "overfitting_gap double, test_rows bigint")


RESULT_COLS = ["model", "accuracy", "f1_macro", "f1_micro", "f1_weighted", "f1_macro_train",
               "overfitting_gap", "test_rows"]


@register("model_submission")
def q_model_submission(spark, sf_dir):
    """P10-P12 of the trained model: the hold-out predictions of one logistic
    regression per horizon in the submission's columns, long over horizons."""
    d, nums, medians = _training_table(spark, sf_dir)

    def one(h):
        train, test = ds.train_test_split(ds.horizon_dataset(d, SPEC, h.name))
        model, _, _ = MD.fit_one(train, f"obs_class_{h.name}", nums, "logreg", medians=medians)
        return MD.score(model, medians, test).withColumns({
            "horizon": F.lit(h.name), "model": F.lit("logreg"), "obs_class": F.col(f"obs_class_{h.name}"),
            "obs_precip": F.col(f"obs_precip_{h.name}")}).select(
            "horizon", "model", "is_last_year", "TIMESTAMP", "station", "pred_class", "pred_prob", "obs_class",
            "obs_precip")

    with ThreadPoolExecutor(max_workers=len(SPEC.horizons)) as pool:
        parts = list(pool.map(one, SPEC.horizons))
    scored_rows = parts[0]
    for part in parts[1:]:
        scored_rows = scored_rows.unionByName(part)
    return jobs.submission(scored_rows, SPEC, model="logreg")


# --- dashboard products -------------------------------------------------------------

def _cells(spark, sf_dir):
    return jobs.baseline_cells(lf(spark, sf_dir, history=False, context=False), SPEC)


def _now(spark, sf_dir):
    """The stations now: one row per station and horizon."""
    return jobs.newest_scored(panel(spark, sf_dir), SPEC, _cells(spark, sf_dir))


def _card(spark, sf_dir, now=None):
    now = (now if now is not None else _now(spark, sf_dir)).filter("active")
    return PR.horizon_card(now, PR.station_bootstrap(now, SPEC, B_REPLICATES), SPEC)


CARD_FLOATS = ("probability", "pred_prob_mean", "ci_lower", "ci_upper")


@register("station_panel")
def q_station_panel(spark, sf_dir):
    sp = PR.station_panel(panel(spark, sf_dir), _now(spark, sf_dir), SPEC)
    return sp.select("horizon", "station_id", "status", "trend", r6("last_reading").alias("last_reading"),
                     r6("probability").alias("probability"), "pred_class", "recent_mm_x1000", "n_active",
                     "n_stations")


@register("horizon_card")
def q_horizon_card(spark, sf_dir):
    c = _card(spark, sf_dir)
    return c.select(*[r6(x).alias(x) if x in CARD_FLOATS else F.col(x) for x in c.columns])


@register("network_series")
def q_network_series(spark, sf_dir):
    ns = PR.network_series(panel(spark, sf_dir), _card(spark, sf_dir), SPEC)
    return ns.select("horizon", "time", "offset_min", *[r6(x).alias(x) for x in ("avg", "q10", "q90")], "forecast")


def _persistence_rows(d, cells):
    """Hold-out predictions of the persistence model (lazy)."""
    s = jobs.scored_baselines(d, SPEC, keep=KEEP, cells=cells)
    return s.filter((F.col("model") == "persistence") & (F.col("is_last_year") == 1))


@register("prob_histogram")
def q_prob_histogram(spark, sf_dir):
    d = lf(spark, sf_dir, history=False, context=False)
    cells = jobs.baseline_cells(d, SPEC)
    card = _card(spark, sf_dir, jobs.newest_scored(panel(spark, sf_dir), SPEC, cells))
    return PR.prob_histogram(_persistence_rows(d, cells), "pred_prob", ["horizon"], card)


@register("alert_level")
def q_alert_level(spark, sf_dir):
    return PR.alerts(_card(spark, sf_dir))


def _bundle(spark, sf_dir):
    """The nested per-horizon dashboard document (all products together); the
    class counts are taken once and shared by every product."""
    p = panel(spark, sf_dir)
    d = lf(spark, sf_dir, history=False, context=False)
    cells = jobs.baseline_cells(d, SPEC)
    pers = _persistence_rows(d, cells)
    now = jobs.newest_scored(p, SPEC, cells)
    card = _card(spark, sf_dir, now)
    test = bl.score_baselines(cells, cells).filter(F.col("is_last_year") == 1)
    mcard = M.rounded(best_models(M.evaluate(test, ["model", "horizon"])).select(
        "horizon", "accuracy", "f1_weighted", "f1_macro", "best_model", F.col("n_rows").alias("test_rows")),
        ["accuracy", "f1_weighted", "f1_macro"])
    return PR.dashboard_bundle(card, PR.station_panel(p, now, SPEC), PR.network_series(p, card, SPEC),
                               PR.prob_histogram(pers, "pred_prob", ["horizon"], card),
                               PR.alerts(card), mcard, [h.name for h in SPEC.horizons])


@register("dashboard_bundle")
def q_dashboard_bundle(spark, sf_dir):
    """The dashboard document as JSON, one row per horizon."""
    return _bundle(spark, sf_dir).select("horizon", "json")


@register("dashboard_fields")
def q_dashboard_fields(spark, sf_dir):
    """The dashboard document field by field."""
    return PR.bundle_fields(_bundle(spark, sf_dir))


# --- streaming -----------------------------------------------------------------------


@register("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    """Watermarked de-duplicated readings, run with availableNow."""
    s = sj.ingest_stream(sj.panel_stream(sj.stream_session(spark), sf_dir, SPEC), SPEC)
    path = sj.run_to_table(s.drop("event_time"), "stream_ingest")
    return spark.read.parquet(path).select("station", "TIMESTAMP", "Rain_mm_Tot", "event_id")


def _window_totals(spark, sf_dir, name, mode):
    out = sj.run_accumulation(sj.panel_stream(sj.stream_session(spark), sf_dir, SPEC), SPEC, name, mode)
    return out.select("window_len", "station", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                      r6("rain_sum").alias("rain_sum"), "n_readings")


@register("stream_accumulate")
def q_stream_accumulate(spark, sf_dir):
    """Sliding-window totals per station of all readings."""
    return _window_totals(spark, sf_dir, "stream_accumulate", "update")


@register("stream_accumulate_append")
def q_stream_accumulate_append(spark, sf_dir):
    """T2 in append mode: only windows closed by the final watermark."""
    return _window_totals(spark, sf_dir, "stream_accumulate_append", "append")


@register("stream_alerts")
def q_stream_alerts(spark, sf_dir):
    """Every reading's alerts, scored with the persistence table fitted on
    the batch training split."""
    fitted = bl.fit_persistence(_cells(spark, sf_dir).filter(F.col("is_last_year") == 0))
    stream = proxy.events_panel(sj.events_stream(spark, sf_dir), SPEC)
    out = sj.alert_stream(stream, SPEC, fitted, "stream_alerts")
    return out.select("event_id", "station", "TIMESTAMP", "horizon", r6("trailing").alias("trail_total"), "persist_class",
                      r6("p_rain").alias("p_rain"), "level")


def _model_alerts(spark, sf_dir):
    d, _, nums = feature_table(spark, sf_dir, "1h")
    d = d.checkpoint(eager=True)
    model, medians, _ = MD.fit_one(d.filter(F.col("is_last_year") == 0), "obs_class_1h", nums, "logreg")
    stream = proxy.events_panel(sj.events_stream(spark, sf_dir), SPEC)
    return sj.model_alert_job(stream, SPEC, model, medians, "stream_alerts_model")


@register("stream_alerts_model")
def q_stream_alerts_model(spark, sf_dir):
    """T3 with MLlib: the 1 h logistic regression (fitted on the batch
    training split) scores each micro-batch of the readings stream."""
    return _model_alerts(spark, sf_dir)


@register("stream_alert_metrics")
def q_stream_alert_metrics(spark, sf_dir):
    """T3 evaluation: the streamed 1 h alerts against the labels that matured
    after them (rows whose next four readings arrived), hold-out rows only: the
    model was fitted on the others."""
    held_out = labelled(spark, sf_dir).filter(F.col("is_last_year") == 1)
    return sj.evaluate_alerts(_model_alerts(spark, sf_dir), held_out, SPEC, "1h")
