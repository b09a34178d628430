"""Command-line jobs: the label → train → bootstrap steps over written tables
in a shared folder, and the alert stream scored with a saved pipeline.

    python -m panelcast.plans.batch label     --input obs.csv --out DIR
    python -m panelcast.plans.batch train     --out DIR [--horizon 1h] [--trees 300]
    python -m panelcast.plans.batch bootstrap --out DIR [--B 1000]
    python -m panelcast.plans.batch alerts    --out DIR --stream-dir DIR2 [--horizon 1h]

``label`` writes the master once (partitioned by the hold-out flag, so training and
scoring read only their split), the summary and, of a CSV, the fields that can't be
read; a horizon's data set is a projection of the master's columns. ``train``
fits both models per horizon on the same split, saves the pipelines, writes
the results table and the chosen model's submission (one folder per horizon).
``bootstrap`` reads the submissions as one dataset. ``alerts`` scores arriving
reading files with a saved pipeline and its training medians.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap as bs
from ..operators import datasets as ds
from ..operators.forest import ForestModel, ForestSpec
from ..operators import modeling as MD
from ..session import ensure_checkpoint_dir, get_session
from ..sources.observations import csv_rejects, read_observations_csv, read_observations_parquet
from ..spec import STATION_SPEC, PanelSpec
from . import jobs


def label(spark: SparkSession, src: DataFrame, out: str, spec: PanelSpec = STATION_SPEC) -> None:
    lf = jobs.labelled_features(src, spec)
    (lf.write.mode("overwrite").partitionBy("is_last_year").parquet(f"{out}/master"))
    master = spark.read.parquet(f"{out}/master")
    summary = ds.dataset_summary(master, spec)
    summary.write.mode("overwrite").parquet(f"{out}/summary")
    ds.summary_lines(spark.read.parquet(f"{out}/summary")).write.mode("overwrite").text(f"{out}/summary_txt")


def horizon_dataset(spark: SparkSession, out: str, horizon: str, spec: PanelSpec = STATION_SPEC) -> DataFrame:
    """A horizon's data set: the master without the other horizons' targets; the scan reads no other column."""
    return ds.horizon_dataset(spark.read.parquet(f"{out}/master"), spec, horizon)


def train(spark: SparkSession, out: str, spec: PanelSpec = STATION_SPEC, horizons=None,
          forest: ForestSpec = ForestSpec(), submit_model: str | None = None, keep_split_flag: bool = False) -> None:
    """``keep_split_flag=True`` keeps ``is_last_year`` among the features, as the
    reference's drop list does (constant within each split); dropped by default."""
    subs = None
    for h in spec.horizons:
        if horizons and h.name not in horizons:
            continue
        d = horizon_dataset(spark, out, h.name, spec)
        label_col = f"obs_class_{h.name}"
        drop = [*ds.TRAINING_DROP, *([] if keep_split_flag else ["is_last_year"]), *([spec.tie] if spec.tie else [])]
        _, nums = ds.feature_columns(d, drop=drop, label=label_col)
        train_df, test_df = ds.train_test_split(d)          # partition pruning on is_last_year
        medians = MD.exact_medians(train_df, nums)
        res, fitted, preds = MD.fit_and_evaluate(train_df, test_df, label_col, nums, forest=forest, medians=medians,
                                                 key=spec.tie)
        spark.createDataFrame(list(medians.items()), "column_name string, median double") \
            .write.mode("overwrite").parquet(f"{out}/models/{h.name}/medians")
        for name, model in fitted.items():                  # M7: reusable pipelines
            place = f"{out}/models/{h.name}/{name}"
            model.save(place) if isinstance(model, ForestModel) else model.write().overwrite().save(place)
        res = res.select(F.lit(h.name).alias("horizon"), "*")
        res.write.mode("overwrite").parquet(f"{out}/results/horizon={h.name}")
        best = submit_model or res.orderBy(F.desc("f1_macro"), "model").first()["model"]
        scored = preds[best].select(
            F.lit(h.name).alias("horizon"), F.col(spec.ts), F.col(spec.station), "pred_class", "pred_prob",
            F.col(label_col).cast("int").alias("obs_class"), F.col(f"obs_precip_{h.name}").alias("obs_precip"),
            F.lit(1).alias("is_last_year"), F.lit(best).alias("model"))
        s = jobs.submission(scored, spec, model=best)
        subs = s if subs is None else subs.unionByName(s)
    if subs is not None:
        jobs.write_submission(subs.orderBy("horizon", "timestamp", "station_id"), f"{out}/submission")


def bootstrap(spark: SparkSession, out: str, B: int = 1000) -> None:
    sub = jobs.read_submissions(spark, f"{out}/submission")
    reps = bs.bootstrap_multinomial(sub, ["horizon"], B)
    n_test = sub.groupBy("horizon").agg(F.count(F.lit(1)).alias("n_test"))
    bs.bootstrap_ci(reps, ["horizon"], n_test=n_test).orderBy("horizon") \
        .write.mode("overwrite").parquet(f"{out}/bootstrap_summary")


def alerts(spark: SparkSession, out: str, stream_dir: str, spec: PanelSpec = STATION_SPEC,
           horizon: str = "1h", model: str = "logreg", fmt: str = "parquet") -> str:
    """T3 for the saved pipeline: score a directory of arriving reading files
    (micro-batches, ``availableNow``). A second call reads the files that came since and
    goes on from the kept history. The path of the table of every reading's newest
    alert is returned; it is replaced as a whole."""
    from pyspark.ml import PipelineModel

    from ..streaming import jobs as sj
    pipe = (ForestModel if model == "rf" else PipelineModel).load(f"{out}/models/{horizon}/{model}")
    medians = {r["column_name"]: r["median"] for r in spark.read.parquet(f"{out}/models/{horizon}/medians").collect()}
    schema = spark.read.parquet(f"{out}/master").select(
        spec.station, spec.ts, spec.rain, *([spec.tie] if spec.tie else [])).schema
    stream = spark.readStream.schema(schema).format(fmt).load(stream_dir)
    path = f"{out}/alerts_{horizon}_{model}"
    (sj.model_alert_job(stream, spec, pipe, medians, f"alerts-{horizon}-{model}", base=f"{path}-job")
     .write.mode("overwrite").parquet(path))
    return path


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="panelcast.plans.batch")
    ap.add_argument("step", choices=["label", "train", "bootstrap", "alerts"])
    ap.add_argument("--stream-dir")
    ap.add_argument("--text-cols", nargs="*", default=[], help="extra non-numeric CSV columns")
    ap.add_argument("--input")
    ap.add_argument("--format", default="csv", choices=["csv", "parquet"])
    ap.add_argument("--out", required=True)
    ap.add_argument("--horizon", action="append")
    ap.add_argument("--trees", type=int, default=300)
    ap.add_argument("--depth", type=int, default=30)
    ap.add_argument("--min-rows", type=int, default=1, help="rows of a leaf")
    ap.add_argument("--exact-bags", action="store_true", help="a fit per bag, weights of each bag in the splits too")
    ap.add_argument("--B", type=int, default=1000)
    ap.add_argument("--keep-split-flag", action="store_true")
    ap.add_argument("--master")
    a = ap.parse_args(argv)
    spark = get_session(a.master) if a.master else SparkSession.builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    if a.step == "label":
        src = (read_observations_csv(spark, a.input, STATION_SPEC, strings=a.text_cols) if a.format == "csv"
               else read_observations_parquet(spark, a.input))
        if a.format == "csv":
            csv_rejects(spark, a.input, STATION_SPEC, strings=a.text_cols).write.mode("overwrite").parquet(f"{a.out}/rejects")
            print(f"unreadable fields: {spark.read.parquet(f'{a.out}/rejects').count()}")
        label(spark, src, a.out)
    elif a.step == "train":
        train(spark, a.out, horizons=a.horizon, forest=ForestSpec(bags=a.trees, max_depth=a.depth, min_rows=a.min_rows, exact=a.exact_bags), keep_split_flag=a.keep_split_flag)
    elif a.step == "bootstrap":
        bootstrap(spark, a.out, a.B)
    else:
        print(alerts(spark, a.out, a.stream_dir, horizon=(a.horizon or ["1h"])[0]))


if __name__ == "__main__":
    main()
