"""The batch CLI steps over written tables (proxy panel, small forest)."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from panelcast.operators.forest import ForestSpec
from panelcast.plans import batch
from panelcast.sources import proxy
from panelcast.spec import PROXY_SPEC


def test_label_train_bootstrap(spark):
    out = tempfile.mkdtemp(prefix="panelcast-batch-")
    spec = PROXY_SPEC
    batch.label(spark, proxy.load_panel(spark, SF_SMALL, spec), out, spec)
    assert spark.read.parquet(f"{out}/master").count() == 664          # FIXTURES.md §D, sf0.001
    lines = [r["value"] for r in spark.read.text(f"{out}/summary_txt").collect()]
    assert "shape master rows=664" in " ".join(lines) and any(x.startswith("class_share 6h:2") for x in lines)
    batch.train(spark, out, spec, horizons=["1h"], forest=ForestSpec(bags=10))
    sub = spark.read.option("header", True).csv(f"{out}/submission")
    assert sub.count() == 58
    batch.bootstrap(spark, out, B=50)
    row = spark.read.parquet(f"{out}/bootstrap_summary").first()
    assert row["B"] == 50 and row["n_test"] == 58
    # T3 from the saved pipeline over a directory of reading files
    src = tempfile.mkdtemp(prefix="panelcast-readings-")
    proxy.load_panel(spark, SF_SMALL, spec).write.mode("overwrite").parquet(src)
    alerts = spark.read.parquet(batch.alerts(spark, out, src, spec, horizon="1h", model="logreg"))
    assert alerts.count() == 1000 and set(r["level"] for r in alerts.select("level").distinct().collect()) <= {"bajo", "medio", "alto"}
    # a second call reads the readings that came since, and only those
    n_files = len(spark.read.parquet(f"{out}/alerts_1h_logreg-job/scores/rows/epoch=0").inputFiles())
    later = proxy.load_panel(spark, SF_SMALL, spec).orderBy(F.desc("TIMESTAMP")).limit(5)
    later.withColumns({"TIMESTAMP": F.expr("TIMESTAMP + INTERVAL 3 DAYS"), "event_id": F.col("event_id") + 1_000_000}) \
        .coalesce(1).write.mode("append").parquet(src)
    alerts = spark.read.parquet(batch.alerts(spark, out, src, spec, horizon="1h", model="logreg"))
    assert alerts.count() == 1005 and n_files > 0
    first_new = later.agg(F.min(F.expr("TIMESTAMP + INTERVAL 3 DAYS"))).first()[0]
    assert spark.read.parquet(f"{out}/alerts_1h_logreg-job/scores/rows/epoch=1").agg(F.min("TIMESTAMP")).first()[0] == first_new
    assert spark.read.parquet(batch.alerts(spark, out, src, spec, horizon="1h", model="rf")).count() == 1005
