"""End to end on a reference-shaped station master: regular 15-minute grid,
4 stations, CSV with NaN / NA / empty tokens, no tie column, cross-station
context at equal timestamps."""

import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelcast.operators import targets as tg
from panelcast.plans import batch, jobs
from panelcast.sources.observations import read_observations_csv
from panelcast.operators.forest import ForestSpec
from panelcast.spec import STATION_SPEC

SPEC = STATION_SPEC.with_(holdout="1 DAY", chunk_rows=100)


def _master_csv() -> str:
    rng = np.random.default_rng(3)
    ts = pd.date_range("2025-03-01", periods=4 * 96, freq="15min")
    frames = []
    for s in ["CER", "JUN", "MERC", "MIRA"]:
        rain = np.where(rng.random(len(ts)) < 0.8, 0.0, rng.integers(1, 4, len(ts)) * 0.254)
        txt = [f"{v:.3f}" for v in rain]
        for i in rng.choice(len(ts), 3, replace=False):
            txt[i] = rng.choice(["NaN", "NA", ""])
        # columns deliberately not in (TIMESTAMP, station, rain) order
        frames.append(pd.DataFrame({"AirTC_Avg": rng.normal(25, 2, len(ts)).round(2), "station": s,
                                    "Rain_mm_Tot": txt, "TIMESTAMP": ts.strftime("%Y-%m-%d %H:%M:%S")}))
    d = tempfile.mkdtemp(prefix="panelcast-master-")
    pd.concat(frames).sample(frac=1, random_state=1).to_csv(os.path.join(d, "master.csv"), index=False)
    return d


def test_station_master_end_to_end(spark):
    src = read_observations_csv(spark, _master_csv(), SPEC)
    assert src.filter(F.col("Rain_mm_Tot").isNull()).count() == 12
    assert dict(src.dtypes) == {"AirTC_Avg": "double", "station": "string", "Rain_mm_Tot": "double",
                                "TIMESTAMP": "timestamp_ntz"}
    assert src.agg(F.min("AirTC_Avg")).first()[0] > 10          # read from its own column
    a = jobs.labelled_features(src, SPEC, method="chunked")
    b = jobs.labelled_features(src, SPEC, method="plain")
    key = ["station", "TIMESTAMP"]
    cols = sorted(c for c in a.columns if c not in key)
    ra = {tuple(r[k] for k in key): tuple(r[c] for c in cols) for r in a.collect()}
    rb = {tuple(r[k] for k in key): tuple(r[c] for c in cols) for r in b.collect()}
    assert ra == rb and len(ra) > 0
    # cross-station context at the same timestamp: 4 stations share one step
    row = a.filter(F.col("rain_allstations_sum_t").isNotNull()).first()
    assert row["rain_allstations_max_t"] >= row["rain_allstations_min_t"]
    # the extra meteorological column flows into the feature set
    out = tempfile.mkdtemp(prefix="panelcast-master-out-")
    batch.label(spark, src, out, SPEC)
    master = spark.read.parquet(f"{out}/master")
    assert master.count() == tg.label_panel(src, SPEC).count()
    batch.train(spark, out, SPEC, horizons=["1h"], forest=ForestSpec(bags=10))
    sub = spark.read.option("header", True).csv(f"{out}/submission")
    assert sub.count() == master.filter(F.col("is_last_year") == 1).count()
    batch.bootstrap(spark, out, B=40)
    assert spark.read.parquet(f"{out}/bootstrap_summary").first()["B"] == 40
