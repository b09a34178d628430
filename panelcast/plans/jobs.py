"""End-to-end jobs assembled from the operators.

* :func:`labelled_features` — the labelling step (P4, W2, C1, F1) plus the
  backward-looking features (W3-W5), the persistence inputs and calendar /
  cross-station context, all windowed columns in **one** chunked pass.
* :func:`feature_frame` — the same features without targets, for scoring.
* :func:`scored_baselines` — long form (row × horizon) with both baselines'
  predictions and probabilities for every row; :func:`baseline_cells` — the
  class counts behind fits and metrics; :func:`newest_scored` — the stations now.
* :func:`submission` — P10 / P11 / O2 prediction table of one model;
  :func:`write_submission` / :func:`read_submissions` — S3, S4, S6.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import classify_precip
from ..operators import baselines as bl
from ..operators import features as ft
from ..operators import products as pr
from ..operators import sequence as seq
from ..operators import targets as tg
from ..sources.observations import format_ts
from ..spec import PanelSpec


def _merge(*builders):
    def build(w):
        out = {}
        for b in builders:
            out.update(b(w))
        return out
    return build


def labelled_features(panel: DataFrame, spec: PanelSpec, method: str = "chunked",
                      history: bool = True, context: bool = True) -> DataFrame:
    flagged = tg.with_holdout_flag(panel, spec)
    builders = [tg.target_columns(spec), bl.trailing_columns(spec)]
    if history:
        builders.append(ft.history_columns(spec))
    # Cross-station context is joined after the row index is written and
    # before the window shuffle, while rows are still narrow: the join moves
    # a few columns and the six context columns ride along through the window
    # stage, instead of a second shuffle of the wide labelled rows (and the
    # range sampler still only scans the panel).
    prepare = (lambda d: ft.with_cross_station(d, spec, source=panel)) if context else None
    out = seq.over_series(flagged, spec, _merge(*builders), back=spec.max_backward,
                          fwd=spec.max_forward, method=method, prepare=prepare)
    for h in spec.horizons:
        out = out.withColumn(f"obs_class_{h.name}", classify_precip(f"obs_precip_{h.name}", h.light_threshold))
    out = tg.complete_horizons(out, spec)
    if context:
        out = ft.with_time_features(out, spec)
    return out


def feature_frame(panel: DataFrame, spec: PanelSpec, method: str = "chunked") -> DataFrame:
    """Backward-looking features only (no targets, no rows dropped): what a
    model needs to score readings whose future is not known yet."""
    back = spec.max_backward
    out = seq.over_series(panel, spec, _merge(bl.trailing_columns(spec), ft.history_columns(spec)),
                          back=back, fwd=0, method=method)
    out = out.withColumn("year", F.year(F.col(spec.ts)))
    out = ft.with_time_features(out, spec)
    return ft.with_cross_station(out, spec, source=panel)


def scored_baselines(lf: DataFrame, spec: PanelSpec, keep: list[str] | None = None,
                     cells: DataFrame | None = None) -> DataFrame:
    """Both baselines fitted on the training rows and scored on all rows, which
    stay lazy: the fits only need the class counts (:func:`baseline_cells`)."""
    keep = keep or [c for c in ([spec.tie] if spec.tie else []) + [spec.station, spec.ts, "is_last_year"]]
    cells = baseline_cells(lf, spec) if cells is None else cells
    return bl.score_baselines(bl.long_scored_input(lf, spec, keep), cells)


def baseline_cells(lf: DataFrame, spec: PanelSpec) -> DataFrame:
    """Class counts of the labelled rows, all that fits and metrics read."""
    return bl.count_cells(bl.long_scored_input(lf, spec, ["is_last_year"]))


def newest_scored(panel: DataFrame, spec: PanelSpec, cells: DataFrame) -> DataFrame:
    """The persistence model on each station's newest reading."""
    long = bl.long_scored_input(pr.newest_readings(panel, spec), spec, [spec.station, spec.ts, "active"])
    return bl.score_persistence(long, bl.fit_persistence(cells.filter(F.col("is_last_year") == 0)))


def submission(scored: DataFrame, spec: PanelSpec, model: str = "persistence", sort: bool = False) -> DataFrame:
    """Test-split predictions of one model in the reference's 6 columns,
    long over horizons (write with ``partitionBy("horizon")`` for one folder
    per horizon). ``sort`` orders by (horizon, TIMESTAMP, station) — O2 — via
    a range-partitioned sort, for writing."""
    s = scored.filter((F.col("model") == model) & (F.col("is_last_year") == 1))
    if sort:
        s = s.orderBy("horizon", F.col(spec.ts).asc_nulls_last(), F.col(spec.station).asc_nulls_last())
    return s.select(
        "horizon",
        format_ts(spec.ts).alias("timestamp"),
        F.col(spec.station).alias("station_id"),
        F.col("pred_class").cast("int").alias("pred_class"),
        F.col("pred_prob").cast("double").alias("pred_prob"),
        F.col("obs_class").cast("int").alias("obs_class"),
        F.col("obs_precip").cast("double").alias("obs_precip_mm"),
    )


def write_submission(sub: DataFrame, path: str, fmt: str = "csv") -> None:
    """S3 + S4: one folder per horizon (``horizon=1h`` …), header CSV by default."""
    w = sub.write.mode("overwrite").partitionBy("horizon")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def read_submissions(spark, path: str, fmt: str = "csv") -> DataFrame:
    """Every horizon's submission as one dataset; ``horizon`` comes back
    from the folder names, so per-horizon work is a ``groupBy``, not a loop."""
    if fmt == "csv":
        schema = ("timestamp string, station_id string, pred_class int, pred_prob double, obs_class int, "
                  "obs_precip_mm double, horizon string")
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.format(fmt).load(path)
