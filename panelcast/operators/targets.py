"""Labelling operators: hold-out flag (P4), forward accumulation (W1, W2),
intensity classes (C1) and the complete-horizon filter (F1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import classify_precip
from ..spec import PanelSpec
from . import sequence as seq


def scalar_like(value, data_type) -> Column:
    """A driver-side scalar (one aggregate value) as a literal of the
    column's own type, so timestamp_ntz stays ntz and no time zone applies."""
    if value is None:
        return F.lit(None).cast(data_type)
    return F.lit(str(value)).cast(data_type)


def with_holdout_flag(df: DataFrame, spec: PanelSpec, flag: str = "is_last_year",
                      year_col: str | None = "year") -> DataFrame:
    """P1 + P4: calendar year and the last-period flag
    ``TIMESTAMP >= max(TIMESTAMP) - interval`` (0/1; missing timestamp → 0).
    The max is a scalar subquery (one partial/final aggregate scanning only
    the timestamp column), planned lazily with the query: no join, no
    un-partitioned window and no driver round trip."""
    mx = df.select(F.max(F.col(spec.ts))).scalar()
    ts = F.col(spec.ts)
    start = mx - F.expr(f"INTERVAL {spec.holdout}")
    out = df
    if year_col:
        out = out.withColumn(year_col, F.year(ts))
    return out.withColumn(flag, F.coalesce((ts >= start).cast("int"), F.lit(0)))


def lead_columns(spec: PanelSpec, k_max: int | None = None):
    """W1 builder: ``<rain>_lead_k`` for k = 1..k_max."""
    k_max = k_max or spec.max_forward

    def build(w):
        return {f"{spec.rain}_lead_{k}": F.lead(F.col(spec.rain), k).over(w) for k in range(1, k_max + 1)}
    return build


def target_columns(spec: PanelSpec):
    """W2 builder: ``obs_precip_<h>`` = null-strict sum of the next steps."""
    def build(w):
        return {f"obs_precip_{h.name}": seq.forward_sum(spec.rain, h.steps, w) for h in spec.horizons}
    return build


def with_targets(df: DataFrame, spec: PanelSpec, method: str = "chunked") -> DataFrame:
    """W2 + C1: forward totals and classes for every horizon."""
    out = seq.over_series(df, spec, target_columns(spec), back=0, fwd=spec.max_forward, method=method)
    for h in spec.horizons:
        out = out.withColumn(f"obs_class_{h.name}", classify_precip(f"obs_precip_{h.name}", h.light_threshold))
    return out


def with_leads(df: DataFrame, spec: PanelSpec, k_max: int | None = None, method: str = "chunked") -> DataFrame:
    k_max = k_max or spec.max_forward
    return seq.over_series(df, spec, lead_columns(spec, k_max), back=0, fwd=k_max, method=method)


def complete_horizons(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """F1 + P9: drop rows missing any horizon's total or class, classes as int."""
    out = df.dropna("any", subset=spec.target_cols())
    for h in spec.horizons:
        out = out.withColumn(f"obs_class_{h.name}", F.col(f"obs_class_{h.name}").cast("int"))
    return out


def drop_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """P5: drop every column whose name starts with ``prefix``."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def label_panel(panel: DataFrame, spec: PanelSpec, method: str = "chunked") -> DataFrame:
    """The whole labelling step: year, hold-out flag (max taken before rows
    are dropped), forward totals, classes, complete rows only."""
    flagged = with_holdout_flag(panel, spec)
    return complete_horizons(with_targets(flagged, spec, method), spec)
