"""Row-ordered per-series windows that scale with few, long series.

The reference shifts every station's rows (``groupby("station").shift``). The
plain Spark form, ``Window.partitionBy(station)``, sorts a whole station in one
task; with four stations a single task holds a quarter of the data or more.

The chunked form used here writes no copy and numbers no rows:

1. **Cells.** A row's cell is its station and a step of time whose width follows
   from the table's row count and span, so that even a station that holds all rows
   has about ``chunk_rows / 16`` in one. Rows per cell are counted (a partial
   aggregate of two columns). Cells that hold too many rows are cut again at every
   single TIMESTAMP, and a burst of equal TIMESTAMPs at quantiles of the tie-break.
   A cell is an expression of its row alone, the same wherever it is evaluated.
2. **Chunks with halo.** Running counts over a station's cells (not its rows) deal them
   to chunks of about ``chunk_rows`` rows. The cells that hold any of the first
   ``fwd`` rows of a chunk also go to the chunk before, those with any of the last
   ``back`` to the next one. One shuffle by (station, chunk) then carries the rows, windows run
   inside the chunks, and only each row's home copy is kept. A halo holds whole cells,
   so at least the rows a window reads.

Every window has at most a chunk and its halo in a group, whatever a station
holds. A cell table of at most ``BROADCAST_ROWS`` rows is dealt to chunks on the driver and
broadcast, a larger one by windows over the cells and joined by shuffles.
``method="plain"`` of :func:`over_series` is the reference form used by tests as the
property check.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from ..spec import PanelSpec

_TIE = "_seq_tie"
CELL = ["_c1", "_c2", "_c3"]       # step of time, TIMESTAMP inside a dense step, part of a burst
NEVER = 1 << 62                    # the step of rows without a TIMESTAMP: after all others
CELLS_PER_CHUNK = 16
BROADCAST_ROWS = 100_000           # a counted table of narrow rows is broadcast up to this


def order_columns(spec: PanelSpec) -> list[Column]:
    """Series order: station, then timestamp with missing last (pandas
    ``sort_values``), then the tie-break column if any."""
    cols = [F.col(spec.station).asc_nulls_last(), F.col(spec.ts).asc_nulls_last()]
    if spec.tie:
        cols.append(F.col(spec.tie).asc_nulls_last())
    return cols


def _match(left: DataFrame, right: DataFrame, station: str, cols: list[str], small: bool, how: str) -> DataFrame:
    """``left`` with the columns of ``right`` on the station (missing equals missing) and ``cols``."""
    names = {c: f"_r_{c}" for c in [station, *cols]}
    right = right.withColumnsRenamed(names)
    on = left[station].eqNullSafe(right[names[station]])
    for c in cols:
        on = on & (left[c] == right[names[c]])
    return left.join(F.broadcast(right) if small else right, on, how).drop(*names.values())


def with_cells(df: DataFrame, spec: PanelSpec, chunk_rows: int) -> tuple[DataFrame, DataFrame, list | None]:
    """(rows with their cell, cells with their row count ``n``, the cells' rows if they are at most
    ``BROADCAST_ROWS``). Two or, where a cell is dense, up to four aggregates run here."""
    ts, limit = F.col(spec.ts), chunk_rows // 2
    head = df.agg(F.count(F.lit(1)).alias("n"), F.min(ts).cast("string").alias("lo"),
                  _seconds(F.max(ts) - F.min(ts)).cast("bigint").alias("span")).first()
    steps = max(1, -(-CELLS_PER_CHUNK * head["n"] // chunk_rows))
    width = max(1, -(-(head["span"] or 0) // steps))
    origin = F.lit(head["lo"]).cast(df.schema[spec.ts].dataType)
    rows = df.withColumn("_sec", _seconds(ts - origin))
    rows = (rows.withColumn("_c1", F.coalesce(F.floor(F.col("_sec") / width).cast("bigint"), F.lit(NEVER)))
            .withColumn("_c2", F.lit(0).cast("bigint")).withColumn("_c3", F.lit(0)))

    def count(r: DataFrame) -> tuple[DataFrame, list | None, int]:
        cells = r.groupBy(spec.station, *CELL).agg(F.count(F.lit(1)).alias("n"))
        held = cells.limit(BROADCAST_ROWS + 1).collect()
        if len(held) <= BROADCAST_ROWS:
            return cells, held, max((c["n"] for c in held), default=0)
        return cells, None, cells.agg(F.max("n")).first()[0]

    cells, held, most = count(rows)
    if most > limit:                            # steps with too many rows: a cell for each TIMESTAMP
        dense = cells.filter(F.col("n") > limit).select(spec.station, "_c1", F.lit(True).alias("_dense"))
        rows = _match(rows, dense, spec.station, ["_c1"], head["n"] // limit <= BROADCAST_ROWS, "left")
        micros = F.coalesce((F.col("_sec") * 1_000_000).cast("bigint"), F.lit(0))
        rows = rows.withColumn("_c2", F.when(F.col("_dense"), micros).otherwise(F.lit(0))).drop("_dense")
        cells, held, most = count(rows)
        if most > limit and spec.tie and isinstance(df.schema[spec.tie].dataType, T.NumericType):
            # bursts: parts of the tie-break. The quantiles are written, since a sketch isn't the same twice
            ensure_checkpoint_dir(df.sparkSession)
            burst = cells.filter(F.col("n") > limit).select(spec.station, "_c1", "_c2", F.lit(True).alias("_burst"))
            few = head["n"] // limit <= BROADCAST_ROWS
            parts = -(-4 * most // chunk_rows)
            bounds = (_match(rows, burst, spec.station, ["_c1", "_c2"], few, "inner")
                      .groupBy(spec.station, "_c1", "_c2")
                      .agg(F.percentile_approx(spec.tie, [k / parts for k in range(1, parts)], 100 * parts).alias("_bounds"))
                      .checkpoint(eager=True))
            rows = _match(rows, bounds, spec.station, ["_c1", "_c2"], few, "left")
            above = F.size(F.filter("_bounds", lambda b: b < F.col(spec.tie)))
            rows = rows.withColumn("_c3", F.when(F.col("_bounds").isNotNull() & F.col(spec.tie).isNotNull(), above)
                                   .when(F.col("_bounds").isNotNull(), F.lit(parts)).otherwise(F.lit(0))).drop("_bounds")
            cells, held, _ = count(rows)
    return rows.drop("_sec"), cells, held


def _seconds(interval: Column) -> Column:
    return interval.cast("interval second").cast("decimal(24, 6)")


def with_global_index(df: DataFrame, spec: PanelSpec, index_col: str = "_g") -> DataFrame:
    """Exact 0-based rank of every row in series order (a total order if the spec's tie-break
    is unique): the rows of all cells before (one running sum over the cell table) and the
    row's place in its cell."""
    rows, cells, held = with_cells(df, spec, int(spec.chunk_rows))
    before = Window.orderBy(F.col(spec.station).asc_nulls_last(), *CELL).rowsBetween(Window.unboundedPreceding, -1)   # over cells
    starts = cells.select(spec.station, *CELL, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(spec.station, *CELL).orderBy(*order_columns(spec)[1:])
    return (_match(rows, starts, spec.station, CELL, held is not None, "inner")
            .withColumn(index_col, F.col("_start") + F.row_number().over(own) - 1).drop("_start", *CELL))


def chunk_table(cells: DataFrame, spec: PanelSpec, chunk_rows: int, back: int, fwd: int, held: list | None = None) -> DataFrame:
    """(station, cell, _home, _prev, _next): the chunk of each cell, and whether the chunk before and
    the one after read it. ``held``: the cells' rows, if few.

    Chunk k takes the cells that start in rows [k, k + 1) x chunk_rows of their station. No
    cell holds more than half a chunk (bursts with a repeated tie-break aside), so every
    chunk but a station's last has at least that many rows, and halos reach no further than
    the neighbours."""
    if held is not None:
        schema = T.StructType([cells.schema[c] for c in (spec.station, *CELL)] + [
            T.StructField("_home", T.LongType()), T.StructField("_prev", T.BooleanType()), T.StructField("_next", T.BooleanType())])
        return cells.sparkSession.createDataFrame(deal_cells([tuple(c) for c in held], chunk_rows, back, fwd), schema)
    along = Window.partitionBy(spec.station).orderBy(*CELL)              # over cells, not rows
    upto = F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0))
    cells = (cells.withColumn("_end", upto).withColumn("_start", F.col("_end") - F.col("n"))
             .withColumn("_home", F.floor(F.col("_start") / chunk_rows)))
    whole, chunk = Window.partitionBy(spec.station), Window.partitionBy(spec.station, "_home")
    cells = (cells.withColumn("_first", F.min("_start").over(chunk)).withColumn("_stop", F.max("_end").over(chunk))
             .withColumn("_high", F.max("_home").over(whole)))
    return cells.select(spec.station, *CELL, "_home",
                        ((F.col("_start") < F.col("_first") + fwd) & (F.col("_home") > 0)).alias("_prev"),
                        ((F.col("_end") > F.col("_stop") - back) & (F.col("_home") < F.col("_high"))).alias("_next"))


def deal_cells(cells: list[tuple], chunk_rows: int, back: int, fwd: int) -> list[tuple]:
    """The same for cells (station, c1, c2, c3, n) on the driver."""
    out: list[tuple] = []
    for station, own in groupby(sorted(cells, key=lambda c: (c[0] is None, c[0] or "", *c[1:4])), key=lambda c: c[0]):
        start, placed = 0, []
        for c in own:
            placed.append((c, start, start + c[4], start // chunk_rows))
            start += c[4]
        first, stop = {}, {}
        for _, lo, hi, home in placed:
            first.setdefault(home, lo)
            stop[home] = hi
        for c, lo, hi, home in placed:
            out.append((*c[:4], home, lo < first[home] + fwd and home > 0, hi > stop[home] - back and home < placed[-1][3]))
    return out


def plain_window(spec: PanelSpec) -> WindowSpec:
    """Reference form: one window partition per station."""
    return Window.partitionBy(spec.station).orderBy(*order_columns(spec)[1:])


def over_series(df: DataFrame, spec: PanelSpec,
                build: Callable[[WindowSpec], dict[str, Column]],
                back: int, fwd: int, method: str = "chunked",
                prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add the columns returned by ``build(w)`` where ``w`` orders each
    station's rows. ``back`` / ``fwd`` bound how many rows before / after the
    current one any expression reads. Rows with a NULL station get NULL
    (pandas drops NaN group keys; Spark would group them). ``prepare`` is
    applied to the rows just before the window stage, e.g. to join narrow per-row
    context."""
    guard = F.col(spec.station).isNotNull()
    synthetic = spec.tie is None
    if synthetic:
        # No tie column: number rows in scan order before any shuffle. The order key
        # becomes unique, so a burst of equal (station, TIMESTAMP) keys can be split, and
        # duplicates keep the order Spark scans them in: that of a file's rows, and of
        # the scan's partitions where there are several files.
        df = df.withColumn(_TIE, F.monotonically_increasing_id())
        spec = spec.with_(tie=_TIE)
    if method == "plain":
        src = prepare(df) if prepare else df
        exprs = build(plain_window(spec))
        out = src.select("*", *[F.when(guard, e).alias(name) for name, e in exprs.items()])
        return out.drop(_TIE) if synthetic else out
    if method != "chunked":
        raise ValueError(method)

    if int(spec.chunk_rows) <= max(back, fwd):
        raise ValueError(f"chunk_rows={spec.chunk_rows} must exceed halo sizes back={back}, fwd={fwd}")
    size = max(int(spec.chunk_rows), 2 * max(back, fwd))
    rows, cells, held = with_cells(df, spec, size)
    if prepare:
        rows = prepare(rows)
    targets = F.array_compact(F.array(F.when(F.col("_prev"), F.col("_home") - 1), F.col("_home"), F.when(F.col("_next"), F.col("_home") + 1)))
    spread = (_match(rows, chunk_table(cells, spec, size, back, fwd, held), spec.station, CELL, held is not None, "inner")
              .withColumn("_chunk", F.explode(targets)).drop("_prev", "_next", *CELL))
    w = Window.partitionBy(spec.station, "_chunk").orderBy(*order_columns(spec)[1:])
    exprs = build(w)
    out = spread.select("*", *[F.when(guard, e).alias(name) for name, e in exprs.items()])
    out = out.filter(F.col("_chunk") == F.col("_home")).drop("_home", "_chunk")
    return out.drop(_TIE) if synthetic else out


# --- window expressions (W1-W5 and the trailing sums) -----------------------

def forward_sum(col: str, k: int, w: WindowSpec) -> Column:
    """Sum of the next k rows, current row excluded; missing if any of
    the k steps is missing or the series ends first."""
    f = w.rowsBetween(1, k)
    return F.when(F.count(F.col(col)).over(f) == k, F.sum(F.col(col)).over(f))


def trailing_sum(col: str, k: int, w: WindowSpec) -> Column:
    """Sum of the last k rows including the current one, null-strict."""
    f = w.rowsBetween(-(k - 1), 0)
    return F.when(F.count(F.col(col)).over(f) == k, F.sum(F.col(col)).over(f))


def rolling_mean(col: str, n: int, w: WindowSpec) -> Column:
    """Pandas ``rolling(n).mean()`` (full window of non-missing values)."""
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(F.col(col)).over(f) == n, F.avg(F.col(col)).over(f))


def rolling_std(col: str, n: int, w: WindowSpec) -> Column:
    """Pandas ``rolling(n).std()`` (sample std, full window)."""
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(F.col(col)).over(f) == n, F.stddev_samp(F.col(col)).over(f))
