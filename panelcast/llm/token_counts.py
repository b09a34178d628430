"""Operator 8: token counts by a separator scan of flat token files.

A flat token file is a row of little-endian ids without any index; documents end
with an end-of-document id. Files are read as blocks (file, block, data). Each
block is searched on its own, all ids at once, and returns the lengths between
its separators and the loose ends before the first and after the last. A prefix
scan over the blocks of a file (zones of blocks first, then inside the zones)
gives every block the number of documents before it and the length that is still
open, which joins the ends; no task holds a file.

``write_stream`` makes such files of a documents table: each scan partition is
one file, kept as a table of blocks in the shared folder, and beside it the
order of the documents, with which the query names what it has counted.

Defined cases
-------------
* null and empty texts are documents of 0 tokens; the separator isn't counted;
* a document may span any number of blocks; ids after a file's last separator
  are one more document, marked as open;
* repeated rows and null doc_ids are documents like any other;
* an empty table returns an empty table; other columns are never looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir
from .packing import CHUNK
from .tokens import END, RANKS, encode_texts, read_ranks

#: Ids in a block, blocks in a zone of the prefix scan.
BLOCK, ZONE = 1 << 18, 1024
KIND = "<u2"


def write_stream(docs: DataFrame, path: str, block: int = BLOCK, vocabulary: str = RANKS) -> None:
    """Tokenise documents to flat files (file, block, data) under ``path`` and
    their order (file, first, doc_ids) in the same table (data is null there)."""
    ranks = read_ranks(vocabulary)
    schema = "file int, block long, data binary, first long, doc_ids array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        file, nth, seen = TaskContext.get().partitionId(), 0, 0
        rest = np.zeros(0, KIND)

        def row(data=None, first=None, ids=None):
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([nth if data is not None else None], pa.int64()),
                 pa.array([data], pa.binary()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64()))],
                names=["file", "block", "data", "first", "doc_ids"])

        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < b.num_rows:
                hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), CHUNK, side="right")))
                some = b.slice(lo, hi - lo)
                ids, off = encode_texts(some.column(1).to_pylist(), ranks)
                rest = np.concatenate((rest, np.insert(ids, off[1:], END).astype(KIND)))
                yield row(None, seen, some.column(0).to_pylist())
                seen += some.num_rows
                while len(rest) >= block:
                    yield row(rest[:block].tobytes())
                    rest, nth = rest[block:], nth + 1
                lo = hi
        if len(rest):
            yield row(rest.tobytes())

    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema).write.parquet(path)


def read_flat_files(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Blocks (file, block, data) of raw flat files, any store that Spark reads."""
    width = np.dtype(KIND).itemsize * block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for n, at in enumerate(range(0, len(data), width)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([data[at:at + width]])],
                                                     names=["file", "block", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, data binary")


def scan_blocks(blocks: DataFrame, end: int = END) -> DataFrame:
    """(file, block, n_ids, n_ends, head, tail, inner, begin): one row per block.
    head: ids up to and with the first separator; tail: ids after the last one;
    inner, begin: lengths (without separators) and places of the documents between."""
    schema = (f"file {blocks.schema['file'].dataType.simpleString()}, block long, n_ids long, n_ends long, head long, "
              "tail long, inner array<int>, begin array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids = np.frombuffer(b.column(2)[k].as_buffer(), KIND)
                at = np.flatnonzero(ids == end)
                head, tail = (at[0] + 1, len(ids) - at[-1] - 1) if len(at) else (len(ids), len(ids))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(k, 1), b.column(1).slice(k, 1), pa.array([len(ids)], pa.int64()), pa.array([len(at)], pa.int64()),
                     pa.array([int(head)], pa.int64()), pa.array([int(tail)], pa.int64()),
                     pa.array([(np.diff(at) - 1).astype(np.int32)], pa.list_(pa.int32())),
                     pa.array([(at[:-1] + 1).astype(np.int32)], pa.list_(pa.int32()))],
                    names=["file", "block", "n_ids", "n_ends", "head", "tail", "inner", "begin"])

    return blocks.select("file", "block", "data").mapInArrow(run, schema)


def count_tokens(blocks: DataFrame, end: int = END) -> DataFrame:
    """(file, ordinal, start, n_tokens, open) of every document of the files."""
    b = scan_blocks(blocks, end).withColumn("zone", F.floor(F.col("block") / ZONE))
    # an end's place inside the zone, for the scan of "last end so far"
    inside = Window.partitionBy("file", "zone").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    b = (b.withColumn("z_ids", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
         .withColumn("z_ends", F.coalesce(F.sum("n_ends").over(inside), F.lit(0))))
    last = F.when(F.col("n_ends") > 0, F.col("z_ids") + F.col("n_ids") - F.col("tail"))
    b = b.withColumn("last", last).withColumn("z_last", F.max("last").over(inside))
    zones = b.groupBy("file", "zone").agg(F.sum("n_ids").alias("ids"), F.sum("n_ends").alias("ends"), F.max("last").alias("last"))
    over = Window.partitionBy("file").orderBy("zone").rowsBetween(Window.unboundedPreceding, -1)     # one row per zone
    zones = (zones.withColumn("ids_before", F.coalesce(F.sum("ids").over(over), F.lit(0)))
             .withColumn("ends_before", F.coalesce(F.sum("ends").over(over), F.lit(0))))
    zones = zones.withColumn("last_before", F.coalesce(F.max(F.col("ids_before") + F.col("last")).over(over), F.lit(0)))
    final = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("zone"))) == 1
    zones = zones.withColumn("final", final).select("file", "zone", "ids_before", "ends_before", "last_before", "final")
    b = b.join(zones, ["file", "zone"])
    start = F.col("ids_before") + F.col("z_ids")                              # of the block in the file
    open_from = F.coalesce(F.col("ids_before") + F.col("z_last"), F.col("last_before"))
    last_block = F.col("final") & (F.row_number().over(Window.partitionBy("file", "zone").orderBy(F.desc("block"))) == 1)
    b = b.select("file", (F.col("ends_before") + F.col("z_ends")).alias("before"), start.alias("at"), open_from.alias("open_from"),
                 "n_ends", "n_ids", "head", "tail", "inner", "begin", last_block.alias("last_block"))
    doc = lambda at, n, o: F.struct(at.alias("start"), n.cast("long").alias("n_tokens"), F.lit(o).alias("open"))
    first = F.when(F.col("n_ends") > 0, F.array(doc(F.col("open_from"), F.col("at") + F.col("head") - 1 - F.col("open_from"), False)))
    between = F.transform(F.arrays_zip("inner", "begin"), lambda r: doc(F.col("at") + r["begin"], r["inner"], False))
    stop = F.col("at") + F.col("n_ids")
    since = F.when(F.col("n_ends") > 0, stop - F.col("tail")).otherwise(F.col("open_from"))
    loose = F.when(F.col("last_block") & (stop > since), F.array(doc(since, stop - since, True)))
    none = F.array().cast("array<struct<start: bigint, n_tokens: bigint, open: boolean>>")
    every = F.concat(F.coalesce(first, none), between, F.coalesce(loose, none))
    out = b.select("file", "before", F.posexplode(every).alias("nth", "d"))
    return out.select("file", (F.col("before") + F.col("nth")).alias("ordinal"), "d.start", "d.n_tokens", "d.open")


def op8_token_counts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, and where its ids lie: file, ordinal, start."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex[:12]}"
    write_stream(docs.select("doc_id", "text"), path, block)
    stream = spark.read.schema("file int, block long, data binary, first long, doc_ids array<long>").parquet(path)
    counts = count_tokens(stream.filter(F.col("block").isNotNull()))
    order = (stream.filter(F.col("first").isNotNull()).select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id"))
             .select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id"))
    return counts.join(order, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
