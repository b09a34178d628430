"""Operator 5: line dedup by range-partitioned line hashes (native).

Every line becomes a narrow row (128-bit hash of its key, document, position).
Rows go to equal-width ranges of the hash space (hashes are uniform, so ranges
need no sampling), with a salt made from the document so that one very common
line is spread over ``SALTS`` groups; inside a range they are sorted by hash,
document and position and streamed: the first row of a hash in a document counts
that document once, and the first document counts as the line's first
occurrence. What comes back is one compressed bitmap of dropped lines per
document (only non-zero 64-bit words), never text.

Defined cases
-------------
* null or empty text: one empty line, whose key is empty and never dropped;
* a document is a ``doc_id`` (null counts as one id); rows that repeat a
  (doc_id, text) pair get the same decisions, and each returns its own row;
* lines whose key is shorter than ``min_key`` code points always stay;
* very long texts only make more narrow rows; one document's bitmap has one
  word per 64 lines;
* an empty table returns an empty table; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, shuffle_partitions

#: Groups over which the rows of one line hash are spread (a power of two).
SALTS = 16


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _text_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_rows(docs: DataFrame, min_key: int = 1) -> DataFrame:
    """(h1, h2, salt, doc, tid, pos): one narrow row per line with a key."""
    d = docs.select(F.col("doc_id").alias("doc"), _text_id(F.col("text")).alias("tid"),
                    F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    d = d.select("doc", "tid", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_key)
    return d.select(F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"),
                    F.xxhash64("doc").bitwiseAND(SALTS - 1).cast("int").alias("salt"), "doc", "tid", "pos")


def _ranged(rows: DataFrame) -> DataFrame:
    """Equal-width ranges of the hash space, then the salt inside a range."""
    n = shuffle_partitions(rows.sparkSession)
    width = F.lit(2.0 ** 64 / n)
    zone = F.least(F.lit(n - 1), F.floor((F.col("h1").cast("double") + F.lit(2.0 ** 63)) / width)).cast("int")
    # the salt shifts a hash's range, so that its salted groups lie in different tasks
    return rows.withColumn("zone", F.pmod(zone + F.col("salt"), F.lit(n))).repartitionById(n, F.col("zone"))


def drop_bitmaps(docs: DataFrame, min_docs: int = 10, min_key: int = 1, keep: str = "none") -> DataFrame:
    """(doc, tid, n_dropped, words): words is an array of (word, bits) with the
    dropped lines; documents that keep every line have no row.

    keep = "none": a key found in at least ``min_docs`` documents loses all its
    lines; keep = "first": it keeps its first occurrence by (doc_id, position)."""
    group = Window.partitionBy("zone", "h1", "h2", "salt").orderBy(F.col("doc").asc_nulls_last(), "tid", "pos")
    rows = _ranged(line_rows(docs, min_key))
    rows = rows.withColumn("nth", F.row_number().over(group)).withColumn("last_doc", F.lag("doc").over(group))
    rows = rows.withColumn("fresh", (F.col("nth") == 1) | ~F.col("doc").eqNullSafe(F.col("last_doc")))
    place = F.struct(F.col("doc").isNull().alias("gone"), "doc", "tid", "pos")
    common = (rows.groupBy("h1", "h2").agg(F.sum(F.col("fresh").cast("long")).alias("n_docs"),
                                           F.min(F.when(F.col("nth") == 1, place)).alias("first"))
              .filter(F.col("n_docs") >= min_docs)
              .select("h1", "h2", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    # few common keys, copied to their salts: no task of the join gets all rows of a hot key
    lost = rows.select("h1", "h2", "salt", "doc", "tid", "pos").join(common, ["h1", "h2", "salt"])
    if keep == "first":
        lost = lost.filter(~F.struct(F.col("doc").isNull().alias("gone"), "doc", "tid", "pos").eqNullSafe(F.col("first")))
    elif keep != "none":
        raise ValueError(keep)
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    words = (lost.groupBy("doc", "tid", F.floor(F.col("pos") / 64).cast("int").alias("word"))
             .agg(F.bit_or(bit).alias("bits")))
    return words.groupBy("doc", "tid").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
                                           F.collect_list(F.struct("word", "bits")).alias("words"))


def _kept_lines(lines: Column, words: Column) -> Column:
    """The lines whose bit is not set. The sparse words become one dense array
    first, so that each line needs one look-up."""
    dense = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 64).cast("int")),
                        lambda w: F.coalesce(F.element_at(F.map_from_entries(words), w), F.lit(0).cast("long")))
    with_dense = F.transform(F.array(dense), lambda d: F.filter(
        lines, lambda line, i: F.get(d, F.floor(i / 64).cast("int")).bitwiseAND(
            F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(i, F.lit(64)).cast("int"))) == 0))
    return F.when(words.isNull(), lines).otherwise(with_dense[0])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(d, n_lines, n_dropped, kept): d is the whole input row as a struct."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"), docs["doc_id"].alias("doc"),
                       _text_id(docs["text"]).alias("tid"))
    b = bitmaps.select(F.col("doc").alias("b_doc"), F.col("tid").alias("b_tid"), "n_dropped", "words")
    rows = rows.join(b, rows["doc"].eqNullSafe(b["b_doc"]) & (rows["tid"] == b["b_tid"]), "left")
    lines = text_lines(F.col("d.text"))
    return rows.select("d", F.size(lines).cast("long").alias("n_lines"),
                       F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
                       F.array_join(_kept_lines(lines, F.col("words")), "\n").alias("kept"))


def op5_line_dedup(docs: DataFrame, min_docs: int = 10, min_key: int = 1, keep: str = "none") -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    need = docs.select("doc_id", "text")
    out = apply_bitmaps(need, drop_bitmaps(need, min_docs, min_key, keep))
    return out.select("d.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def stage_line_dedup(docs: DataFrame, min_docs: int = 10, min_key: int = 1) -> DataFrame:
    """The documents without their common lines; same columns, n_chars (if
    there) is that of the shortened text. A null text stays null."""
    out = apply_bitmaps(docs, drop_bitmaps(docs.select("doc_id", "text"), min_docs, min_key))
    cols = []
    for c in docs.columns:
        value = F.col(f"d.`{c}`")
        if c == "text":
            value = F.when(value.isNotNull(), F.col("kept"))
        elif c == "n_chars":
            value = F.when(F.col("n_dropped") > 0, F.char_length("kept").cast(docs.schema[c].dataType)).otherwise(value)
        cols.append(value.alias(c))
    return out.select(*cols)


ORACLE = r"""
WITH l AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (
  SELECT rid, doc_id, lines, list_transform(lines, lambda s: translate(
    trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys FROM l),
p AS (SELECT rid, doc_id, unnest(lines) AS line, unnest(keys) AS key, generate_subscripts(lines, 1) AS pos FROM k),
c AS (SELECT key FROM p WHERE length(key) >= 1 GROUP BY key
      HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
       CAST(count(*) FILTER (WHERE c.key IS NOT NULL) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM p LEFT JOIN c ON p.key = c.key GROUP BY rid
"""
