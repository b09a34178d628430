"""Operator 11: prefix trie of conversations from padded turn-id matrices.

A turn's id is a 128-bit hash of its role and text; a conversation is its row of ids.
Rows longer than ``WIDTH`` turns continue in further segments, whose first key is a hash
of all turns before, so a long conversation is many short rows. Rows are range-partitioned
into shards in order of (segment, key, ids, conv_id): equal prefixes lie side by side,
whatever a hot one holds, and equal conversations split between shards.

A shard is a padded matrix of turn ids. ``numpy.lexsort`` orders it, the OR of the changes
from row to row over the columns so far marks where the nodes of each depth start, and
``reduceat`` aggregates the rows of every node, one depth at a time. What a row adds to the
subtrees above it is known beforehand: a turn that continues another row's node saves its
bytes, a row that no later row continues is a leaf. A node on a shard's first or last row
may go on in the neighbouring shard; how far the rows on both sides of an edge agree tells
which, and those boundary nodes (at most two per depth and shard) recombine by their prefix
hash, streamed in shard order.

``rebuild`` joins nothing but the first turns of each fifth conversation (8 at most) with
the ids of its family; turns are numbered through range partitions, not per conversation.

Defined cases
-------------
* rows with a null conv_id belong to no conversation and go; a null role or text is empty;
* equal turn numbers: by the hash of role and text; rows that repeat are turns each;
* c - c%5 keeps the sign of the remainder (SQL's): the family of -3 is 0;
* a conversation without turns is a member of the root; the root is there if any is;
* hashes of 128 bits stand for turns and prefixes;
* an empty table returns an empty table; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

#: Turns of a segment; rows of a shard.
WIDTH, ROWS = 128, 1 << 15
#: Fixed values of the contract: conversations of a family, turns that may be borrowed.
FAMILY, BORROWED = 5, 9
#: Hash of no conversation: SHA-256 of the empty string.
NOBODY = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, tid, bytes) of every row; ``tid`` tells role and text apart."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("tid"),
        F.octet_length(text).cast("long").alias("bytes"))


def rebuild(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, sec, ord, tid, bytes, skip): borrowed turns (sec 0), own turns (sec 1, the
    first ``skip`` of which go), and one row without a turn for each conversation (sec -1)."""
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    heir = F.col("conv_id") % FAMILY != 0
    borrowed = F.when(heir, F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED).otherwise(0).cast("int")
    ids = turns.select("conv_id").distinct()
    first = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "tid")
    head = (turns.filter(~heir).withColumn("j", F.row_number().over(first)).filter(F.col("j") < BORROWED)
            .select(F.col("conv_id").alias("base"), F.col("j").cast("long").alias("ord"), "tid", "bytes"))
    lent = (ids.filter(heir).select("conv_id", family.alias("base"), borrowed.alias("skip")).join(head, "base")
            .filter(F.col("ord") <= F.col("skip")))
    cols = ["conv_id", "sec", "ord", "tid", "bytes", "skip"]
    return (turns.select("conv_id", F.lit(1).alias("sec"), F.col("turn").alias("ord"), "tid", "bytes", borrowed.alias("skip"))
            .unionByName(lent.select("conv_id", F.lit(0).alias("sec"), *cols[2:]))
            .unionByName(ids.select("conv_id", F.lit(-1).alias("sec"), F.lit(None).cast("long").alias("ord"),
                                    F.lit(None).cast("binary").alias("tid"), F.lit(0).cast("long").alias("bytes"),
                                    F.lit(0).alias("skip"))))


def _carried(tagged: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Per range partition: its first key and how many of that key's rows lie in earlier partitions."""
    key = F.struct(*keys)
    per = (tagged.groupBy("_part", key.alias("k")).agg(F.count(F.lit(1)).alias("n")).groupBy("_part")
           .agg(F.min("k").alias("first"), F.max("k").alias("last"), F.max_by("n", "k").alias("n")))
    upto = per.withColumn("s", F.sum("n").over(Window.partitionBy("last").orderBy("_part")))
    before = Window.orderBy("_part")                              # one row per range partition
    return upto.select("_part", F.col("first").alias(f"{name}_first"), F.when(
        F.lag("last").over(before) == F.col("first"), F.lag("s").over(before)).otherwise(0).alias(f"{name}_carry"))


def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, tid, bytes): the rebuilt conversations' turns from 1, and a row at 0 for each.

    A conversation may span range partitions: its rows are numbered inside each and go on
    from the count of its rows before. Equal rows are dealt by their place in the scan."""
    order = [F.col("conv_id"), F.col("sec"), F.asc_nulls_first("ord"), F.col("tid"), F.col("_deal")]
    tagged = cut(rows.withColumn("_deal", F.xxhash64(F.monotonically_increasing_id()))
                 .repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    carry = _carried(tagged, ["conv_id"], "c").join(_carried(tagged, ["conv_id", "sec"], "s"), "_part")
    inside = Window.partitionBy("_part", "conv_id").orderBy("_row")
    own = Window.partitionBy("_part", "conv_id", "sec").orderBy("_row")
    nth = F.row_number().over(inside) + F.when(F.col("c_first.conv_id") == F.col("conv_id"), F.col("c_carry")).otherwise(0)
    nth_own = F.row_number().over(own) + F.when(F.col("s_first") == F.struct("conv_id", "sec"), F.col("s_carry")).otherwise(0)
    return (tagged.join(F.broadcast(carry), "_part").withColumn("nth", nth).withColumn("nth_own", nth_own)
            .filter((F.col("sec") < 1) | (F.col("nth_own") > F.col("skip")))
            .select("conv_id", (F.col("nth") - 1 - F.when(F.col("sec") == 1, F.col("skip")).otherwise(0)).alias("pos"),
                    "tid", "bytes"))


def segments(turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per conversation and ``width`` turns: seg, key before (p1, p2) and after (q1, q2),
    ids (16 bytes a turn), sizes, ``goes_on`` if another segment follows."""
    seg = F.when(F.col("pos") == 0, 0).otherwise(F.expr(f"(pos - 1) div {width}"))
    mixed = [F.when(F.col("pos") > 0, F.xxhash64(F.lit(salt), "pos", "tid")).otherwise(0) for salt in (1, 2)]
    rows = (turns.withColumn("seg", seg.cast("long")).groupBy("conv_id", "seg").agg(
        F.array_sort(F.collect_list(F.when(F.col("pos") > 0, F.struct("pos", "tid", "bytes")))).alias("t"),
        F.bit_xor(mixed[0]).alias("x1"), F.bit_xor(mixed[1]).alias("x2")))
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    upto = rows.withColumn("q1", F.bit_xor("x1").over(before)).withColumn("q2", F.bit_xor("x2").over(before))
    return upto.select(
        "conv_id", "seg", F.col("q1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("q2").bitwiseXOR(F.col("x2")).alias("p2"),
        "q1", "q2", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["tid"])), "")).alias("ids"),
        F.transform("t", lambda x: x["bytes"]).alias("sizes"),
        F.lead("seg").over(Window.partitionBy("conv_id").orderBy("seg")).isNotNull().alias("goes_on"))


ORDER = ["seg", "p1", "p2", "ids", "goes_on", "conv_id"]


def shards(rows: DataFrame, per_shard: int = ROWS) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """Range-partitioned copy with its shard number, and for every shard how many columns
    (the key is the first) its first row shares with the row before it and its last with the row
    after: two numbers per shard reach the driver."""
    rows = cut(rows)
    n = max(shuffle_partitions(rows.sparkSession), -(-rows.count() // per_shard))
    dealt = cut(rows.repartitionByRange(n, *ORDER).withColumn("part", F.spark_partition_id()))
    edge = F.struct(*ORDER)
    ends = (dealt.groupBy("part").agg(F.min(edge).alias("lo"), F.max(edge).alias("hi")).orderBy("part").coalesce(1)
            .select("part", *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("lo", "hi") for c in ORDER[:4]]))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out = []
            for r in b.to_pylist():
                lo, hi = [[r[f"{e}_{c}"] for c in ORDER[:4]] for e in ("lo", "hi")]
                same = 0
                if last is not None and last[:3] == lo[:3]:
                    same, a, z = 1, last[3], lo[3]
                    while 16 * same <= min(len(a), len(z)) and a[16 * same - 16:16 * same] == z[16 * same - 16:16 * same]:
                        same += 1
                out.append((r["part"], same))
                last = hi
            yield pa.RecordBatch.from_pylist([{"part": p, "same": s} for p, s in out],
                                             pa.schema([("part", pa.int32()), ("same", pa.int32())]))

    before = [(r["part"], r["same"]) for r in ends.mapInArrow(shared, "part int, same int").collect()]
    before.sort()
    after = [s for _, s in before[1:]] + [0]
    return dealt, {p: (s, t) for (p, s), t in zip(before, after)}


class Matrix:
    """A shard: sorted padded ids, change masks, what each row adds to the subtrees above."""

    def __init__(self, t: pa.Table, same: tuple[int, int]):
        self.same = same
        raw = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (t.column("ids"), t.column("sizes"))]
        ids = np.frombuffer(b"".join(raw[0].to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
        length = raw[1].value_lengths().to_numpy().astype(np.int64)
        n, width = len(length), int(length.max())
        dense = np.zeros(len(ids), np.int32)                     # numbers in the order of the hashes
        if len(ids):
            by = np.lexsort((ids[:, 1], ids[:, 0]))
            dense[by] = np.cumsum(np.concatenate(([0], (ids[by][1:] != ids[by][:-1]).any(axis=1))))
        row = np.repeat(np.arange(n), length)
        col = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        matrix = np.full((n, width), -1, np.int32)
        matrix[row, col] = dense
        size = np.zeros((n, width), np.int64)
        size[row, col] = raw[1].flatten().to_numpy()
        keys = [t.column(c).to_numpy() for c in ("seg", "p1", "p2")]
        conv, goes_on = t.column("conv_id").to_numpy(), t.column("goes_on").to_numpy()
        order = np.lexsort((conv, goes_on, *matrix.T[::-1], *keys[::-1]))
        self.order, self.n, self.width = order, n, width
        self.ids, self.length, self.conv, self.goes_on = matrix[order], length[order], conv[order], goes_on[order]
        self.keys = [k[order] for k in keys]
        # change[i, j]: row i starts a node at column j (column 0: the key, that is the node before the first id)
        change = np.ones((n, width + 1), bool)
        change[1:, 0] = np.logical_or.reduce([k[1:] != k[:-1] for k in self.keys])
        change[1:, 1:] = self.ids[1:] != self.ids[:-1]
        np.logical_or.accumulate(change, axis=1, out=change)
        self.change = change
        # the first row goes on with nodes of the shard before
        self.new = change.copy()
        self.new[0, :min(same[0], width + 1)] = False
        self.new[:, 1:] &= self.ids >= 0
        self.saved = np.where(self.new[:, 1:], 0, size[order])   # bytes of turns another row has as well
        # columns a row shares with the next: its length + 1 means the next row equals or continues it
        nxt = np.where(change[1:].any(axis=1), change[1:].argmax(axis=1), width + 1)
        nxt = np.append(nxt, same[1])
        self.leaf = (~self.goes_on & (nxt < self.length + 1)).astype(np.int64)

    def prefix(self, row: int, j: int, turns: bytes) -> bytes:
        own = ",".join(str(int(k[row])) for k in self.keys).encode()
        return hashlib.md5(own + b"|" + turns[:16 * j]).digest()


def shard_totals(rows: DataFrame, same: dict[int, tuple[int, int]]) -> DataFrame:
    """(conv_id, seg, leaves, saved) that each row adds to the subtrees above its segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            m = Matrix(t, same[t.column("part")[0].as_py()])
            yield pa.RecordBatch.from_arrays([pa.array(m.conv), pa.array(m.keys[0]), pa.array(m.leaf),
                                              pa.array(m.saved.sum(axis=1))], names=["conv_id", "seg", "leaves", "saved"])

    return rows.mapInArrow(run, "conv_id long, seg long, leaves long, saved long")


NODES = pa.schema([("part", pa.int32()), ("seg", pa.int64()), ("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                   ("node", pa.binary()), ("above", pa.binary()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
                   ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                   ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("ends", pa.list_(pa.int64()))])
NODE = ("part int, seg long, depth long, k1 long, k2 long, node binary, above binary, conv_id long, parent_conv_id long, "
        "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends array<long>")


def shard_nodes(rows: DataFrame, same: dict[int, tuple[int, int]], width: int = WIDTH) -> DataFrame:
    """Nodes of every shard. ``node`` names one that may go on in another shard (``ends`` then
    holds its members that end there), ``above`` such a parent. k1, k2 link segments: the
    key of a node at column 0 and of the node at a whole segment's last column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        part = t.column("part")[0].as_py()
        m = Matrix(t, same[part])
        turns = {r: t.column("ids")[int(m.order[r])].as_py() for r in (0, m.n - 1)}
        below, leaves = t.column("below_saved").to_numpy()[m.order], m.leaf + t.column("below_leaves").to_numpy()[m.order]
        after = [t.column(c).to_numpy()[m.order] for c in ("q1", "q2")]
        # bytes saved from column j to the end of the conversation
        suffix = np.zeros((m.n, m.width + 1), np.int64)
        if m.width:
            suffix[:, 1:] = np.cumsum(m.saved[:, ::-1], axis=1)[:, ::-1]
            suffix[:, 0] = suffix[:, 1]
        suffix += below[:, None]
        ups, lows, up_edge = None, None, None                    # of the column before
        for j in range(m.width + 1):
            start = np.flatnonzero(m.change[:, j])
            low = np.minimum.reduceat(m.conv, start)
            stop = np.append(start[1:], m.n)
            goes = (start == 0) & (j < m.same[0]) | (stop == m.n) & (j < m.same[1])
            valid = np.ones(len(start), bool) if j == 0 else m.ids[start, j - 1] >= 0
            kids = np.add.reduceat(m.new[:, j + 1].astype(np.int64), start) if j < m.width else np.zeros(len(start), np.int64)
            done = np.add.reduceat(((m.length == j) & ~m.goes_on).astype(np.int64), start)
            n_leaves, saved = np.add.reduceat(leaves, start), np.add.reduceat(suffix[:, j], start)
            up = np.searchsorted(ups, start, side="right") - 1 if j else np.zeros(len(start), np.int64)
            out = []
            for g in np.flatnonzero(valid):
                a, e = int(start[g]), int(stop[g])
                edge = turns[0] if a == 0 else turns[m.n - 1]
                ended = m.conv[a:a + int(done[g])].tolist()
                link = [int(k[a]) for k in m.keys[1:]] if j <= 1 else [int(q[a]) for q in after] if j == width else [None, None]
                out.append((part, int(m.keys[0][a]), int(m.keys[0][a]) * width + j, *link,
                            m.prefix(a, j, edge) if goes[g] else None,
                            m.prefix(a, j - 1, turns[0] if ups[up[g]] == 0 else turns[m.n - 1]) if j and up_edge[up[g]] else None,
                            int(low[g]), int(lows[up[g]]) if j and not up_edge[up[g]] else None, e - a, int(kids[g]),
                            int(n_leaves[g]), int(saved[g]),
                            None if goes[g] else hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest() if ended else NOBODY,
                            ended if goes[g] else None))
            ups, lows, up_edge = start, low, goes
            for at in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at:at + 10_000]), NODES)],
                                                 schema=NODES)

    return rows.mapInArrow(run, NODE)


def recombine(pieces: DataFrame) -> DataFrame:
    """Boundary nodes from their pieces, streamed in (node, part) order: sums, smallest
    member, and one running hash over the members that end in it. A node has at most one piece a shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, any_ = None, None, False
        for b in batches:
            out = []
            for r in b.to_pylist():
                if now is None or now["node"] != r["node"]:
                    if now is not None:
                        out.append({**now, "ends_sha256": sha.hexdigest()})
                    now, sha, any_ = {**r, "ends": None}, hashlib.sha256(), False
                else:
                    for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                        now[c] += r[c]
                    now["conv_id"] = min(now["conv_id"], r["conv_id"])
                    now["above"] = now["above"] or r["above"]
                if r["ends"]:
                    sha.update((("," if any_ else "") + ",".join(map(str, r["ends"]))).encode())
                    any_ = True
            yield pa.RecordBatch.from_pylist(out, b.schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{**now, "ends_sha256": sha.hexdigest()}], b.schema)

    return pieces.repartition("node").sortWithinPartitions("node", "part").mapInArrow(run, NODE)


def trie(turns: DataFrame, width: int = WIDTH, per_shard: int = ROWS) -> DataFrame:
    """Nodes of the trie of numbered conversations (conv_id, pos, tid, bytes; a row at pos 0 each)."""
    segs = cut(segments(turns, width))
    # what the later segments of a conversation add to the subtrees of the earlier ones
    later, same = shards(segs.filter("seg > 0"), per_shard)
    added = shard_totals(later, same)
    behind = Window.partitionBy("conv_id").orderBy(F.desc("seg"))
    below = added.select("conv_id", (F.col("seg") - 1).alias("seg"), F.sum("leaves").over(behind).alias("below_leaves"),
                         F.sum("saved").over(behind).alias("below_saved"))
    rows, same = shards(segs.filter("not goes_on").withColumn("below_leaves", F.lit(0).cast("long"))
                        .withColumn("below_saved", F.lit(0).cast("long"))
                        .unionByName(segs.filter("goes_on").join(below, ["conv_id", "seg"])), per_shard)
    nodes = cut(shard_nodes(rows, same, width))
    pieces = nodes.filter("node is not null")
    edge = cut(recombine(pieces))
    # parents on a boundary: each shard looks its own up, so a hot parent's children stay spread
    known = (pieces.select("part", "node").join(edge.select("node", F.col("conv_id").alias("top")), "node")
             .withColumnRenamed("node", "above"))
    inner = nodes.filter("node is null").join(known, ["part", "above"], "left")
    outer = edge.join(edge.select(F.col("node").alias("above"), F.col("conv_id").alias("top")), "above", "left")
    cols = ["seg", "depth", "k1", "k2", "conv_id", F.coalesce("parent_conv_id", "top").alias("parent_conv_id"), "n_convs",
            "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    every = cut(inner.select(*cols).unionByName(outer.select(*cols)))
    # segments: a node at a whole segment's end has its children in the next one
    in_seg = F.col("depth") - F.col("seg") * width
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    plain = every.filter(((in_seg > 1) | (F.col("seg") == 0)) & (in_seg < width)).select(*names)
    last = every.filter(in_seg == width).withColumn("next", F.col("seg") + 1)
    heads = every.filter((in_seg == 0) & (F.col("seg") > 0)).select(F.col("seg").alias("next"), "k1", "k2", F.col("n_children").alias("more"))
    ended = last.join(heads, ["next", "k1", "k2"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    top = last.select(F.col("next").alias("seg"), "k1", "k2", F.col("conv_id").alias("top"))
    begun = (every.filter((in_seg == 1) & (F.col("seg") > 0)).join(top, ["seg", "k1", "k2"]).withColumn("parent_conv_id", F.col("top")))
    return plain.unionByName(ended.select(*names)).unionByName(begun.select(*names))


def op11_conversation_trie(conversations: DataFrame, width: int = WIDTH, per_shard: int = ROWS) -> DataFrame:
    return trie(numbered(rebuild(turns_of(conversations))), width, per_shard)


ORACLE = """
WITH ids AS (
  SELECT c, c - c % 5 AS base, CASE WHEN c % 5 = 0 THEN 0 ELSE xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                 lambda v, step: xor(v >> 1, (v & 1) * 3988292384)))) % 9 END AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)),
own AS (
  SELECT conv_id AS c, list({'r': r, 't': t} ORDER BY turn NULLS FIRST, md5(strlen(r) || ':' || r || t)) AS turns
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations) GROUP BY conv_id),
rebuilt AS (
  SELECT ids.c, list_concat(coalesce(lent.turns[1:h], []), coalesce(own.turns[h + 1:], [])) AS s
  FROM ids JOIN own ON own.c = ids.c LEFT JOIN own AS lent ON lent.c = ids.base),
steps AS (SELECT c, len(s) AS n, unnest(range(0, len(s) + 1)) AS d, s FROM rebuilt),
nodes AS (
  SELECT s[1:d] AS p, d, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = n), '')) AS ends_sha256
  FROM steps GROUP BY ALL),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
own_part AS (
  SELECT p, d, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf,
         CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(p[d].t) END AS saved
  FROM nodes LEFT JOIN kids USING (p)),
subtree AS (
  SELECT p[1:a] AS p, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT p, leaf, saved, unnest(range(0, d + 1)) AS a FROM own_part) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtree USING (p) LEFT JOIN kids USING (p) LEFT JOIN nodes up ON n.d > 0 AND up.p = n.p[1:n.d - 1]
"""
