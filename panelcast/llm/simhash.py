"""Operator 9: SimHash near-dedup by the generalised pigeonhole.

1. Fingerprints: 64-bit SimHash of word shingles (XXH64, majority of bits).
2. Classes: rows with equal fingerprints are one class, so copies never pair up.
3. Plan: bits that go together are grouped into the same partition, and for
   each number of partitions a dynamic program shares the distance out over them
   (thresholds add up to ``distance - parts + 1``; a partition may get none) so
   that the candidates and probes estimated on a bounded sample are fewest.
4. Probe: each class is posted under its value in every partition and probes the
   values within the partition's threshold. Postings of one value are sorted
   next to each other and compared in numpy blocks. A value with more than
   ``BLOCK`` postings is dealt again by a second pigeonhole over the bits outside the
   partition: of distance + 1 groups of these, two near prints agree in one. What is still
   crowded is split into block pairs, so no task holds more than two blocks. Every pair is verified on the whole fingerprint. A task returns only
   links that join what its earlier links had not joined.
5. Connected components over the links.

Defined cases
-------------
* null or empty texts and texts without words have fingerprint zero, and are
  linked like any other;
* fewer words than a shingle: the whole word sequence is the only shingle;
* a bit set in exactly half of the shingles is 0;
* repeated rows share fingerprint and component; component_id is the smallest
  doc_id that isn't null (null if there is none);
* an empty table returns an empty table; other columns are never looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions
from .graph import connected_components

#: Largest number of postings of one value that are compared in one piece.
BLOCK = 4096
#: Distinct fingerprints from which the plan is estimated.
SAMPLE = 2048
#: A component with more than this part of all classes is large.
HOT = 10_000
#: Shingles hashed at a time.
SLICE = 1 << 16


def simhash(text: str | None, words: int = 4, seed: int = 42) -> int:
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()   # bytes: only A-Z and ASCII white space
    n = len(tokens)
    if n == 0:
        return 0
    joined = b" ".join(tokens)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total, counts = n - words + 1, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, SLICE):
        to = min(total, at + SLICE)
        h = np.array([digest(joined[s:e], seed) for s, e in
                      zip(starts[at:to].tolist(), ends[at + words - 1:to + words - 1].tolist())], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, tie): fp is the fingerprint as a signed long, tie a hash of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_py(), words, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2)], names=["doc_id", "fp", "tie"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    return src.mapInArrow(run, "doc_id long, fp long, tie long")


# --- plan -----------------------------------------------------------------------

def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size; each group takes the bit
    most correlated (in absolute value) with the bits it has."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits ** 2).sum(axis=0))
    corr = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-12)
    free, groups = list(range(64)), []
    for g in range(parts):
        size = 64 // parts + (g < 64 % parts)
        first = max(free, key=lambda b: (corr[b, free].sum(), -b))
        group = [first]
        free.remove(first)
        while len(group) < size:
            nxt = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(nxt)
            free.remove(nxt)
        groups.append(sorted(group))
    return groups


def _ball(width: int, radius: int) -> int:
    size, term = 0, 1
    for r in range(radius + 1):
        size += term
        term = term * (width - r) // (r + 1)
    return size


def make_plan(sample: np.ndarray, n: int, distance: int) -> list[tuple[int, int]]:
    """[(mask, threshold)] with the fewest estimated candidates and probes.
    Partitions with threshold -1 are left out: they are never probed."""
    best: tuple[float, list[tuple[int, int]]] | None = None
    i, j = np.triu_indices(len(sample), 1)
    apart = sample[i] ^ sample[j]
    for parts in range(2, distance + 2):
        masks = [sum(1 << b for b in g) for g in group_bits(sample, parts)]
        cost = []
        for mask in masks:
            width = mask.bit_count()
            seen = np.bincount(_popcount(apart & np.uint64(mask)), minlength=distance + 1)[:distance + 1].cumsum()
            row = {-1: 0.0}
            for t in range(distance + 1):
                chance = max(_ball(width, t) / 2.0 ** width, seen[t] / max(1, len(apart)))
                row[t] = n * (n - 1) / 2 * chance + 4.0 * n * (1 + _ball(width, t))
            cost.append(row)
        need = distance - parts + 1
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}     # sum of (threshold + 1) -> cheapest
        for row in cost:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for got, (c, ts) in table.items():
                for t, extra in row.items():
                    at = got + t + 1
                    if at <= need + parts and (at not in nxt or c + extra < nxt[at][0]):
                        nxt[at] = (c + extra, [*ts, t])
            table = nxt
        c, ts = table[need + parts]
        if best is None or c < best[0]:
            best = (c, [(m, t) for m, t in zip(masks, ts) if t >= 0])
    return best[1]


# --- probe and verify -------------------------------------------------------------

class _Joiner:
    """Union-find over what one task has linked; says whether a link is new."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (nxt := up.get(root, root)) != root:
            root = nxt
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _spanning(fp: np.ndarray, own: np.ndarray, side: np.ndarray, split: bool, distance: int) -> Iterator[tuple[int, int]]:
    """Links of one group of postings, only those that join something new."""
    n = len(fp)
    label = np.arange(n)
    for i in range(1, n):
        near = _popcount(fp[:i] ^ fp[i]) <= distance
        near &= own[:i] | own[i]
        if split:
            near &= side[:i] != side[i]
        if not near.any():
            continue
        hit = np.flatnonzero(near)
        labels, first = np.unique(label[hit], return_index=True)
        for k, lab in zip(first, labels):
            if lab != label[i]:
                yield int(fp[i]), int(fp[hit[k]])
                old, new = max(lab, label[i]), min(lab, label[i])
                label[label == old] = new


def _small_groups(fp: np.ndarray, own: np.ndarray, start: np.ndarray, stop: np.ndarray, distance: int):
    """All verified pairs of many small groups [start, stop) at once."""
    at = np.concatenate([np.arange(s, e) for s, e in zip(start, stop)])
    end = np.repeat(stop, stop - start)
    for d in itertools.count(1):
        more = at + d < end
        at, end = at[more], end[more]
        if not len(at):
            return
        near = (_popcount(fp[at] ^ fp[at + d]) <= distance) & (own[at] | own[at + d])
        for k in at[near].tolist():
            yield int(fp[k]), int(fp[k + d])


def _rest_masks(mask: int, groups: int) -> list[int]:
    """The bits outside ``mask`` dealt to groups, as signed longs."""
    rest = [b for b in range(64) if not mask >> b & 1]
    return np.array([sum(1 << b for b in rest[k::groups]) for k in range(groups)], np.uint64).view(np.int64).tolist()


def find_links(classes: DataFrame, plan: list[tuple[int, int]], distance: int) -> DataFrame:
    """(a, b): links between fingerprints (signed longs) that connect what lies
    within ``distance`` bits."""
    spark = classes.sparkSession
    n_parts = shuffle_partitions(spark)

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flips = []
        for mask, t in plan:
            bits = [np.uint64(1 << b) for b in range(64) if mask >> b & 1]
            flips.append([np.bitwise_or.reduce(np.array(c, np.uint64)) if c else np.uint64(0)
                          for r in range(t + 1) for c in itertools.combinations(bits, r)])
        for pdf in batches:
            fp = pdf["fp"].to_numpy().view(np.uint64)
            for part, (mask, _) in enumerate(plan):
                value = fp & np.uint64(mask)
                for k, flip in enumerate(flips[part]):
                    yield pd.DataFrame({"part": np.int32(part), "value": (value ^ flip).view(np.int64),
                                        "fp": fp.view(np.int64), "own": k == 0})

    post = classes.select("fp").mapInPandas(probes, "part int, value long, fp long, own boolean")
    crowded = cut(post.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
                  .select("part", "value", F.lit(True).alias("many")))
    post = post.withColumn("sub", F.lit(0)).withColumn("rest", F.lit(0).cast("long"))
    blocks = None
    if crowded.limit(1).count():
        groups = F.array(*[F.array(*[F.lit(m) for m in _rest_masks(mask, distance + 1)]) for mask, _ in plan])
        post = post.join(crowded, ["part", "value"], "left")
        again = (post.filter("many").select("part", "value", "fp", "own", F.posexplode(F.element_at(groups, F.col("part") + 1)).alias("sub", "m"))
                 .withColumn("rest", F.col("fp").bitwiseAND(F.col("m"))).drop("m").withColumn("sub", F.col("sub") + 1))
        keys = ["part", "value", "sub", "rest"]
        blocks = cut(again.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
                     .select(*keys, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
        post = post.filter("many is null").select(*keys, "fp", "own").unionByName(again.select(*keys, "fp", "own"))
    if blocks is not None and blocks.limit(1).count():
        side = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        post = post.join(blocks, ["part", "value", "sub", "rest"], "left").withColumn("side", F.coalesce(side, F.lit(0)))
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0)))
                          .otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
        post = post.withColumn("other", other).withColumn("lo", F.least("side", "other")).withColumn(
            "hi", F.greatest("side", "other")).select("part", "value", "sub", "rest", "lo", "hi", "side", "fp", "own")
    else:
        post = post.select("part", "value", "sub", "rest", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("side"), "fp", "own")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        joiner = _Joiner()
        held: list[pd.DataFrame] = []
        keys = ["part", "value", "sub", "rest", "lo", "hi"]

        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            k = pdf[keys].to_numpy()
            edge = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            start, stop = np.concatenate(([0], edge)), np.concatenate((edge, [len(k)]))
            size = stop - start
            fp, own, side = pdf["fp"].to_numpy().view(np.uint64), pdf["own"].to_numpy(), pdf["side"].to_numpy()
            out = []
            split = (pdf["lo"].to_numpy() != pdf["hi"].to_numpy())[start]
            small = (size > 1) & (size <= 64) & ~split
            if small.any():
                for a, b in _small_groups(fp, own, start[small], stop[small], distance):
                    if a != b and joiner.join(a, b):
                        out.append((a, b))
            for s, e, cross in zip(start[(size > 1) & ~small], stop[(size > 1) & ~small], split[(size > 1) & ~small]):
                for a, b in _spanning(fp[s:e], own[s:e], side[s:e], bool(cross), distance):
                    if a != b and joiner.join(a, b):
                        out.append((a, b))
            ab = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pd.DataFrame({"a": ab[:, 0], "b": ab[:, 1]})

        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            both = pd.concat(held) if len(held) > 1 else pdf
            last = both[keys].iloc[-1]
            tail = (both[keys] == last).all(axis=1).to_numpy()
            cut_at = len(both) - int(tail[::-1].argmin()) if not tail.all() else 0
            if cut_at:
                yield work(both.iloc[:cut_at])
            held = [both.iloc[cut_at:]]
        if held and len(held[0]):
            yield work(held[0])

    keys = ["part", "value", "sub", "rest", "lo", "hi"]
    dealt = post.repartition(n_parts, *keys).sortWithinPartitions(*keys, "fp")
    return dealt.mapInPandas(link, "a long, b long")


def component_roots(rows: DataFrame, distance: int = 4) -> DataFrame:
    """(fp, root, component_id) of each fingerprint of ``rows`` (doc_id, fp); root
    is the component's smallest fingerprint."""
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    n = classes.count()
    sample = np.array([r["fp"] for r in classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()],
                      np.int64).view(np.uint64)
    if n < 2:
        return classes.select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"))
    links = find_links(classes, make_plan(sample, n, distance), distance)
    comp = connected_components(links).withColumnRenamed("node", "fp")
    merged = cut(classes.join(comp, "fp", "left"))
    alone = merged.filter("root is null").select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"))
    linked = merged.filter("root is not null")
    least = cut(linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")))
    # at most HOT components hold more than a HOT-th of the classes each: their roots are broadcast, the others' joined
    large = F.broadcast(least.filter(F.col("n") * HOT > n).select("root", "component_id"))
    small = least.filter(F.col("n") * HOT <= n).select("root", "component_id")
    cols = ["fp", "root", "component_id"]
    return (alone.unionByName(linked.join(large, "root").select(*cols))
            .unionByName(linked.join(large, "root", "left_anti").join(small, "root").select(*cols)))


def simhash_components(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): one row per input row."""
    rows = cut(fingerprints(docs, words).select("doc_id", "fp"))
    return rows.join(component_roots(rows, distance), "fp").select("doc_id", "fp", "component_id")


def op9_simhash(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    out = simhash_components(docs, words, distance)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage_simhash(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """One row of each group stays: the one with the smallest doc_id (null only if
    the group has no other), of these the one with the smallest hash of its text,
    of equal texts the one with the smallest hash of its columns."""
    rows = cut(fingerprints(docs.select("doc_id", "text"), words))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    stay = rows.groupBy("fp").agg(F.min(key).alias("key")).join(component_roots(rows, distance), "fp")
    stay = stay.groupBy("root").agg(F.min("key").alias("key")).select(F.col("key.doc_id").alias("keep_id"), F.col("key.tie").alias("keep_tie"))
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"), docs["doc_id"].cast("long").alias("d_id"),
                      F.xxhash64(docs["text"]).alias("d_tie"))
    own = own.join(stay, F.col("d_id").eqNullSafe(F.col("keep_id")) & (F.col("d_tie") == F.col("keep_tie")), "left_semi")
    whole = F.xxhash64(*[F.col(f"d.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    kept = own.groupBy("d_id", "d_tie").agg(F.min_by("d", whole).alias("d"))
    return kept.select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])
