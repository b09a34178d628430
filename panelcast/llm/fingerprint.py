"""Operator 1: document fingerprints from prefix polynomial hashes.

``PrefixHash`` keeps, for two bases modulo the prime 2^31 - 1, the hashes of all
prefixes of a text. Any span's hash is then one subtraction and one product,
whatever its place, so two spans of any texts compare in constant time and the
longest common extension of two positions is a binary search over lengths.

A document's fingerprint is the hash of the whole text (16 hex digits) and a
sketch of the span hashes of all windows of ``WINDOW`` code points: for each of
``SLOTS`` slots the smallest hash that falls into it, 4 hex digits each. The
likeness of two fingerprints is the share of slots that agree (an estimate of
the Jaccard similarity of the two sets of windows); 1 if the texts' hashes agree.

Documents are compared with the next one in descending order of doc_id: rows
are dealt to ranges of doc_id and streamed in order, with the first row of a
range copied to the range before it. One document and the next are in memory.

Defined cases
-------------
* null text is an empty text; an empty text has no windows (all slots empty) and
  likeness 1 to an empty text and 0 to any other;
* texts shorter than a window have one window, the whole text;
* rows with the same doc_id follow each other by a hash of their text, null
  doc_ids come last; every row is returned, repeated rows repeatedly;
* the next document of the last row is the first row; a lone row is its own next;
* an empty table returns an empty table; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, worker_cache

P = (1 << 31) - 1
BASES = (1_000_003_919, 1_789_569_707)
#: Code points in a window, slots in a sketch.
WINDOW, SLOTS = 24, 64
#: Code points hashed at a time.
SLICE = 1 << 18
EMPTY = "----"


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod 2^31 - 1 for 0 <= x < 2^63, by folding."""
    x = (x & P) + (x >> 31)
    x = (x & P) + (x >> 31)
    return np.where(x >= P, x - P, x)


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base its powers and inverse powers, at least n of them."""
    cache = worker_cache("fingerprint")
    have = cache.get("powers")
    if have is None or len(have[0][0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = []
        for base in BASES:
            both = []
            for b in (base, pow(base, P - 2, P)):
                p = np.ones(1, np.int64)
                while len(p) < size:   # double the table: p[k + len] = p[k] * b^len
                    p = np.concatenate((p, _mod(p * pow(b, len(p), P))))
                both.append(p)
            have.append(tuple(both))
        cache["powers"] = have
    return have


class PrefixHash:
    """Hashes of all prefixes of a text, two bases."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = n = len(codes)
        powers = _powers(n + 1)
        self.pre = []
        for up, _ in powers:
            pre = np.zeros(n + 1, np.uint32 if n > SLICE else np.int64)
            carry = 0
            for at in range(0, n, SLICE):
                part = codes[at:at + SLICE].astype(np.int64) + 1
                run = _mod(np.cumsum(_mod(part * up[at:at + len(part)])) + carry)
                pre[at + 1:at + 1 + len(part)] = run
                carry = int(run[-1])
            self.pre.append(pre)

    def spans(self, start, stop) -> np.ndarray:
        """62-bit hashes of the spans [start, stop) (integers or arrays)."""
        start, stop = np.asarray(start), np.asarray(stop)
        out = np.uint64(0)
        for (_, down), pre in zip(_powers(self.n + 1), self.pre):
            diff = pre[stop].astype(np.int64) - pre[start].astype(np.int64)
            diff = np.where(diff < 0, diff + P, diff)
            out = (out << np.uint64(31)) | _mod(diff * down[start]).astype(np.uint64)
        return out

    def windows(self, first: int, last: int, width: int) -> np.ndarray:
        """Hashes of the windows of ``width`` that start at first .. last - 1."""
        out = np.zeros(last - first, np.uint64)
        for (_, down), pre in zip(_powers(self.n + 1), self.pre):
            diff = pre[first + width:last + width].astype(np.int64) - pre[first:last].astype(np.int64)
            diff += P * (diff < 0)
            out = (out << np.uint64(31)) | _mod(diff * down[first:last]).astype(np.uint64)
        return out


def spans_equal(a: PrefixHash, i: int, b: PrefixHash, j: int, length: int) -> bool:
    return bool(a.spans(i, i + length) == b.spans(j, j + length))


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """Longest L with a[i:i+L] == b[j:j+L]."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if spans_equal(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of the span hashes (they pick slots and minima)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(ph: PrefixHash, first: int, last: int) -> np.ndarray:
    """Slot minima over the windows that start at first .. last - 1."""
    low = np.full(SLOTS, NONE)
    width = min(WINDOW, ph.n)
    for at in range(first, last, SLICE):
        h = _mix(ph.windows(at, min(last, at + SLICE), width))
        np.minimum.at(low, (h % np.uint64(SLOTS)).astype(np.intp), h >> np.uint64(6))
    return low


def n_windows(n: int) -> int:
    return max(n - WINDOW + 1, 1 if n else 0)


def fingerprint_text(whole: int, low: np.ndarray) -> str:
    slots = _mix(low) & np.uint64(0xFFFF)
    return f"{whole:016x}" + "".join(EMPTY if v == NONE else f"{s:04x}" for v, s in zip(low.tolist(), slots.tolist()))


def likeness(a: str, b: str) -> float:
    """Of two fingerprints: 1 for equal texts, else the share of slots that agree."""
    if a[:16] == b[:16]:
        return 1.0
    x = [a[i:i + 4] for i in range(16, len(a), 4)]
    y = [b[i:i + 4] for i in range(16, len(b), 4)]
    used = sum(p != EMPTY or q != EMPTY for p, q in zip(x, y))
    same = sum(p == q != EMPTY for p, q in zip(x, y))
    return same / used if used else 0.0


class Document:
    """A text with its prefix hashes, window minima and fingerprint."""

    def __init__(self, text: str):
        self.text, self.ph = text, PrefixHash(text)
        n = self.ph.n
        self.stay = n - n // 3                                     # code points before the edit
        self.head_windows = max(0, min(n_windows(n), self.stay - WINDOW + 1)) if n >= WINDOW else 0
        self.head = sketch(self.ph, 0, self.head_windows)
        low = np.minimum(self.head, sketch(self.ph, self.head_windows, n_windows(n)))
        self.print = fingerprint_text(int(self.ph.spans(0, n)), low)

    def edited(self, nxt: "Document") -> tuple[str, str, int]:
        """(text, fingerprint, longest common prefix with this text) after the
        last third is replaced by as many first code points of ``nxt``. Windows
        inside the part that stays are taken from this text."""
        n, stay = self.ph.n, self.stay
        put = nxt.text[:n - stay]
        text = self.text[:stay] + put
        back = max(0, stay - WINDOW + 1) if self.head_windows else 0
        tail = PrefixHash(text[back:])
        low = np.minimum(self.head, sketch(tail, 0, n_windows(tail.n) if tail.n >= WINDOW or not self.head_windows else 0))
        m = stay + len(put)
        whole = np.uint64(0)
        for (up, _), mine, theirs in zip(_powers(max(n, m) + 1), self.ph.pre, nxt.ph.pre):
            value = (int(mine[stay]) + int(up[stay]) * int(theirs[len(put)])) % P
            whole = (whole << np.uint64(31)) | np.uint64(value)
        same = stay + common_extension(self.ph, stay, nxt.ph, 0) if n > stay else n
        return text, fingerprint_text(int(whole), low), min(same, m)


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, same_prefix long")


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """(part, doc_id, tie, own, text): the rows in descending order of doc_id
    (null last, then by a hash of the text), dealt to ranges and sorted in them,
    each range followed by the first row of the next (own = false)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("tie", F.xxhash64("text"))
    # bounds: at most ``parts`` numbers from one pass over the ids; an id that takes several of them, and the
    # rows without one, are dealt to as many ranges of the tie
    quantiles = [k / parts for k in range(1, parts)] or [0.5]
    seen = d.agg(F.percentile_approx("doc_id", quantiles, 10_000).alias("b"), F.count(F.lit(1)).alias("n"),
                 F.count("doc_id").alias("ids")).first()
    taken = Counter(seen["b"] if parts > 1 and seen["b"] else [])
    bounds = sorted(taken, reverse=True)
    more = [taken[b] if taken[b] > 1 else 0 for b in bounds]
    more.append(parts * (seen["n"] - seen["ids"]) // max(1, seen["n"]))                # of the rows without an id
    base = [k + sum(more[:k]) for k in range(len(more))]                               # ranges before the k-th
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values]) if values else F.array().cast("array<long>")
    marks = longs(bounds)
    at = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(F.size(F.filter(marks, lambda b: b > F.col("doc_id"))))
    share = F.col("tie").cast("double") / F.lit(2.0 ** 64) + F.lit(0.5)
    hot = F.when(F.col("doc_id").isNull(), F.lit(True)).otherwise(
        (F.col("at") < len(bounds)) & F.coalesce(F.try_element_at(marks, F.col("at") + 1) == F.col("doc_id"), F.lit(False)))
    extra = F.element_at(longs(more), F.col("at") + 1)
    d = d.withColumn("at", at.cast("int"))
    d = d.withColumn("part", (F.element_at(longs(base), F.col("at") + 1) + F.when(
        hot & (extra > 0), 1 + F.least(F.floor(share * extra), extra - 1)).otherwise(0)).cast("int")).drop("at")
    order = F.struct(F.col("doc_id").isNull().alias("gone"), F.bitwise_not("doc_id").alias("o"), "tie")   # descending ids
    firsts = d.groupBy("part").agg(F.min(order).alias("m")).orderBy("part").collect()    # one row per range
    if not firsts:
        return d.select("part", "doc_id", "tie", F.lit(True).alias("own"), F.lit(0).alias("end"), "text")
    # a range's first row also goes to the range before it, the very first to the last range
    also = [(r["part"], firsts[k - 1]["part"], r["m"]["tie"], r["m"]["o"]) for k, r in enumerate(firsts)]
    also = d.sparkSession.createDataFrame(also, "part int, before int, first_tie long, first_o long")
    d = d.join(F.broadcast(also), "part")
    is_first = (F.col("tie") == F.col("first_tie")) & F.bitwise_not("doc_id").eqNullSafe(F.col("first_o"))
    d = d.withColumn("also", F.when(is_first, F.col("before")))
    homes = F.array(F.struct(F.col("part").alias("part"), F.lit(True).alias("own"), F.lit(0).alias("end")),
                    F.struct(F.col("also").alias("part"), F.lit(False).alias("own"), F.lit(1).alias("end")))
    d = d.withColumn("h", F.explode(F.when(F.col("also").isNull(), F.slice(homes, 1, 1)).otherwise(homes)))
    d = d.select(F.col("h.part").alias("part"), "doc_id", "tie", F.col("h.own").alias("own"), F.col("h.end").alias("end"), "text")
    return d.repartitionById(firsts[-1]["part"] + 1, F.col("part")).sortWithinPartitions(
        "part", "end", F.col("doc_id").desc_nulls_last(), "tie")


def op1_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, their
    likeness and that to the next document; same_prefix: code points that text
    and edited text have in common at the front (a longest common extension)."""
    rows = in_order(docs.select("doc_id", "text"), parts or shuffle_partitions(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        last = None      # (part, doc_id, Document) that waits for its next document

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for b in batches:
            part, ids, own, text = (b.column(k) for k in (0, 1, 3, 5))
            for k in range(b.num_rows):
                p = part[k].as_py()
                d = Document(text[k].as_py())
                if last is not None and last[0] == p:
                    mine = last[2]
                    edited, print_edited, same = mine.edited(d)
                    out.append((last[1], mine.ph.n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                                mine.print, print_edited, likeness(mine.print, print_edited), likeness(mine.print, d.print), same))
                last = (p, ids[k].as_py(), d) if own[k].as_py() else None
                if len(out) >= 2000:
                    yield flush()
        if out:
            yield flush()

    return rows.mapInArrow(run, SCHEMA)
