"""Operator 12: best-fit packing by the sum of squares.

Documents become token ids of a public vocabulary and an end id; only documents
longer than a sequence are cut, into whole sequences and a last, shorter piece.
The pieces are then packed on their lengths alone. With N[g] the number of open
sequences that have g free places, a piece goes where the sum of all N[g]^2
becomes smallest: into a sequence with free space g (N[g] falls, N[g - s] rises)
or into a new one. Full sequences are closed and count no more. Longer pieces come
first, so the many short ones fill the gaps that are left at the end.

Tokenising is a scan without a shuffle; its narrow result (no ids unless asked for)
is written once to the shared folder. The pieces are dealt to groups of about
``GROUP`` rows by a hash of their place in that copy, so equal rows spread like any
others; a group is packed in one task, whose size doesn't grow with the table. Each
group leaves a few dozen sequences partly filled, about 0.3 % of its sequences.

Defined cases
-------------
* null and empty texts are documents of the end id alone;
* a document whose ids fill whole sequences exactly has no empty last piece;
* equal lengths: in the order of the copy; equal sums of squares: the smallest free
  space that fits, a new sequence last; equal free space: the sequence that got it last;
* repeated rows and null doc_ids are documents like any other;
* an empty table returns an empty table; other columns are never looked at.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, worker_cache

#: Tokens of a sequence, end-of-document id, pieces packed together, text bytes tokenised at a time.
LENGTH, END, GROUP, CHUNK = 4096, 1, 1 << 16, 1 << 21
#: Words whose ids a worker remembers (about 200 bytes each) before it starts again.
WORDS = 1_000_000
VOCABULARY = "word_bpe_49k.json"

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
#: Tokens never cross white space, nor the place between a Latin letter or digit and such a mark.
_COMBINING = re.compile("[\u0300-\u036f]")
_MARKED = re.compile("(?<=[A-Za-z0-9À-ÖØ-öø-ɏ])(?=[.,;:!?])")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _tokenizer(path: str):
    cache = worker_cache("square_packing")
    if ("tokenizer", path) not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        cache["tokenizer", path] = (Tokenizer.from_file(path), {})
    return cache["tokenizer", path]


def encode(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of every text as little-endian 32-bit numbers; the same ids as those of the whole
    texts, but each distinct word is looked up once. Texts that may hold a special token
    keep their letters' case."""
    tok, known = _tokenizer(path)
    if len(known) > WORDS:
        known.clear()
    split, ids, new = [], [], set()
    for t in texts:
        t = _MARKED.sub(" ", t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if "<|" not in t and (t.isascii() or not _COMBINING.search(t)):
            t = t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")      # A-Z only
        words = t.split(" ")
        own = list(map(known.get, words))
        gaps = [k for k, x in enumerate(own) if x is None]
        new.update([words[k] for k in gaps])
        split.append((words, gaps))
        ids.append(own)
    new = sorted(new)
    for at in range(0, len(new), 10_000):
        some = new[at:at + 10_000]
        for word, e in zip(some, tok.encode_batch_fast(some, add_special_tokens=False)):
            known[word] = array("I", e.ids).tobytes()
    for own, (words, gaps) in zip(ids, split):
        for k in gaps:
            own[k] = known[words[k]]
    return [b"".join(own) for own in ids]


def pieces_of(docs: DataFrame, length: int = LENGTH, end: int = END, path: str | None = None,
              keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents: place, length and checksum, and the ids if asked for."""
    path = path or vocabulary_path()
    last = struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < b.num_rows:
                hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo:]), CHUNK, side="right")))
                out: list[tuple] = []
                for doc, ids in zip(b.column(0)[lo:hi].to_pylist(), encode(b.column(1)[lo:hi].to_pylist(), path)):
                    ids = memoryview(ids + last)
                    for p, at in enumerate(range(0, len(ids), 4 * length)):
                        own = ids[at:at + 4 * length]
                        out.append((doc, p, at // 4, len(own) // 4, zlib.crc32(own), bytes(own) if keep_ids else None))
                for at in range(0, len(out), 20_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out[at:at + 20_000]),
                                                        (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                        names=[c.split()[0] for c in SCHEMA.split(", ")])
                lo = hi

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def sum_of_squares(sizes: np.ndarray, top: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece; pieces are placed in the order given."""
    count = np.zeros(top + 1, np.int64)                      # count[g]: open sequences with g free places
    open_: list[list[int]] = [[] for _ in range(top + 1)]
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    n, none = 0, np.iinfo(np.int64).max
    for k, s in enumerate(sizes.tolist()):
        at = -1
        if s < top:
            # half the change of the sum if g = s + j: (N[g-s]+1)^2 - N[g-s]^2 + (N[g]-1)^2 - N[g]^2, halved
            change = 2 * (count[:top + 1 - s] - count[s:] + 1)
            change[0] = 1 - 2 * count[s]                     # a full sequence is closed: only N[g] changes
            change[count[s:] == 0] = none
            j = int(change.argmin())
            if change[j] != none and change[j] <= 2 * count[top - s] + 1:
                at = s + j
        if at < 0:
            sequence[k], at, n = n, top, n + 1
        else:
            sequence[k] = open_[at].pop()
            count[at] -= 1
        offset[k] = top - at
        if at > s:
            open_[at - s].append(int(sequence[k]))
            count[at - s] += 1
    return sequence, offset


def pack_pieces(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``pieces`` (any columns, with ``length``) and their sequence_id and offset."""
    pieces = cut(pieces)
    groups = max(1, -(-pieces.count() // group))
    dealt = (pieces.withColumn("_row", F.monotonically_increasing_id())
             .withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups))))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("_row", "ascending")])
        sequence, offset = sum_of_squares(rows.column("length").to_numpy(), length)
        return (rows.drop_columns(["_row", "_group"])
                .append_column("sequence_id", pa.array((key[0].as_py() << 32) + sequence))
                .append_column("offset", pa.array(offset)))

    return dealt.groupBy("_group").applyInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, length: int = LENGTH, end: int = END, path: str | None = None) -> DataFrame:
    """The packed pieces with their ids (binary, little-endian 32-bit)."""
    return pack_pieces(pieces_of(docs, length, end, path, keep_ids=True), length)


def op12_square_packing(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    return pack_pieces(pieces_of(docs, length).drop("ids"), length, group)
