"""Operator 7: language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is then
parsed, from left to right, into the longest pieces that occur in a language's
text; the number of pieces times log2 of the length of the language's text, per
character, is the cross-parsing estimate of the entropy between the two. The
language with the smallest value wins (ties: the smaller name).

The automata are fitted on a bounded sample: per language, of the labelled rows
in order of a hash of their id, at most ``TRAIN_DOCS`` documents and
``TRAIN_CHARS`` symbols. Texts are parsed whole, many at a time: blocks of
``BLOCK`` symbols of all texts of a batch advance together through one table of
transitions (a phrase ends at a block's edge).

A symbol is a letter seen in the training text (lower-cased; every such letter
of every language has a symbol of its own), a run of characters that are not
letters (one symbol), or "another letter", which occurs in no automaton.

Defined cases
-------------
* null texts and texts without a letter: ``und``, score 0;
* rows whose doc_id is null are neither held out nor learned from;
* no labelled text at all: every text is ``und``, score 0;
* repeated rows get the same result, and a repeated id is learned from once; an empty table returns an empty table;
* other columns, and lang, source and doc_id, are no input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import worker_cache

#: Bound of the sample on which each language's automaton is fitted.
TRAIN_DOCS, TRAIN_CHARS = 64, 40_000
#: Parts of a language in which its smallest ids are sought first.
SALTS = 16
#: Symbols of a text that are parsed as one piece.
BLOCK = 1024
#: Symbols that are parsed at a time in one task.
CHUNK = 1 << 21
UNKNOWN, GAP = "und", 0


def held_out(doc_id: Column) -> Column:
    rest = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))
    return F.coalesce(rest == 1, F.lit(False))


def training_texts(docs: DataFrame, max_docs: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """(lang, text) of the sample: at most ``max_docs`` whole documents per
    language. Distinct ids are ranked first, without their texts; of the rows of
    a repeated id the text with the smallest hash is taken, once."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                        & ~held_out(F.col("doc_id")))
    known = known.withColumn("hash", F.xxhash64("text"))
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    salted = (known.groupBy("lang", "doc_id").agg(F.min("hash").alias("hash"))
              .withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS))))
    few = (salted.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*by)))
           .filter(F.col("nth") <= max_docs))                                        # at most SALTS x max_docs ids a language
    chosen = (few.drop("salt").withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(*by)))
              .filter(F.col("nth") <= max_docs))                                     # max_docs ids per language
    rows = known.select("doc_id", "lang", "hash", "text").join(F.broadcast(chosen), ["doc_id", "lang", "hash"])
    rows = rows.groupBy("lang", "nth").agg(F.min(F.substring("text", 1, TRAIN_CHARS)).alias("text"))   # fitting only
    return [(r["lang"], r["text"]) for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["nth"]))]


class SuffixAutomaton:
    """All substrings of a sequence of symbols; ``next[state]`` maps symbols."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in symbols:
            cur = len(length)
            length.append(length[last] + 1)
            link.append(0)
            self.next.append({})
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p != -1:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    self.next.append(dict(self.next[q]))
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur


def _offsets(state: np.ndarray, symbol: np.ndarray, n: int) -> np.ndarray:
    """A different offset for each of n states, so that offset + symbol differs
    between all edges. ``state`` is sorted. States with many edges are placed
    first, many states at a time at random (seeded) offsets; those that meet
    another try again, and the room grows until all stand."""
    r = np.random.default_rng(1)
    degree = np.bincount(state, minlength=n)
    begin = np.cumsum(degree) - degree
    room = 4 * len(state) + 2 * n + 64
    top = int(symbol.max(initial=0)) + 1
    place = np.zeros(n, np.int64)
    taken, used = np.zeros(room + top, bool), np.zeros(room, bool)
    size_class = np.ceil(np.log2(np.maximum(degree, 1))).astype(int)
    for size in np.unique(size_class)[::-1].tolist():
        todo, tries = np.flatnonzero(size_class == size), 0
        while len(todo):
            tries += 1
            if tries % 64 == 0:
                room *= 2
                taken = np.append(taken, np.zeros(room + top - len(taken), bool))
                used = np.append(used, np.zeros(room - len(used), bool))
            put = r.integers(0, room, len(todo))
            d = degree[todo]
            who = np.repeat(np.arange(len(todo)), d)
            edge = np.arange(d.sum()) + np.repeat(begin[todo] - (np.cumsum(d) - d), d)
            slot = put[who] + symbol[edge]
            ok = ~used[put]
            ok[who[taken[slot]]] = False
            for value, owner in ((slot, who), (put, np.arange(len(todo)))):   # of states that meet, the first stays
                live = ok[owner]
                value, owner = value[live], owner[live]
                _, first, where = np.unique(value, return_index=True, return_inverse=True)
                ok[owner[owner != owner[first][where]]] = False
            place[todo[ok]] = put[ok]
            used[put[ok]] = True
            taken[slot[ok[who]]] = True
            todo = todo[~ok]
    return place


class CrossParser:
    """One transition table for the automata of all languages.

    The table is sparse: a state is an offset, and its edge under symbol c stands
    at offset + c, as (state << 32 | next state). Offsets are chosen so that no two
    edges meet; an entry that names another state is no edge of this one."""

    def __init__(self, texts: list[tuple[str, str]], max_chars: int = TRAIN_CHARS):
        fold = {p: chr(p).lower()[0] for p in range(0x110000) if chr(p).isalpha()}
        letters = sorted({fold[ord(c)] for c in set().union(*[t for _, t in texts]) if c.isalpha()})
        number = {c: k + 1 for k, c in enumerate(letters)}
        self.width = len(letters) + 2                                   # gap, letters, any other letter
        lut = np.zeros(0x110000, np.int32)
        lut[list(fold)] = [number.get(c, self.width - 1) for c in fold.values()]
        self.lut = lut
        per: dict[str, list[int]] = {}
        for lang, text in texts:
            have = per.setdefault(lang, [])
            if len(have) < max_chars:
                have.extend([GAP] * bool(have))
                have.extend(self.symbols([text])[0].tolist()[:max_chars - len(have)])
        self.langs = sorted(lang for lang, s in per.items() if any(s))
        self.cost, roots, edges = [], [], []
        base = 0
        for lang in self.langs:
            auto = SuffixAutomaton(per[lang])
            edges.append(np.array([(base + s, c, base + t) for s, moves in enumerate(auto.next) for c, t in moves.items()], np.int64))
            roots.append(base)
            self.cost.append(np.log2(max(2, len(per[lang]))))
            base += len(auto.next)
        edges = np.concatenate([*edges, np.zeros((0, 3), np.int64)])
        place = _offsets(edges[:, 0], edges[:, 1], base + 1)            # the last state is the sink
        self.sink = int(place[base])                                    # after a symbol that the language lacks
        self.table = np.full(int(place.max()) + self.width, -1 << 32, np.int64)
        self.table[place[edges[:, 0]] + edges[:, 1]] = place[edges[:, 0]] << 32 | place[edges[:, 2]]
        self.first = []                                                 # where each symbol leads from a root
        for root in roots:
            first = np.full(self.width, self.sink, np.int64)            # unseen symbol: a phrase by itself
            own = edges[edges[:, 0] == root]
            first[own[:, 1]] = place[own[:, 2]]
            self.first.append(first)

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts in a row, and each text's number of symbols."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.lut[np.minimum(codes, 0x10FFFF)]
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != GAP) | (s[:-1] != GAP) | (doc[1:] != doc[:-1])
        return s[keep], np.bincount(doc[keep], minlength=len(texts))

    def phrases(self, s: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Pieces of the blocks [start, start + size) under each language."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        out = np.zeros((len(self.langs), len(start)), np.int64)
        table = self.table
        for k, first in enumerate(self.first):
            count = np.zeros(len(start), np.int64)
            state = np.full(len(start), self.sink, np.int64)
            for t, n in enumerate(active.tolist()):
                c = s[start[:n] + t]
                if t == 0:
                    state[:n] = first[c]
                    continue
                at = state[:n]
                edge = table[at + c]
                ended = edge >> 32 != at
                count[:n] += ended
                np.bitwise_and(edge, 0xFFFFFFFF, out=at)
                np.copyto(at, first[c], where=ended)
            out[k] = count + (size > 0)
        back = np.empty_like(out)
        back[:, order] = out
        return back

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        plain = [t or "" for t in texts]
        langs, scores = [UNKNOWN] * len(plain), np.zeros(len(plain))
        at = 0
        while at < len(plain) and self.langs:
            to, total = at, 0
            while to < len(plain) and (to == at or total + len(plain[to]) <= CHUNK):
                total += len(plain[to])
                to += 1
            s, n = self.symbols(plain[at:to])
            first = np.cumsum(n) - n
            blocks = -(-n // BLOCK)
            doc = np.repeat(np.arange(to - at), blocks)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            counts = self.phrases(s, first[doc] + nth * BLOCK, np.minimum(BLOCK, n[doc] - nth * BLOCK))
            bits = np.stack([np.bincount(doc, c, to - at) for c in counts], 1) * np.array(self.cost)
            letters = np.bincount(np.repeat(np.arange(to - at), n), s != GAP, to - at)
            best = bits.argmin(1)
            share = 1 / np.exp2(np.maximum(-(bits - bits.min(1, keepdims=True)) / 8, -60)).sum(1)
            for k in np.flatnonzero(letters > 0).tolist():
                langs[at + k], scores[at + k] = self.langs[best[k]], share[k]
            at = to
        return langs, scores


def _parser(texts: list[tuple[str, str]]) -> CrossParser:
    """The automata, built once per worker process (the sample is small and
    travels with the function; the tables don't)."""
    cache, key = worker_cache("langid"), hash(tuple(texts))
    if cache.get("langid", (None,))[0] != key:
        cache["langid"] = (key, CrossParser(texts))
    return cache["langid"][1]


def predict_languages(docs: DataFrame, texts: list[tuple[str, str]]) -> DataFrame:
    """``docs`` (with a column text) and two more columns, lang_pred and score."""
    at = docs.columns.index("text")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(texts)
        for b in batches:
            langs, scores = parser.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores)],
                                             names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op7_langid(docs: DataFrame) -> DataFrame:
    texts = training_texts(docs)
    out = predict_languages(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), texts)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def stage_langid(docs: DataFrame) -> DataFrame:
    """The documents with a language: texts that are null or without a letter go;
    lang becomes the predicted one. Same columns."""
    texts = training_texts(docs)
    row = docs.select("text", F.struct(*[docs[c] for c in docs.columns]).alias("d"))
    out = predict_languages(row, texts).filter(F.col("lang_pred") != UNKNOWN)
    return out.select(*[(F.col("lang_pred") if c == "lang" else F.col(f"d.`{c}`")).alias(c) for c in docs.columns])
