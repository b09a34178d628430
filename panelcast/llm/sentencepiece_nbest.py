"""Operator 2: SentencePiece N-best encoding and decoding.

The pieces and scores of a public SentencePiece model span a lattice over a
text (spaces written as the model's space mark, one put in front). Forward
Viterbi scores give the best way to each position; from the end, an A-star
search walks the lattice backwards with those scores as its exact heuristic and
so meets the segmentations best first.

No piece crosses the start of a word, so the lattice is a chain of word lattices
and a document's N best segmentations differ from the best one in at most N - 1
words, those whose second-best way costs least. The Viterbi scores (best and
second best) are therefore computed for all distinct words of a batch at once,
and the A-star search runs on those few words; their N-best lists combine to the
document's.

Defined cases
-------------
* null and empty texts have no ids, score 0 and no alternatives; they decode to "";
* a character without a piece of its own is one edge with score (smallest regular
  score) - 10, written as its UTF-8 bytes; so is a literal space mark U+2581, and
  every text decodes to itself;
* equal scores: the segmentation whose last piece is longer, and so on to the
  front, comes first, within words and over a whole text;
* runs of spaces are lattices of their own, and so are newlines;
* very long words take the same search; their Viterbi scores are found one by one. A way
  of the search is a link to the way it goes on from, and a position is left at most n
  times, so that memory and time grow with the word's length;
* repeated rows repeat their result; an empty table returns an empty table; other
  columns are never looked at (the pipeline stage keeps them).
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from array import array
from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

#: Public SentencePiece model (pieces, scores, byte pieces).
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, LITERAL = "▁", "\ud800"          # the second stands for a literal U+2581 in a text
#: Words above this length have their Viterbi scores found one by one, not in the batch's table;
#: characters encoded at a time.
LONG_WORD, CHUNK = 96, 1 << 21
#: Words whose n best a worker remembers (about 1 KB each) before it starts again.
KNOWN = 20_000
NEG = -1e18


class _Ways:
    """Ways from the end of a word. A way is a node: where its last piece starts, its score
    and the node it goes on from; ``jump`` leads to an older node (skew-binary links)."""

    def __init__(self, end: int):
        self.at, self.done = array("i", [end]), array("d", [0.0])
        self.up, self.depth, self.jump = array("i", [0]), array("i", [0]), array("i", [0])

    def older(self, k: int) -> int:
        """Where the nodes that go on from ``k`` jump to."""
        far = self.jump[k]
        return self.jump[far] if self.depth[k] - self.depth[far] == self.depth[far] - self.depth[self.jump[far]] else k

    def lift(self, x: int, level: int) -> int:
        while self.depth[x] > level:
            x = self.jump[x] if self.depth[self.jump[x]] >= level else self.up[x]
        return x


class _Way:
    """A node that among equal scores comes first if its pieces, from the end, are longer where
    they first differ."""
    __slots__ = ("ways", "node")

    def __init__(self, ways: _Ways, node: int):
        self.ways, self.node = ways, node

    def __lt__(self, other: "_Way") -> bool:
        w = self.ways
        level = min(w.depth[self.node], w.depth[other.node])
        x, y = w.lift(self.node, level), w.lift(other.node, level)
        if x == y:
            return w.depth[self.node] < w.depth[other.node]
        while w.up[x] != w.up[y]:
            x, y = (w.jump[x], w.jump[y]) if w.jump[x] != w.jump[y] else (w.up[x], w.up[y])
        return w.at[x] < w.at[y]


class Vocabulary:
    """Pieces, scores and byte pieces of a model, and the piece trie."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int]):
        self.piece = {p: (i, s) for p, s, i in pieces}
        self.byte_ids = np.array(byte_ids)
        self.known: dict = {}                                # n best of words met before
        regular = [s for _, s, _ in pieces if s > -1e8]
        self.unknown = min(regular) - 10.0 if regular else -10.0
        self.longest = max((len(p) for p, _, _ in pieces), default=1)
        chars = sorted({c for p, _, _ in pieces for c in p})
        self.lut = np.zeros(0x110000, np.int64)
        self.lut[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.n_classes = len(chars) + 1
        children: dict[int, int] = {}
        score, ident = [NEG], [-1]
        for p, s, i in pieces:
            node = 0
            for c in p:
                key = node * self.n_classes + int(self.lut[ord(c)])
                if key not in children:
                    children[key] = len(score)
                    score.append(NEG)
                    ident.append(-1)
                node = children[key]
            score[node], ident[node] = s, i
        self.score, self.ident = np.array(score), np.array(ident)
        # trie edges in an open-addressing table, so that whole arrays walk at once
        self.shift = np.uint64(64 - max(10, (4 * len(children)).bit_length()))
        size = 1 << (64 - int(self.shift))
        keys, nodes = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        left_k, left_n = np.array(list(children), np.int64), np.array(list(children.values()), np.int32)
        slot = self._slot(left_k) if len(left_k) else left_k
        while len(left_k):
            free = keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = first[free[first]]
            keys[slot[put]], nodes[slot[put]] = left_k[put], left_n[put]
            rest = np.ones(len(left_k), bool)
            rest[put] = False
            left_k, left_n, slot = left_k[rest], left_n[rest], (slot[rest] + 1) % size
        self.keys, self.nodes, self.size = keys, nodes, size
        self.bytes = {i: p.replace(MARK, " ").encode() for p, _, i in pieces}
        self.bytes.update({i: bytes([b]) for b, i in enumerate(byte_ids)})

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Trie children, -1 where there is none."""
        key = node * self.n_classes + cls
        slot = self._slot(key)
        got = self.keys[slot]
        out = np.where(got == key, self.nodes[slot], -1).astype(np.int64)
        todo = np.flatnonzero((got != key) & (got != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) % self.size
            got = self.keys[slot[todo]]
            hit = got == key[todo]
            out[todo[hit]] = self.nodes[slot[todo[hit]]]
            todo = todo[~hit & (got != -1)]
        return out

    def char_ids(self, c: str) -> list[int]:
        return [int(self.byte_ids[b]) for b in (MARK if c == LITERAL else c).encode("utf-8", "surrogatepass")]

    # --- one word: Viterbi forward, A-star backward --------------------------------

    def edges_to(self, word: str, end: int) -> Iterator[tuple[int, float, list[int]]]:
        """(start, score, ids) of the lattice edges into a position, longest first."""
        for start in range(max(0, end - self.longest), end):
            hit = self.piece.get(word[start:end])
            if hit:
                yield start, hit[1], [hit[0]]
            elif start == end - 1:
                yield start, self.unknown, self.char_ids(word[start])

    def spans_to(self, word: str, end: int) -> list[tuple[int, float]]:
        """(start, score) of the lattice edges into a position, longest first."""
        get, out = self.piece.get, []
        for start in range(max(0, end - self.longest), end):
            hit = get(word[start:end])
            if hit:
                out.append((start, hit[1]))
            elif start == end - 1:
                out.append((start, self.unknown))
        return out

    def nbest(self, word: str, n: int) -> list[tuple[float, array, array]]:
        """The n best segmentations of a word, best first: (score, ids, starts of the
        pieces from the last one). A-star from the end with the forward scores as exact
        heuristic; no more than n ways leave a position, since a worse one can't be among
        the n best."""
        keep = len(word) <= LONG_WORD                    # the edges of longer words are looked up again
        best, edges = array("d", [0.0]), [[]]
        for end in range(1, len(word) + 1):
            spans = self.spans_to(word, end)
            best.append(max([best[s] + sc for s, sc in spans]))
            if keep:
                edges.append(spans)
        ways = _Ways(len(word))
        at, done, up, depth, push = ways.at, ways.done, ways.up, ways.depth, heapq.heappush
        add_at, add_done, add_up, add_depth, add_jump = at.append, done.append, up.append, depth.append, ways.jump.append
        left = array("i", [0]) * (len(word) + 1)
        # the exact totals of the n best ways so far, no two of them parts of one: a way below them all is never needed
        tops, floor = [best[-1]], -inf
        heap, out = [(-best[-1], _Way(ways, 0))], []
        while heap and len(out) < n:
            k = heapq.heappop(heap)[1].node
            here = at[k]
            if left[here] == n:
                continue
            left[here] += 1
            if here == 0:
                cuts, score = [], done[k]
                while k:
                    cuts.append(at[k])
                    k = up[k]
                out.append((score, array("i", self.ids_between(word, [*cuts, len(word)])), array("i", cuts[::-1])))
                continue
            so_far, level, older = done[k], depth[k] + 1, ways.older(k)
            spans = edges[here] if keep else self.spans_to(word, here)
            totals = [best[s] + sc + so_far for s, sc in spans]
            most = max(totals)                               # goes on with the way's own best
            for (s, sc), total in zip(spans, totals):
                if total < floor or left[s] == n:
                    continue
                if total == most:
                    most = None
                elif len(tops) < n:
                    heapq.heappush(tops, total)
                elif total > tops[0]:
                    heapq.heapreplace(tops, total)
                if len(tops) == n:
                    floor = tops[0] - 1e-9 * abs(tops[0])
                add_at(s)
                add_done(sc + so_far)
                add_up(k)
                add_depth(level)
                add_jump(older)
                push(heap, (-total, _Way(ways, len(at) - 1)))
        return out

    def best_long(self, word: str) -> tuple[float, float, list[int]]:
        """(best score, second-best score, ids) of one word of any length."""
        first, second, back = array("d", [0.0]), array("d", [NEG]), array("q", [0])
        for end in range(1, len(word) + 1):
            a, b, via = NEG, NEG, 0
            for s, sc in self.spans_to(word, end):
                x, y = first[s] + sc, second[s] + sc
                if x > a:
                    a, b, via = x, max(a, y, b), s
                else:
                    b = max(b, x)
            first.append(a)
            second.append(b)
            back.append(via)
        cuts, at = [len(word)], len(word)
        while at:
            at = back[at]
            cuts.append(at)
        return first[-1], second[-1], self.ids_between(word, cuts[::-1])

    def ids_between(self, word: str, cuts: list[int]) -> list[int]:
        """Ids of the pieces of a word that is cut at ``cuts``."""
        ids = []
        for s, e in itertools.pairwise(cuts):
            hit = self.piece.get(word[s:e])
            if hit:
                ids.append(hit[0])
            else:
                ids.extend(self.char_ids(word[s:e]))
        return ids

    # --- all distinct words of a batch ----------------------------------------------

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets, best, gap, longer): the best ids of each word in a row, its score,
        what its second-best way costs more (inf if there is one way only), and whether that way
        has the longer piece where the two first differ from the end."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        long = np.flatnonzero(size > LONG_WORD)
        by_hand = {int(k): self.best_long(words[k]) for k in long}
        use = np.where(size > LONG_WORD, 0, size)
        codes = np.frombuffer("".join(w if len(w) <= LONG_WORD else "" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = self.lut[codes]
        order = np.argsort(-use, kind="stable")
        n_chars = use[order]
        text_at = (np.cumsum(use) - use)[order]                          # where the word's characters start
        base = np.cumsum(n_chars + 1) - (n_chars + 1)                    # where its positions start
        total = int((n_chars + 1).sum())
        a1, a2 = np.full(total, NEG), np.full(total, NEG)
        second_back, longer = np.zeros(total, np.int16), np.zeros(total, bool)
        back, ident, n_ids = np.zeros(total, np.int16), np.full(total, -1, np.int32), np.zeros(total, np.int32)
        a1[base] = 0.0
        utf8 = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)

        def reach(src, dst, score, length, piece, count):
            x, y = a1[src] + score, a2[src] + score
            old = a1[dst]
            better = x > old
            # the second-best way: the one before, the loser of the two best, or the second-best way to src;
            # of equal ones that with the longer last piece
            two, piece2 = a2[dst], second_back[dst]
            for value, size in ((np.where(better, old, x), np.where(better, back[dst], length)), (y, length)):
                take = (value > two) | (value == two) & (size > piece2)
                two, piece2 = np.where(take, value, two), np.where(take, size, piece2)
            a2[dst], second_back[dst] = two, piece2
            to = dst[better]
            a1[to] = x[better]
            back[to], ident[to], n_ids[to] = length, piece[better], (n_ids[src] + count)[better]

        top = int(n_chars[0]) if len(n_chars) else 0
        alive = np.searchsorted(-n_chars, -np.arange(1, top + 1), side="right")
        def settle(at):
            """Positions with all their edges: do their last pieces differ, or those before?"""
            longer[at] = np.where(second_back[at] != back[at], second_back[at] > back[at], longer[at - back[at]])

        for s in range(top):
            who = np.arange(alive[s])
            settle(base[who] + s)
            node = np.zeros(len(who), np.int64)
            for length in range(1, self.longest + 1):
                node = self.step(node, cls[text_at[who] + s + length - 1])
                good = node >= 0
                if length == 1:
                    lone = who[~good | (self.score[np.where(good, node, 0)] <= NEG)]
                    if len(lone):
                        src = base[lone] + s
                        reach(src, src + 1, self.unknown, 1, np.full(len(lone), -1), utf8[text_at[lone] + s])
                who, node = who[good], node[good]
                if not len(who):
                    break
                score = self.score[node]
                piece = score > NEG
                if piece.any():
                    src = base[who[piece]] + s
                    reach(src, src + length, score[piece], length, self.ident[node[piece]], 1)
                more = n_chars[who] > s + length
                who, node = who[more], node[more]
                if not len(who):
                    break
        end = base + n_chars
        settle(end)
        count = np.zeros(len(words), np.int64)
        count[order] = n_ids[end]
        best, gap = np.zeros(len(words)), np.full(len(words), np.inf)
        best[order] = a1[end]
        second = a2[end]
        gap[order] = np.where(second > NEG / 2, a1[end] - second, np.inf)
        last = np.zeros(len(words), bool)
        last[order] = longer[end]
        for k, (one, two, ids) in by_hand.items():
            count[k], best[k], gap[k] = len(ids), one, one - two if two > NEG / 2 else np.inf
            ways = self.nbest(words[k], 2)
            last[k] = len(ways) == 2 and ways[1][2] < ways[0][2]
        offsets = np.concatenate(([0], np.cumsum(count)))
        ids = np.zeros(offsets[-1], np.int32)
        at, put = end.copy(), offsets[1:][order]                         # walk back, filling from the end
        who = np.flatnonzero(n_chars > 0)
        while len(who):
            here = at[who]
            piece = ident[here]
            known = piece >= 0
            put[who[known]] -= 1
            ids[put[who[known]]] = piece[known]
            odd = who[~known]
            if len(odd):
                code = codes[text_at[odd] + (at[odd] - 1 - base[odd])].astype(np.int64)
                code[code == ord(LITERAL)] = ord(MARK)
                for width in range(1, 5):
                    sel = (1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)) == width
                    w, c = odd[sel], code[sel]
                    put[w] -= width
                    for b in range(width):
                        byte = (c >> (6 * (width - 1 - b))) & 0x3F | 0x80 if b else c >> (6 * (width - 1))
                        lead = {1: 0x00, 2: 0xC0, 3: 0xE0, 4: 0xF0}[width] if b == 0 else 0
                        ids[put[w] + b] = self.byte_ids[byte | lead]
            at[who] -= back[here]
            who = who[at[who] > base[who]]
        for k, (_, _, own) in by_hand.items():
            ids[offsets[k]:offsets[k + 1]] = own
        return ids, offsets, best, gap, last


_UNITS = re.compile(r" *[^ \n]+|\n| +")


def text_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, word numbers of all texts in a row, offsets of the texts)."""
    plain = [bool(t) and "  " not in t and MARK not in t for t in texts]
    words: dict[str, int] = {}
    split = pc.split_pattern(pa.array([t if p else "" for t, p in zip(texts, plain)], pa.string()), " ")
    coded = split.flatten().dictionary_encode()
    units, count = [], []                                                # of each distinct word; newlines split it
    for w in coded.dictionary.to_pylist():
        own = [u.replace(" ", MARK) for u in _UNITS.findall(" " + w)] if "\n" in w else [MARK + w]
        units.extend(words.setdefault(u, len(words)) for u in own)
        count.append(len(own))
    flat, start = gather(np.array(units, np.int64), np.concatenate(([0], np.cumsum(count))).astype(np.int64),
                         coded.indices.to_numpy().astype(np.int64))
    off = start[split.offsets.to_numpy()]
    parts, sizes = [], []
    for k, (t, p) in enumerate(zip(texts, plain)):
        if p:
            parts.append(flat[off[k]:off[k + 1]])
        elif t:
            units = _UNITS.findall((" " + t).replace(MARK, LITERAL))
            parts.append(np.array([words.setdefault(u.replace(" ", MARK), len(words)) for u in units], np.int64))
        else:
            parts.append(np.zeros(0, np.int64))
        sizes.append(len(parts[-1]))
    return list(words), np.concatenate(parts) if parts else np.zeros(0, np.int64), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def gather(values: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``pick`` of a ragged array in a row, and where each run starts."""
    size = (offsets[1:] - offsets[:-1])[pick]
    start = np.concatenate(([0], np.cumsum(size)))
    index = np.arange(start[-1]) + np.repeat(offsets[pick] - start[:-1], size)
    return values[index], start


def combine(lists: list[list[tuple[float, array, array]]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best ways to take one segmentation from each word's list, best first; equal scores
    by the pieces from the end of the last word."""
    ranks = [{c: k for k, c in enumerate(sorted(range(len(own)), key=lambda c: own[c][2]))} for own in lists]
    ways = [(sum(own[c][0] for own, c in zip(lists, pick)), pick)
            for pick in itertools.product(*[range(len(own)) for own in lists])]
    return sorted(ways, key=lambda w: (-w[0], [r[c] for r, c in zip(ranks[::-1], w[1][::-1])]))[:n]


def nearest_words(costs: np.ndarray, longer: np.ndarray, n: int) -> list[int]:
    """The n words (ascending) whose second-best way costs least. Among equal costs a word whose
    second way has the longer pieces comes first, the last such word before the others; then words
    whose best way has them, the first one first: so the texts that change one of the words come in
    the order of equal scores."""
    if len(costs) > n:
        near = np.flatnonzero(costs <= np.partition(costs, n - 1)[n - 1])
    else:
        near = np.arange(len(costs))
    near = near[np.isfinite(costs[near])]
    place = np.lexsort((np.where(longer[near], -near, near), ~longer[near], costs[near]))
    return sorted(near[place[:n]].tolist())


def decode(ids, vocab: Vocabulary) -> str:
    """Text of ids: bytes of the pieces, without the space put in front."""
    return b"".join(map(vocab.bytes.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def encode(texts: list[str | None], vocab: Vocabulary, n: int) -> Iterator[tuple[np.ndarray, float, list]]:
    """(ids, score, alternatives) of each text. An alternative is (score, edits),
    an edit (first, last, ids) replaces the best ids [first, last)."""
    texts = [t or "" for t in texts]
    words, flat, off = text_words(texts)
    ids, word_off, best, gap, longer = vocab.encode_words(words)
    all_ids, starts = gather(ids, word_off, flat)
    cache = vocab.known
    if len(cache) > KNOWN:
        cache.clear()
    for k in range(len(texts)):
        lo, hi = off[k], off[k + 1]
        mine = flat[lo:hi]
        score = float(best[mine].sum())
        first = starts[lo]
        alternatives = []
        if n > 1 and hi > lo:
            held: dict = {}                                                  # long words of this text only

            def ways(w: int, mine=mine, held=held):
                word = words[mine[w]]
                known = cache if len(word) <= LONG_WORD else held
                if (word, n) not in known:
                    known[word, n] = vocab.nbest(word, n)
                return known[word, n]

            near = nearest_words(gap[mine], longer[mine], n - 1)
            lists = [ways(w) for w in near]
            base = sum(own[0][0] for own in lists)
            for value, pick in combine(lists, n)[1:]:
                alternatives.append((score + value - base,
                                     [(int(starts[lo + w] - first), int(starts[lo + w + 1] - first), own[c][1].tolist())
                                      for w, own, c in zip(near, lists, pick) if c]))
        yield all_ids[first:starts[hi]], score, alternatives


def read_model(path: str = MODEL) -> tuple[list[tuple[str, float, int]], list[int]]:
    """(pieces, byte ids) of a SentencePiece model with byte pieces."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [(sp.id_to_piece(i), float(sp.get_score(i)), i) for i in range(n)
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return pieces, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


def vocabulary(model: tuple, name: str) -> Vocabulary:
    cache = worker_cache("sentencepiece_nbest")
    if cache.get("vocabulary", (None,))[0] != name:
        cache["vocabulary"] = (name, Vocabulary(*model))
    return cache["vocabulary"][1]


ALTERNATIVE = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([
    ("first", pa.int32()), ("last", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


def encode_documents(docs: DataFrame, n: int = 3, path: str = MODEL) -> DataFrame:
    """``docs`` (with a column text) and ids, score, alternatives (n - 1 of them, if
    there are as many), n_ids, decoded_sha256 (of the text decoded from the ids).

    The model (a fixed 32k pieces) is read on the driver and travels with the function."""
    model = read_model(path)
    at = docs.columns.index("text")
    extra = ("ids array<int>, score double, alternatives array<struct<score: double, edits: array<struct<first: int, last: int, "
             "ids: array<int>>>>>, n_ids long, decoded_sha256 string")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + extra

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model, path)
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < b.num_rows:
                hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), CHUNK, side="right")))
                part = b.slice(lo, hi - lo)
                done = list(encode(part.column(at).to_pylist(), vocab, n))
                ids = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(d[0]) for d in done]))).astype(np.int32),
                                               np.concatenate([d[0] for d in done]))
                sha = [hashlib.sha256(b"".join(map(vocab.bytes.__getitem__, d[0].tolist()))[1:]).hexdigest() for d in done]
                alt = pa.array([[{"score": s, "edits": [{"first": f, "last": e, "ids": i} for f, e, i in edits]}
                                 for s, edits in d[2]] for d in done], ALTERNATIVE)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, ids, pa.array([d[1] for d in done]), alt, pa.array([len(d[0]) for d in done], pa.int64()),
                     pa.array(sha)], names=[*part.schema.names, "ids", "score", "alternatives", "n_ids", "decoded_sha256"])
                lo = hi

    return docs.mapInArrow(run, schema)


def op2_sentencepiece(docs: DataFrame, n: int = 3, path: str = MODEL) -> DataFrame:
    out = encode_documents(docs.select("doc_id", "text"), n, path)
    return out.select("doc_id", "n_ids", "score", "ids", "alternatives", "decoded_sha256")


def stage_sentencepiece(docs: DataFrame, n: int = 3, path: str = MODEL) -> DataFrame:
    """The documents' columns and the operator's (a column of theirs that has the
    same name as one of the operator's is kept with the prefix doc_)."""
    added = ["ids", "score", "alternatives", "n_ids", "decoded_sha256"]
    row = docs.select("text", F.struct(*[docs[c] for c in docs.columns]).alias("d"))
    out = encode_documents(row, n, path)
    names = [c if c not in added else f"doc_{c}" for c in docs.columns]
    return out.select(*[F.col(f"d.`{c}`").alias(name) for c, name in zip(docs.columns, names)], *added)
