"""Conversation trie, sum-of-squares packing and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from panelcast.llm import conversation_trie as trie
from panelcast.llm import lexical, queries, square_packing
from panelcast.llm.common import table

from llm_docs import SF, no_docs, odd_docs  # noqa: F401

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TALK = "conv_id long, turn long, role string, text string, seg int, part int, ids string, pos long"


def _trie(rows):
    talks = defaultdict(list)
    for c, t, r, x, *_ in rows:
        r, x = r or "", x or ""
        if c is not None:
            talks[c].append((t is not None, t or 0, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), r, x))
    talks = {c: [v[3:] for v in sorted(turns)] for c, turns in talks.items()}
    built = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = talks.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not kids[p]
        saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted(((min(v), len(p), min(members[p[:-1]]) if p else None, len(v), kids[p], leaves[p], saved[p], hashlib.sha256(
        ",".join(str(c) for c in v if len(built[c]) == len(p)).encode()).hexdigest()) for p, v in members.items()), key=str)


@pytest.fixture(scope="module")
def talks():
    """Null ids, turns, roles and texts, ties, repeated rows, absent families, a hot conversation's copies, a long one."""
    pick = random.Random(1)
    rows = [(c, pick.choice([k, k, k, None, 3]), pick.choice(["u", "a", None]), pick.choice(["x", "yy", "é", None, ""]))
            for c in range(-7, 40) for k in range(pick.choice([0, 1, 2, 3, 5, 9, 14, 14]))]
    rows += [(c, k, "u", "same" if k % 3 else "é") for c in range(100, 160) for k in range(12)]
    rows += [(200, 1, "u", "x")] * 7 + [(None, 1, "u", "x")] * 3 + [(301, k, "u", f"{k % 4}") for k in range(300)]
    rows += [(302, k, "u", f"{k % 4}") for k in range(290)] + [(302, 290, "a", "other")]
    return [(*r, 1, 2, "s", 3) for r in rows]


@pytest.mark.parametrize("width, per_shard", [(128, 1 << 15), (3, 5), (2, 40)])
def test_trie_against_brute_force(spark, talks, width, per_shard):
    got = trie.op11_conversation_trie(spark.createDataFrame(talks, TALK), width, per_shard)
    assert got.columns == NODE
    assert sorted(map(tuple, got.collect()), key=str) == _trie(talks)


def test_trie_query_and_its_sql(spark):
    got = sorted(map(tuple, queries.op11_conversation_trie(spark, SF).select(*NODE).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{SF}/conversations.parquet'")
    assert got == sorted(con.sql(f"SELECT {', '.join(NODE)} FROM ({trie.ORACLE})").fetchall(), key=str)
    assert got == _trie(table(spark, SF, "conversations").collect())


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie.op11_conversation_trie(spark.createDataFrame([], TALK)).count() == 0
    nobody = [c for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0][:2]      # one turn, which goes
    rows = [(c, 0, "u", "gone", 1, 2, "s", 3) for c in nobody]
    got = trie.op11_conversation_trie(spark.createDataFrame(rows, TALK)).collect()
    assert [tuple(r) for r in got] == _trie(rows) and len(got) == 1 and got[0].n_leaves == 1


def _place(sizes, top):
    """Every way to place a piece is tried and the squares are summed."""
    free, out = [], []
    for s in sizes:
        def squares(after):
            return sum(n * n for g, n in Counter(after).items() if g)
        ways = [(squares(free + [top - s]), top + 1, len(free))]
        ways += [(squares(free[:k] + [g - s] + free[k + 1:]), g, k) for k, g in enumerate(free) if g >= s]
        _, gap, k = min(ways, key=lambda w: w[:2])
        if k == len(free):
            free.append(top)
        free[k] -= s
        out.append(gap if gap <= top else 0)
    return out, len(free)


def test_sum_of_squares_against_brute_force():
    pick = random.Random(2)
    for top in (6, 10, 25):
        for _ in range(30):
            sizes = [pick.randint(1, top) for _ in range(40)]
            sequence, offset = square_packing.sum_of_squares(np.array(sizes), top)
            gaps, n = _place(sizes, top)
            assert sequence.max() + 1 == n
            # the space a piece found: none in a new sequence
            assert [top - int(o) if o else 0 for o in offset] == [0 if g == 0 else g for g in gaps]


def _packed(spark, docs, rows, length):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(square_packing.vocabulary_path())
    want = Counter()
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), length)):
            own = np.array(ids[at:at + length], "<u4")
            want[r.doc_id, p, at, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    spans = defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
    for own in spans.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= length
    return spans, sum(n for _, _, _, n, _ in want.elements())


def test_packing_query_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    spans, tokens = _packed(spark, docs, queries.op12_square_packing(spark, SF).collect(), 4096)
    assert len(spans) <= math.ceil(tokens / 4096) + 2


def test_packing_on_odd_rows(spark, odd_docs, no_docs):
    words = ["It's <|endoftext|> THE <|ENDOFTEXT|> end.", "a..b 'S x.'s 12.5 Ⅷ É. é.  İ \u0085 ς Σ.", "x" * 9000, "\n\t \r", "…?! ok!? A1.b2"]
    odd = odd_docs.select("doc_id", "text", "size", "key").unionByName(spark.createDataFrame(
        [(2**60 + k, t, 1, 2) for k, t in enumerate(words)], "doc_id long, text string, size int, key int"))
    for length, group in ((64, 7), (4096, 1 << 16)):
        _packed(spark, odd, square_packing.op12_square_packing(odd, length, group).collect(), length)
    assert square_packing.op12_square_packing(no_docs).count() == 0
    ids = square_packing.pack_documents(odd.filter("doc_id = 4")).collect()
    assert len(ids) == 2 and all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in ids)


def test_words_of_a_small_cache_are_encoded_alike(monkeypatch):
    path, texts = square_packing.vocabulary_path(), ["one two three.", "four, five", "one six!"]
    want = square_packing.encode(texts, path)
    monkeypatch.setattr(square_packing, "WORDS", 3)
    assert [square_packing.encode([t], path)[0] for t in texts] == want


def _ranked(docs, items, k=10):
    cut = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    low = {c: c + 32 for c in range(65, 91)}
    docs = [(d, Counter(cut.findall((t or "").translate(low)))) for d, t in docs]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        asked, found = Counter(cut.findall((text or "").translate(low))), []
        for d, c, n in docs:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                    for t, q in asked.items() if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def test_search_query_against_brute_force(spark):
    got = sorted(map(tuple, queries.op13_lexical(spark, SF).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert got == _ranked(docs, [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    assert got == sorted(con.sql(f"SELECT item_id, rank, doc_id, score FROM ({lexical.ORACLE})").fetchall(), key=str)


@pytest.mark.parametrize("cells, slice_, block", [(1 << 23, 1 << 23, 1 << 16), (300, 50, 6)])
def test_search_on_odd_rows(spark, odd_docs, no_docs, monkeypatch, cells, slice_, block):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "SLICE", slice_)
    docs = odd_docs.union(odd_docs.filter("doc_id >= 20")).union(odd_docs.filter("doc_id = 20")).repartition(3)
    items = [(1, "The THE hund, some words line"), (2, None), (3, "!!"), (None, "house"), (1, "dog x\x0bthe"), (1, "dog x\x0bthe"),
             (4, "nowhereatall"), (5, "two\x00spaces É 12"), (6, " ".join(f"w{k}" for k in range(900)))]
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in items], "item_id long, text string, terms string, rank int, nth int")
    got = lexical.search(docs, df, block_terms=block)
    assert sorted(map(tuple, got.collect()), key=str) == _ranked([(r.doc_id, r.text) for r in docs.collect()], items)
    assert lexical.op13_lexical(no_docs, df).count() == 0 and lexical.op13_lexical(docs, df.limit(0)).count() == 0


def test_bounds_leave_subtrees_out():
    """Most nodes hold nothing that an item with a rare term could want."""
    pick = random.Random(3)
    rows = [sorted(pick.sample(range(40), 12)) for _ in range(2000)] + [[0, 1, 40]] * 12
    off = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    tree = lexical.DocumentTree(np.arange(len(rows)), np.full(len(rows), 100), off, np.concatenate(rows), np.ones(off[-1], np.int64), 41)
    seen = []
    tree.span = type("Seen", (list,), {"__getitem__": lambda self, v: (seen.append(v), list.__getitem__(self, v))[1]})(tree.span)
    best = []
    tree.search(np.array([0, 40]), np.array([1, 5000]), np.full(41, -1, np.int64), best, 10)
    assert sorted(-d for _, d in best) == list(range(2000, 2010)) and len(seen) < 5
