"""Operators over documents: odd rows, brute force, round trips."""

import collections
import itertools
import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from panelcast.llm import fingerprint, langid, line_dedup, mixing, packing, sentencepiece_nbest, simhash, token_counts, tokens
from panelcast.llm.common import table
from panelcast.llm.graph import connected_components

from llm_docs import EXTRA, SCHEMA, SF, no_docs, odd_docs  # noqa: F401

OPS = [fingerprint.op1_fingerprints, sentencepiece_nbest.op2_sentencepiece, line_dedup.op5_line_dedup, mixing.op6_mixing,
       langid.op7_langid, token_counts.op8_token_counts, simhash.op9_simhash]


@pytest.mark.parametrize("op", OPS, ids=lambda f: f.__name__)
def test_one_row_per_document_on_odd_rows(op, odd_docs):
    ids = sorted(str(r[0]) for r in op(odd_docs).select("doc_id").collect())
    assert ids == sorted(str(r[0]) for r in odd_docs.select("doc_id").collect())


@pytest.mark.parametrize("op", [*OPS, packing.op4_packing], ids=lambda f: f.__name__)
def test_empty_table(op, no_docs):
    assert op(no_docs).count() == 0


def test_stages_on_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    for docs, least in ((odd_docs, 5), (no_docs, 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() >= least, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


# --- 1 -----------------------------------------------------------------------------

def test_common_extension_and_edited_text_against_brute_force():
    for seed in range(200):
        r = random.Random(seed)
        a, b = ("".join(r.choice("abü") for _ in range(r.randint(0, 90))) for _ in range(2))
        x, y = fingerprint.PrefixHash(a), fingerprint.PrefixHash(b)
        i, j = r.randint(0, len(a)), r.randint(0, len(b))
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert fingerprint.common_extension(x, i, y, j) == n
        edited, print_edited, same = fingerprint.Document(a).edited(fingerprint.Document(b))
        cut = len(a) // 3
        assert edited == a[:len(a) - cut] + b[:cut]
        assert print_edited == fingerprint.Document(edited).print
        assert edited[:same] == a[:same] and (same == min(len(a), len(edited)) or edited[same] != a[same])


def test_long_texts_hash_in_slices_alike(monkeypatch):
    text = "".join(random.Random(1).choices("abcdé ", k=5_000))
    whole = fingerprint.Document(text).print
    monkeypatch.setattr(fingerprint, "SLICE", 300)
    assert fingerprint.Document(text).print == whole


def test_fingerprint_query_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r for r in fingerprint.op1_fingerprints(docs, parts=7).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(text, reverse=True)
    for k, i in enumerate(ids):
        nxt = text[ids[(k + 1) % len(ids)]]
        cut = len(text[i]) // 3
        edited = text[i][:len(text[i]) - cut] + nxt[:cut]
        mine, next_ = fingerprint.Document(text[i]).print, fingerprint.Document(nxt).print
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text[i])
        assert got[i].fingerprint == mine and got[i].edited_fingerprint == fingerprint.Document(edited).print
        assert got[i].near_next == fingerprint.likeness(mine, next_) and 0 <= got[i].near_edited <= 1


# --- 2 -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocab():
    return sentencepiece_nbest.Vocabulary(*sentencepiece_nbest.read_model())


#: Every word has ties.
FEW = sentencepiece_nbest.Vocabulary([("a", -1.0, 0), ("aa", -2.0, 1), ("aaa", -3.0, 2), ("ab", -2.0, 3), ("b", -1.0, 4), ("▁", -1.0, 261),
                                      ("▁a", -2.0, 262), ("▁b", -4.0, 263), ("ba", -3.0, 264)], list(range(5, 261)))


def _ways(v, word):
    """All segmentations of a word, best first: (score, ids, starts from the end)."""
    ways = []

    def walk(at, score, ids, starts):
        if at == len(word):
            ways.append((score, ids, starts[::-1]))
        for end in range(at + 1, len(word) + 1):
            for start, s, own in v.edges_to(word, end):
                if start == at:
                    walk(end, score + s, [*ids, *own], [*starts, start])

    walk(0, 0.0, [], [])
    return sorted(ways, key=lambda w: (-round(w[0], 9), w[2]))


def test_word_tables_equal_the_search_and_brute_force(vocab):
    r = random.Random(5)
    for k in range(300):
        v, letters = (FEW, "aab") if k % 2 else (vocab, "▁theraionéq\n")
        word = "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
        ways, best = _ways(v, word), v.nbest(word, 4)
        assert np.allclose([b[0] for b in best], [w[0] for w in ways[:4]])
        assert [(b[1].tolist(), b[2].tolist()) for b in best] == [w[1:] for w in ways[:4]]
        ids, off, score, gap, longer = v.encode_words([word, "zz"])
        if len(best) > 1 and v is FEW:                    # its scores are exact
            assert longer[0] == (best[1][2] < best[0][2]), word
        assert score[0] == pytest.approx(best[0][0])
        if v is vocab:
            assert ids[:off[1]].tolist() == best[0][1].tolist()
        assert gap[0] == pytest.approx(best[0][0] - best[1][0] if len(best) > 1 else np.inf)


@pytest.mark.parametrize("n", [2, 3, 5])
def test_documents_n_best_against_brute_force(vocab, n):
    r = random.Random(n)
    for k in range(120):
        v, letters = (FEW, "aab") if k % 3 else (vocab, "thera")
        text = " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 4)))
        whole = []
        for pick in itertools.product(*[_ways(v, "▁" + w) for w in text.split(" ")]):
            length = np.cumsum([0] + [len(w) + 1 for w in text.split(" ")])
            whole.append((-round(sum(p[0] for p in pick), 9), [int(o) + s for p, o in list(zip(pick, length))[::-1] for s in p[2]],
                          [i for p in pick for i in p[1]]))
        want = sorted(whole)[:n]
        (ids, score, more), = sentencepiece_nbest.encode([text], v, n)
        got = [(score, ids.tolist())]
        for s, edits in more:
            full = ids.tolist()
            for a, b, new in sorted(edits, reverse=True):
                full[a:b] = new
            got.append((s, full))
        assert [round(-s, 9) for s, _ in got] == [w[0] for w in want]
        assert [i for _, i in got][1:] == [w[2] for w in want][1:] and got[0][1] == want[0][2], (text, got, want)


def test_every_segmentation_decodes_to_the_text(vocab):
    odd = ["", "a", "  a  b ", "a▁b", "x" * 500 + "é", "\n\n a\n b", "日本𝔘 q", " ", "tab\tx", "a  ", "▁▁ ▁", "né" * 80 + " o"]
    for text, (ids, score, more) in zip(odd, sentencepiece_nbest.encode(odd, vocab, 4)):
        assert sentencepiece_nbest.decode(ids.tolist(), vocab) == text
        for s, edits in more:
            full = ids.tolist()
            for a, b, new in sorted(edits, reverse=True):
                full[a:b] = new
            assert sentencepiece_nbest.decode(full, vocab) == text and s <= score


@pytest.mark.parametrize("limit", [0, 3])
def test_long_words_equal_the_table(vocab, monkeypatch, limit):
    r = random.Random(6)
    texts = [" ".join("".join(r.choice("theraionx") for _ in range(r.randint(1, 14))) for _ in range(5)) for _ in range(40)]
    want = [(i.tolist(), s, m) for i, s, m in sentencepiece_nbest.encode(texts, vocab, 4)]
    monkeypatch.setattr(sentencepiece_nbest, "LONG_WORD", limit)
    vocab.known.clear()
    assert [(i.tolist(), s, m) for i, s, m in sentencepiece_nbest.encode(texts, vocab, 4)] == want


def test_unspaced_text_of_200000_characters(vocab):
    r = random.Random(8)
    texts = ["x" * 200_000, "".join(r.choices("ACGT", k=200_000))]
    for text in texts:
        (ids, score, more), = sentencepiece_nbest.encode([text], vocab, 3)
        assert len(more) == 2 and score >= more[0][0] >= more[1][0]
        assert sentencepiece_nbest.decode(ids.tolist(), vocab) == text
        for s, edits in more:
            full = ids.tolist()
            for a, b, new in sorted(edits, reverse=True):
                full[a:b] = new
            assert sentencepiece_nbest.decode(full, vocab) == text and s <= score
    lines = sentencepiece_nbest.text_words(["ab\ncd\n\nab ef", "ef"])
    assert [lines[0][k] for k in lines[1]] == ["▁ab", "\n", "cd", "\n", "\n", "ab", "▁ef", "▁ef"] and lines[2].tolist() == [0, 7, 8]


def test_sentencepiece_query_round_trip(spark):
    docs = table(spark, SF, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in sentencepiece_nbest.op2_sentencepiece(docs).collect():
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() and r.n_ids == len(r.ids)
        assert len(r.alternatives) == 2 and r.score >= r.alternatives[0].score >= r.alternatives[1].score


# --- 4 and 8 -------------------------------------------------------------------------

def _bpe():
    import tiktoken
    return tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=tokens.read_ranks(), special_tokens={})


def test_best_fit_decreasing_against_brute_force():
    for seed in range(150):
        r = random.Random(seed)
        top = r.choice([1, 5, 16, 33])
        sizes = [r.randint(1, top) for _ in range(r.randint(0, 60))]
        rows = packing.pack(sizes, top)
        free, brute = [], []
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            fit = [f for f in free if f >= sizes[k]]
            row = free.index(min(fit)) if fit else len(free)
            if not fit:
                free.append(top)
                brute.append([])
            free[row] -= sizes[k]
            brute[row].append(k)
        assert sorted(k for row in rows for k in row) == list(range(len(sizes)))
        assert sorted(sum(sizes[k] for k in row) for row in rows) == sorted(sum(sizes[k] for k in row) for row in brute)


def test_packed_rows_hold_every_document(odd_docs):
    enc = _bpe()
    for length, window in ((64, 1 << 10), (2048, 1 << 23)):
        rows = packing.op4_packing(odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), length, window).collect()
        got = packing.unpack(rows)
        for r in odd_docs.filter("doc_id is not null").collect():
            own = [got[k] for k in sorted(k for k in got if k[0] == r.doc_id)]
            assert np.concatenate(own).tolist() == enc.encode_ordinary(r.text or "") + [tokens.END]
        for r in rows:
            place = np.frombuffer(bytes(r.positions), "<u2")
            assert len(r.ids) == 2 * length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= length
            for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
                assert place[a:b].tolist() == list(range(b - a))


def test_token_counts_over_small_blocks_and_zones(spark, monkeypatch):
    enc = _bpe()
    monkeypatch.setattr(token_counts, "ZONE", 3)
    docs = table(spark, SF, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = token_counts.op8_token_counts(docs, block=100).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(enc.encode_ordinary(t)) for i, t in text.items()}
    at = sorted((r.file, r.ordinal, r.start, r.n_tokens) for r in rows)
    assert all(a[2] + a[3] + 1 == b[2] for a, b in zip(at, at[1:]) if a[0] == b[0])


def test_raw_flat_files(spark, tmp_path):
    r = np.random.default_rng(3)
    want = []
    for f in range(3):
        sizes = r.integers(0, 40, 30).tolist()
        ids = np.concatenate([np.append(r.integers(0, 9, n), 99) for n in sizes] + [np.arange(5 * (f == 1))]).astype("<u2")
        (tmp_path / f"{f}.bin").write_bytes(ids.tobytes())
        want += [(f, k, n, False) for k, n in enumerate(sizes)] + ([(1, 30, 5, True)] if f == 1 else [])
    blocks = token_counts.read_flat_files(spark, str(tmp_path), block=16)
    got = token_counts.count_tokens(blocks, end=99).collect()
    assert sorted((int(x.file[-5]), x.ordinal, x.n_tokens, x.open) for x in got) == sorted(want)


# --- 5, 6 ----------------------------------------------------------------------------

def test_line_dedup_bitmaps(odd_docs):
    got = {r.doc_id: r for r in line_dedup.op5_line_dedup(odd_docs, min_docs=10).collect()}
    assert got[20].n_lines == 2 and got[20].n_dropped == 1
    assert got[20].kept_sha256 == hashlib.sha256(b"text number 0 of some words here").hexdigest()
    assert (got[2].n_lines, got[2].n_dropped, got[3].n_lines) == (1, 0, 1)
    first = {r.doc_id: r.n_dropped for r in line_dedup.op5_line_dedup(odd_docs, min_docs=2, keep="first").collect()}
    assert first[1] == 0 and first[8] == 2 and first[31] == 1      # doc 1 holds the first "shared line", doc 4 the German text


def test_mixing_targets_and_repeats(spark, odd_docs):
    rows = mixing.op6_mixing(odd_docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.op6_mixing(odd_docs.repartition(5)).collect()))
    assert all(r.taken in (0, r.size, 2 * r.size) and r.target <= 2 * r.source_size + 1e-9 for r in rows)
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 40), (None, 50), ("a", 100)], "source string, size long")
    target = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert target == {"a": 250.0, "b": 20.0, "c": 80.0, None: 100.0}


def test_mixing_of_repeated_rows_comes_near_its_targets(spark):
    """1,000 copies of one row draw one number each; so do those without an id, or of another source."""
    rows = [(7, "one two three four", "a")] * 1000 + [(None, "x", "b")] * 600 + [(k, f"word {k} and more", "c") for k in range(1500)]
    rows += [(7, "one two three four", None)] * 50
    docs = spark.createDataFrame([(d, t, "en", s, 1, *EXTRA) for d, t, s in rows], SCHEMA)
    got = mixing.op6_mixing(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.op6_mixing(docs.repartition(3)).collect()))
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for r in got:
        key = r.source_size
        taken[key] += r.taken
        size[key] += r.size
        target[key] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    assert len(target) == 4 and all(abs(taken[k] - target[k]) <= 0.08 * target[k] + 4 for k in target)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(d, t, s) for d, t, s in rows], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    want = con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE})").fetchall()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.size, r.source_size, r.target, r.taken)) for r in got)
    mixed = collections.Counter(r.source for r in mixing.stage_mixing(docs).collect())
    assert {4 * mixed["a"], mixed["b"], 4 * mixed["c"], 4 * mixed[None]} == set(taken.values())


# --- 7 -------------------------------------------------------------------------------

def test_cross_parsing_against_plain_search():
    parser = langid.CrossParser([("x", "the cat and the hat are here"), ("y", "der hund und das haus sind hier")])
    spaces = {"x": "the cat and the hat are here", "y": "der hund und das haus sind hier"}
    for text in ("the hound and das haus", "zzz the", "und hier sind the cat", "a", "haus!!haus"):
        clean = "".join(c if c.isalpha() else " " for c in text.lower())
        clean = " ".join(clean.split(" ")) if "  " not in clean else " ".join(clean.split())
        s, n = parser.symbols([text])
        counts = parser.phrases(s, np.array([0]), n)[:, 0]
        for k, lang in enumerate(parser.langs):
            at = phrases = 0
            while at < len(clean):
                size = 1
                while at + size <= len(clean) and clean[at:at + size] in spaces[lang]:
                    size += 1
                at += max(1, size - 1)
                phrases += 1
            assert counts[k] == phrases, (text, lang)


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in langid.op7_langid(docs).collect() if r.held_out]
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in rows]) > 0.97 and len(rows) > 200
    assert all(0 <= r.score <= 1 for r in rows)


def test_many_scripts_keep_their_letters_apart():
    r = random.Random(4)
    letters = {"en": "abcdefghijklmnopqrstuvwxyz", "ja": "".join(map(chr, range(0x3041, 0x3097))) + "".join(map(chr, range(0x4E00, 0x4E00 + 300))),
               "ko": "".join(map(chr, range(0xAC00, 0xAC00 + 900))), "zh": "".join(map(chr, range(0x5400, 0x5400 + 900)))}

    def text(lang, n):
        return " ".join("".join(r.choices(letters[lang], k=r.randint(2, 6))) for _ in range(n))

    train = [(lang, text(lang, 1500)) for lang in letters for _ in range(3)]
    parser = langid.CrossParser(train)
    seen = {c for _, t in train for c in t if c.isalpha()}
    assert len(seen) > 1500 and len({int(parser.lut[ord(c)]) for c in seen}) == len(seen)
    other = parser.width - 1
    assert all(other not in parser.symbols([t])[0] for _, t in train) and parser.lut[ord("ж")] == other
    want = [lang for lang in letters for _ in range(5)]
    assert parser.predict([text(lang, 40) for lang in want])[0] == want
    odd = langid.CrossParser([("x", "ΟΔΟΣ Kẞİ ǅ")])                # letters whose lower case has other upper cases
    assert odd.width - 1 not in odd.symbols(["ΟΔΟΣ Kẞİ ǅ"])[0]


def test_training_sample_takes_each_id_once(spark):
    rows = [(k, f"text of {k}", "en") for k in range(30)] * 40 + [(k, f"other text of {k}", "en") for k in range(30)] + [(50, "ein Text", "de")] * 90
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ids = {r[0] for r in docs.filter(~langid.held_out(docs.doc_id)).select("doc_id").collect()}
    got = langid.training_texts(docs)
    assert sorted(int(t.split()[-1]) for lang, t in got if lang == "en") == sorted(ids - {50})
    assert [t for lang, t in got if lang == "de"] == ["ein Text"] * (50 in ids)
    assert len(langid.training_texts(docs, 8)) == 8 + (50 in ids)


def test_texts_without_letters_are_undetermined(odd_docs):
    got = {r.doc_id: r.lang_pred for r in langid.op7_langid(odd_docs).collect()}
    assert got[2] == got[3] == got[5] == "und" and got[4] != "und"


# --- 9 -------------------------------------------------------------------------------

def _plain_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def _components(prints, distance):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_query_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    prints = {r.doc_id: _plain_simhash(r.text) for r in docs.collect()}
    want = _components(prints, 4)
    for r in simhash.op9_simhash(docs).collect():
        assert int(r.fingerprint, 16) == prints[r.doc_id] and r.component_id == want[r.doc_id]


@pytest.mark.parametrize("block", [8, 4096])
def test_links_survive_every_plan_and_split(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(12)]
    prints = {k: r.choice(base) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for k in range(260)}
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in set(prints.values())], "fp long")
    want = collections.Counter(_components({v: v for v in set(prints.values())}, 4).values())
    for plan in ([(0xFFFF << 16 * k, t) for k, t in enumerate((0, 1, 0, 0))], [(0xFFFFFFFF, 2), (0xFFFFFFFF << 32, 1)],
                 simhash.make_plan(np.array(list(set(prints.values())), np.uint64), 10 ** 6, 4)):
        comp = connected_components(simhash.find_links(rows, plan, 4)).collect()
        sizes = sorted(collections.Counter(r.root for r in comp).values())
        assert sizes == sorted(n for n in want.values() if n > 1)
        assert sum(t + 1 for _, t in plan) >= 5                              # pigeonhole holds


def test_stage_keeps_one_row_of_each_group_whatever_the_ids(spark):
    r = random.Random(3)
    a, b, c, d = (" ".join(r.choices("river stone garden market winter silver window letter harbour evening".split(), k=60)) for _ in range(4))
    rows = [(3, a), (5, a.upper()), (5, b), (None, c), (None, c.upper()), (None, c), (None, a), (7, d), (7, d), (None, d.upper())]
    for k in range(3):                                             # whichever text of id 5 has the smaller hash
        docs = spark.createDataFrame([(i, f"{t} {k}", "x") for i, t in rows], "doc_id long, text string, lang string")
        got = [(r.doc_id, r.text.lower()) for r in simhash.stage_simhash(docs).collect()]
        assert sorted(got, key=str) == sorted([(i, f"{t} {k}") for i, t in ((3, a), (5, b), (None, c), (7, d))], key=str)


def test_hot_ids_and_rows_without_an_id_are_dealt_to_ranges(spark):
    """An id that holds most rows, and the rows without one, spread over ranges; order and results are those of one range."""
    rows = [(5, f"text {k % 150} of the hot id") for k in range(300)] + [(None, f"no id {k}") for k in range(200)] + [(k, f"doc {k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    dealt = fingerprint.in_order(docs, 16).filter("own")
    sizes = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}
    assert sum(sizes.values()) == 540 and max(sizes.values()) <= 100
    one, many = (sorted(map(str, fingerprint.op1_fingerprints(docs, p).collect())) for p in (1, 16))
    assert one == many and len(one) == 540


def test_packing_of_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None), (3, "c"), (3, "c")], "doc_id long, text string")
    rows = packing.op4_packing(docs.coalesce(1)).collect()
    assert sorted((str(d), p) for r in rows for d, p in zip(r.doc_ids, r.pieces)) == [("3", 0)] * 3 + [("None", 0)] * 2
    assert sum(r.n_tokens for r in rows) == 2 * 3 + 1 + 2 * 2


def test_simhash_components_of_rows_without_an_id(spark):
    same, other = "one two three four five six seven", "completely different words stand here today ok"
    docs = spark.createDataFrame([(None, same), (4, same), (2, same), (None, other), (None, other), (9, None), (None, "")], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.op9_simhash(docs).collect()), key=str)
    by_print = collections.defaultdict(set)
    for *_, fp, comp in got:
        by_print[fp].add(comp)
    assert sorted(map(str, by_print.values())) == ["{2}", "{9}", "{None}"]


# --- pipeline --------------------------------------------------------------------------

def test_pipeline_goes_on_after_the_last_written_stage(spark, monkeypatch, tmp_path):
    made, real = [], list(corpus_pipeline.STAGES)

    def spy(name, stage, fail):
        def run(*args):
            made.append(name)
            if fail and name == "mixing":
                raise RuntimeError("driver lost")
            return stage(*args)
        return run

    base = str(tmp_path / "run")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, spy(n, s, True)) for n, s in real])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, SF, base)
    assert made == ["language_id", "line_dedup", "simhash_near_dedup", "mixing"]
    made.clear()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, spy(n, s, False)) for n, s in real])
    got = corpus_pipeline.run(spark, SF, base)
    assert made == ["mixing", "sentencepiece"] and [p.name for p in (tmp_path / "run").iterdir()] == ["5-sentencepiece"]
    assert sorted(map(str, got.collect())) == sorted(map(str, corpus_pipeline.run(spark, SF).collect()))


def test_pipeline_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents").cache()
    text = {r.doc_id: r for r in docs.collect()}
    kept = corpus_pipeline.keep_languages(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in text.items() if any(c.isalpha() for c in r.text)}
    near = corpus_pipeline.dedup_near(spark, docs, SF)
    want = set(_components({i: _plain_simhash(r.text) for i, r in text.items()}, 4).values())
    assert sorted(r.doc_id for r in near.collect()) == sorted(want)
    mixed = collections.Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SF).collect())
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.op6_mixing(docs).collect()}
    assert all(mixed[i] * size == n for i, (n, size) in taken.items())
