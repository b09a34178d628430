"""Approximate nearest neighbours and HTML extraction."""

import random
import time
import tracemalloc
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import ann, html_blocks, html_extract
from panelcast.llm.common import table

from llm_docs import SF


def _exact(rows, k=20):
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            near = sorted((-float(np.dot(x, y)), i) for i, y in rows if i != q)[:k]
            out[q] = [i for _, i in near]
    return out


@pytest.mark.parametrize("block_rows", [ann.BLOCK_ROWS, 700])
def test_recall_against_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(ann, "BLOCK_ROWS", block_rows)
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect()]
    want, got = _exact(rows), {}
    for r in ann.op3_ann(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    vec = dict(rows)
    hits = 0
    for q, near in got.items():
        near.sort()
        assert [n[0] for n in near] == list(range(1, 21))
        assert [(-s, i) for _, i, s in near] == sorted((-s, i) for _, i, s in near)
        assert all(abs(float(np.dot(vec[q], vec[i])) - s) < 1e-12 for _, i, s in near)
        hits += len({n[1] for n in near} & set(want[q]))
    assert set(got) == set(want) and hits / (20 * len(want)) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [float(k % 7), 1.0, -float(k % 3)]) for k in range(45)]
    bad = [(100, None), (120, [0.0, 0.0, 0.0]), (140, [nan, 1.0, 1.0]), (160, [inf, 1.0, 1.0]), (180, [1.0, None, 1.0]),
           (200, [1.0]), (None, [1.0, 1.0, 1.0]), (220, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in good + bad], "vec_id long, embedding array<double>, key string, block int")
    want = {q: near for q, near in _exact([(i, np.array(v)) for i, v in good]).items()}
    got = {}
    for r in ann.op3_ann(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want
    few = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [2.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in ann.op3_ann(few).collect()) == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]
    assert ann.op3_ann(df.limit(0)).count() == 0


def test_lists_of_other_pivots_are_not_read():
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 16))
    p = np.column_stack((x[:ann.PIVOTS], np.zeros(ann.PIVOTS)))
    block = ann.Block(x, p, float(np.sqrt((x ** 2).sum(1).max())))
    own = block.prefix(x[:1], 0.0)[0]
    places = np.full((len(x), ann.PIVOTS), ann.PREFIX)
    np.put_along_axis(places, block.prefix(x, 1.0), np.arange(ann.PREFIX)[None], 1)
    asked = np.full(ann.PIVOTS, ann.PREFIX)
    asked[own] = np.arange(ann.PREFIX)
    distance = np.abs(places - asked).sum(1)                       # footrule over all pivots
    want = block.candidates(own, 300)
    assert sorted(distance[want]) == sorted(distance)[:300]
    for q in set(range(ann.PIVOTS)) - set(own.tolist()):           # spoil every other list
        block.rows[block.first[q]:block.first[q + 1]] = -1
    assert (block.candidates(own, 300) == want).all()


def test_repeated_ids_and_equal_vectors_lose_nothing(spark):
    r = random.Random(5)
    vec = lambda: [r.uniform(-1, 1) for _ in range(6)]
    rows = [(k, vec()) for k in range(100, 165)] + [(20, vec()) for _ in range(25)] + [(40, [1.0] * 6)] * 30
    rows += [(k, [0.5] * 6) for k in range(1000, 1100)] + [(60, vec())] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in ann.op3_ann(df).collect():
        got.setdefault(x.query_id, []).append((x["rank"], -x.score, x.vec_id))
    once = sorted({(i, tuple(v)) for i, v in rows})
    for q in {i for i, _ in rows if i % 20 == 0}:
        want = []
        for v in {v for i, v in once if i == q}:
            near = sorted((-float((np.array(v) * np.array(w)).sum()), i) for i, w in once if i != q)[:20]
            want += [(k + 1, s, i) for k, (s, i) in enumerate(near)]
        assert len(got[q]) == len(want) and all(
            a[0] == b[0] and a[2] == b[2] and abs(a[1] - b[1]) < 1e-12 for a, b in zip(sorted(got[q]), sorted(want)))


PAGE = ('<html><head><title>t</title></head><body><header><h2>Site name</h2><nav><a href=x>Home</a></nav></header><main><article><h1>Title</h1>'
        '<p>First &amp; foremost,<br>a paragraph\n of text.<!-- no --><script>x("</p>")</script><ul><li>one</li><li>two</li></ul>'
        '<div class="ad">Buy now</div><p>Last <b>bold</b>word.</article><section class="comments"><p>I like this text a lot.</p></section></main>'
        '<aside class="sidebar"><p>Other story</p></aside><form><label>Mail</label></form><footer>(c)')
TEXT = "Title\nFirst & foremost, a paragraph of text.\none\ntwo\nLast boldword."


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in table(spark, "/root/testdata/sf0.1", "pages").orderBy("page_id").limit(500).collect()]


@pytest.fixture(scope="module")
def model(pages):
    return html_extract.train(pages[:150])


def test_blocks_of_a_page():
    got = html_blocks.blocks(PAGE)
    assert [b.text for b in got if "t:article" in b.path and "c:ad" not in b.path] == TEXT.split("\n")
    assert html_blocks.blocks(None) == html_blocks.blocks("") == html_blocks.blocks("<p> <br></p><style>a") == []


@pytest.mark.parametrize("page, want", [
    ("<p>a <svg class=i viewBox='0 0 1 1'/> b</p><p>c</p>", ["a b", "c"]),
    ("<p>a <svg><title>no</title></svg> b</p><p>c</p>", ["a b", "c"]),
    ("<header><svg/></header><p>a</p><svg><path/></svg><p>b</p>", ["a", "b"]),
    ("<p>a <math/> b</p><p>c</p>", ["a b", "c"]),
    ("<p>a <math><mi>x</mi></math> b</p>", ["a x b"]),
    ("<p>a</p><noscript><p>b</p></noscript><object data=x><p>c</p></object><p>d</p>", ["a", "b", "c", "d"]),
    ("<p>a</p><object><p>b</p>", ["a", "b"]),
    ("<p>a</p><canvas><p>b</p>", ["a", "b"]),
    ("<p>a</p><canvas>no</canvas><template><p>no</p></template><iframe>no</iframe><svg>b", ["a", "b"]),
    ("<object-list><p>a</p></object-list><template-box><p>b</p></template-box><script-x>c</script-x>", ["a", "b", "c"]),
    ("<p>a</p><script>no<p>no", ["a"]),
    ("<html><head><title>no</title><meta x=y><style>no</style><h1>a</h1><p>b</p>", ["a", "b"]),
    ("<head><title>no</title><noscript><img src=x></noscript><link x></head><body><p>a</p>", ["a"]),
    ("<head><title>no</title><noscript><p>a</p>", ["a"]),
    ("<head><title>no</title> a<b>b</b><p>c", ["ab", "c"]),
    ("<head><title>no</title><img src=x><a href=y>a</a><p>c", ["a", "c"]),
])
def test_nothing_but_hidden_elements_is_dropped(page, want):
    assert [b.text for b in html_blocks.blocks(page)] == want


def test_many_unclosed_elements_take_linear_time():
    assert len(html_blocks.blocks("<p>a<svg><canvas>" * 40_000)) == 40_000


def test_main_text_of_a_page(model):
    assert html_extract.extract([PAGE, "", None], model, {}) == [TEXT, "", ""]


def test_held_out_layouts(model, pages):
    r = random.Random(99)
    made = [html_blocks.blocks(*html_extract.rewrite(p, r)) for p in pages[200:400]]
    found = model.label(made, {})
    right = [(b.label == 1) == bool(f) for page, own in zip(made, found) for b, f in zip(page, own)]
    assert np.mean(right) > 0.99


def _div_page(k):
    r = random.Random(k)
    words = "river stone garden market winter silver window letter harbour evening village bridge".split()
    body = [" ".join(r.choices(words, k=r.randint(15, 40))) + "." for _ in range(r.randint(2, 6))]
    menu = "".join(f"<li><a href=#>{r.choice(words)}</a></li>" for _ in range(5))
    page = (f'<html><head><title>t</title></head><body><div class="menu"><ul>{menu}</ul></div><div class="content">'
            + "".join(f"<p>{p}</p>" for p in body) + '</div><div class="sidebar"><a href=#>Read more</a></div><div class="footer">All rights reserved</div></body></html>')
    return page, "\n".join(body)


def test_pages_of_divs_only(spark):
    made = [_div_page(k) for k in range(60)]
    df = spark.createDataFrame([(k, "u", page) for k, (page, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.op10_html(df).collect()}
    assert np.mean([got[k] == text for k, (_, text) in enumerate(made)]) > 0.95


def test_sample_is_drawn_among_pages_with_an_article(spark, monkeypatch):
    seen = []
    real = html_extract.train
    monkeypatch.setattr(html_extract, "train", lambda pages: seen.extend(pages) or real(pages, 2))
    rows = [(k, "u", _div_page(k)[0]) for k in range(400)] + [(1000 + k, "u", PAGE) for k in range(3)]
    html_extract.op10_html(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert seen == [PAGE] * 3


def test_gradients(pages):
    m = html_extract.Labeller()
    r = np.random.default_rng(1)
    for k in ("path_f", "path_b", "path_out", "in_out"):
        m.w[k] = r.normal(0, 0.1, m.w[k].shape)
    paths = (r.random((2, 4, html_extract.PATH_DIM)) < 0.01).astype(float)
    x, mask, y = r.normal(size=(2, 4, html_extract.WORD_DIM + 6)), np.array([[1, 1, 1, 1], [1, 1, 0, 0.0]]), np.array([[1, 0, 1, 1], [0, 1, 0, 0.0]])
    _, g = m.gradients(paths, x, mask, y)
    for k, v in g.items():
        at = np.unravel_index(np.abs(v).argmax(), v.shape)
        keep = m.w[k][at]
        m.w[k][at] = keep + 1e-5
        up = m.gradients(paths, x, mask, y)[0]
        m.w[k][at] = keep - 1e-5
        down = m.gradients(paths, x, mask, y)[0]
        m.w[k][at] = keep
        assert abs((up - down) / 2e-5 - v[at]) < 1e-5, k


@pytest.mark.parametrize("value", ["Price", "", "1", "0", "-3", "&amp;"])
def test_labels_of_a_page_are_only_attributes(model, value):
    page = PAGE.replace("<p>", f'<p data-label="{value}" data-label-0="{value}" data-id="content" DATA-LABEL-1={value or "x"}>')
    assert html_extract.extract([page], model, {}) == [TEXT]
    assert {b.label for b in html_blocks.blocks(page)} == {None}
    assert not any("c:content" in b.path for b in html_blocks.blocks(page))
    for plain in (True, False):
        made, mark = html_extract.rewrite(page, random.Random(1), plain)
        assert mark == "data-label-2" and {b.label for b in html_blocks.blocks(made, mark)} == {0, 1}
    html_extract.train([page], 3)


def test_deep_pages_take_linear_time_and_memory():
    def measure(n):
        tracemalloc.start()
        t = time.process_time()
        page = html_blocks.blocks('<div class="wrap">a' * n + "</ul></td><td>" * 50)
        t = time.process_time() - t
        size = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(page) == n and page[-1].path.size == 3 * n and "c:wrap" in page[-1].path
        return t, size
    measure(100)
    (t1, m1), (t2, m2) = measure(5_000), measure(20_000)
    assert t2 < 10 * t1 + 0.5 and m2 < 5 * m1 and m2 < 50 << 20


def test_a_page_of_100000_blocks(model):
    page = "<html><body><nav><a href=x>Home</a></nav><article>" + "<p>First of some text.</p>" * 100_000 + "</article></body></html>"
    assert html_extract.extract([page], model, {})[0].count("First of some text.") == 100_000


def test_batches_change_nothing(model, pages, monkeypatch):
    want = html_extract.extract(pages[:40], model, {})
    monkeypatch.setattr(html_extract, "BATCH_BLOCKS", 30)
    assert html_extract.extract(pages[:40], model, {}) == want


class _Article(HTMLParser):
    """Text of the article element by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth, self.hidden, self.text, self.out = 0, 0, [], []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        line = " ".join("".join(self.text).split())
        self.out += [line] if line else []
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in html_blocks.BLOCK_TAGS:
            self.end()
        self.depth += tag == "article"
        self.hidden += tag in ("script", "style")
        if tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in html_blocks.BLOCK_TAGS:
            self.end()
        self.depth -= tag == "article"
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        if self.depth and not self.hidden:
            self.text.append(data)


def test_query_equals_another_parser_on_all_pages(spark):
    real = table(spark, "/root/testdata/sf0.1", "pages")
    got = {r.page_id: r.text for r in html_extract.op10_html(real).collect()}
    wrong = [r.page_id for r in real.collect() if got[r.page_id] != "\n".join(_Article(r.html).out)]
    assert len(got) == real.count() and not wrong


def test_sample_of_repeated_ids_is_repeatable(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(html_extract, "train", lambda pages: seen.append(pages) or html_extract.Labeller())
    rows = [(1, "u", PAGE.replace("First", f"Text {k}")) for k in range(50)] + [(2, "u", PAGE + "x" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for some in (df, df.repartition(7), df.orderBy(F.rand(1))):
        html_extract.op10_html(some)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 2
    assert max(map(len, seen[0])) == html_extract.TRAIN_CHARS


def test_query_on_odd_pages(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, None, "", "y"), (3, "v", "<p>" * 3000 + "deep", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.op10_html(df).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.op10_html(df.limit(0)).count() == 0
    real = table(spark, SF, "pages")
    for r in html_extract.op10_html(real).join(real, "page_id").select("text", "html").collect():
        page = [b for b in html_blocks.blocks(r.html) if "t:article" in b.path]
        assert r.text == "\n".join(b.text for b in page)
