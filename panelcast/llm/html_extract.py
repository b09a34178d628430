"""Operator 10: main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks. Each block is read as a vector of its
tag path (hashed tags and words of class, id and role of the open elements), a
vector of its hashed words, and a few numbers (length, share of links, place). A
bidirectional LSTM in numpy runs over the whole sequence and labels every block
as main text or not, so each decision sees the whole page.

The labeller is fitted on a bounded sample of ``TRAIN_PAGES`` pages (smallest
hashes of their ids, at most ``TRAIN_CHARS`` characters of each) among those with an
article or main element; a made page gives at most ``TRAIN_BLOCKS`` blocks. Their labels are weak: what lies in the article element
is main text, what lies in navigation, header, footer, aside, form and
the like isn't. So that the labeller learns more layouts than the sample has,
each sampled page is rewritten several times, with another container around the
article and with pieces of ``CHROME`` and ``INSIDE`` (menus, notices, forms,
comments, ...) put in, filled with the page's own words. Seeds are fixed, the
fit is repeatable.

Defined cases
-------------
* no page has an article or main element: the sample is drawn among all pages, and
  the layouts are built round their paragraph text;
* null and empty pages, and pages without main text: text "", n_chars 0;
* white space (also no-break spaces) becomes one space, blocks are joined by \\n;
* repeated rows repeat their result; equal pages get equal text;
* very long and deeply nested pages are read whole: one page's blocks are in memory
  (about 5 KB a block), other pages are read ``BATCH_BYTES`` and ``BATCH_BLOCKS`` at a time;
* attributes of a page never act as labels, whatever their names;
* an empty table returns an empty table; other columns are never looked at.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import PATH_DIM, Block, blocks, bucket

#: Bound of the sample; sequences made of it; passes of the fit.
TRAIN_PAGES, TRAIN_SEQUENCES, PASSES = 192, 500, 12
#: Characters of a sampled page and blocks of a made one that the fit reads.
TRAIN_CHARS, TRAIN_BLOCKS = 200_000, 400
WORD_DIM, HIDDEN = 64, 16
#: Pages and (padded) blocks labelled at a time, bytes of pages parsed at a time.
BATCH_PAGES, BATCH_BLOCKS, BATCH_BYTES = 64, 1 << 13, 1 << 22

#: Layout pieces that aren't main text: (element, classes to choose from).
CHROME = [
    ("nav", ["", "menu", "navbar", "main-nav", "breadcrumbs"]), ("div", ["menu", "nav", "navigation", "topbar", "breadcrumb", "pagination"]),
    ("ul", ["menu", "nav-list", "pager", "links"]), ("header", ["", "site-header", "masthead", "top"]),
    ("div", ["header", "banner", "page-header", "masthead", "logo"]), ("footer", ["", "site-footer", "bottom"]),
    ("div", ["footer", "copyright", "legal", "colophon"]), ("aside", ["", "sidebar", "related", "widget"]),
    ("div", ["sidebar", "side", "right-column", "widget", "related", "recommended", "popular", "trending"]),
    ("div", ["notice", "cookie-notice", "cookie", "consent", "gdpr", "alert", "popup", "modal", "message", "disclaimer", "warning"]),
    ("section", ["notice", "cookies", "newsletter", "related-posts", "promo", "comments"]),
    ("div", ["ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "sponsor", "promo", "banner-ad", "promotion"]),
    ("form", ["", "search", "signup", "login", "contact", "subscribe"]),
    ("div", ["newsletter", "subscribe", "signup", "login", "search", "share", "social", "toolbar"]),
    ("div", ["comments", "comment-list", "comment", "replies", "respond", "discussion", "disqus", "user-comments", "reader-comments"]),
    ("ol", ["comments", "commentlist", "comment-list"]), ("aside", ["notice", "ad", "comments", "promo"]),
]
#: Pieces that also stand inside an article.
INSIDE = ["ad", "advert", "newsletter", "share", "related", "promo", "notice", "comments", "sidebar", "cookie"]
#: Containers of main text: (element, class, outer element and class).
MAIN = [("article", "", None), ("article", "post", None), ("main", "", None), ("div", "content", None), ("div", "main-content", None),
        ("div", "article-body", None), ("div", "entry-content", None), ("div", "post-content", None), ("section", "story", None),
        ("div", "text", ("div", "page")), ("article", "", ("main", "")), ("div", "body", ("article", "")),
        ("div", "content", ("div", "container")), ("section", "article", ("div", "wrapper"))]
PHRASES = ["Subscribe to our newsletter", "We use cookies", "Accept all cookies", "All rights reserved", "Share this", "Read more",
           "Sign up", "Log in", "Search", "Reply", "Advertisement", "Sponsored", "Related articles", "Privacy policy", "Terms of use",
           "Contact us", "Home", "About", "Comments", "Leave a comment", "Follow us", "Posted by", "Menu"]


# --- features ----------------------------------------------------------------------

def word_vector(text: str, cache: dict) -> np.ndarray:
    """Hashed words, log counts scaled to length 1."""
    words = text.lower().split()
    at = []
    for w in words:
        k = cache.get(w)
        if k is None:
            if len(cache) > 400_000:
                cache.clear()
            k = cache[w] = bucket(w, WORD_DIM)
        at.append(k)
    v = np.log1p(np.bincount(at, minlength=WORD_DIM).astype(np.float32))
    return v / max(1e-6, float(np.sqrt(v @ v)))


def numbers(page: list[Block]) -> np.ndarray:
    n = len(page)
    size = np.array([len(b.text) for b in page], np.float32)
    out = np.zeros((n, 6), np.float32)
    out[:, 0] = np.log1p(size) / 6
    out[:, 1] = [b.links for b in page]
    out[:, 2] = np.arange(n) / max(1, n - 1)
    out[:, 3] = size / max(1.0, float(size.max(initial=1)))
    out[:, 4] = [b.text[-1:] in ".!?…" for b in page]
    out[:, 5] = [b.path.size / 40 for b in page]
    return out


def path_bits(b: Block) -> int:
    return b.path.bits | 1 << bucket("l:" + b.last, PATH_DIM)


def path_ids(bits: int) -> list[int]:
    return [k for k in range(PATH_DIM) if bits >> k & 1]


# --- the labeller --------------------------------------------------------------------

def _sig(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a direct path from the inputs, labels in 0 .. 1."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        h, d = HIDDEN, WORD_DIM + 6
        self.w: dict[str, np.ndarray] = {}
        for s in "fb":
            self.w["path_" + s] = np.zeros((PATH_DIM, 4 * h))          # paths never seen add nothing
            self.w["in_" + s] = r.normal(0, 0.1, (d, 4 * h))
            self.w["rec_" + s] = r.normal(0, 0.2, (h, 4 * h))
            bias = np.zeros(4 * h)
            bias[h:2 * h] = 1.0
            self.w["bias_" + s] = bias
        self.w["out"] = r.normal(0, 0.2, (2 * h, 1))
        self.w["path_out"] = np.zeros((PATH_DIM, 1))
        self.w["in_out"] = np.zeros((d, 1))
        self.w["bias_out"] = np.zeros(1)

    def _run(self, z, mask, rec, back: bool, keep: list | None):
        n, t_max, _ = z.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out = np.zeros((n, t_max, HIDDEN))
        k = HIDDEN
        for t in (range(t_max - 1, -1, -1) if back else range(t_max)):
            a = z[:, t] + h @ rec
            ifo = _sig(a[:, :3 * k])
            g = np.tanh(a[:, 3 * k:])
            m = mask[:, t, None]
            c_new = ifo[:, k:2 * k] * c + ifo[:, :k] * g
            tc = np.tanh(c_new)
            if keep is not None:
                keep.append((t, h, c, ifo, g, tc, m))
            c = m * c_new + (1 - m) * c
            h = m * (ifo[:, 2 * k:] * tc) + (1 - m) * h
            out[:, t] = h
        return out

    def logits(self, proj: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """proj: the paths' part of each input projection; x: words and numbers."""
        w, hs = self.w, []
        for s in "fb":
            z = proj[s] + x @ w["in_" + s] + w["bias_" + s]
            steps = None if keep is None else keep.setdefault("steps_" + s, [])
            hs.append(self._run(z, mask, w["rec_" + s], s == "b", steps))
        both = np.concatenate(hs, 2)
        if keep is not None:
            keep["both"] = both
        return (both @ w["out"])[..., 0] + proj["out"][..., 0] + (x @ w["in_out"])[..., 0] + w["bias_out"]

    def gradients(self, paths: np.ndarray, x, mask, y) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of one batch; paths is 0/1 (pages, blocks, PATH_DIM)."""
        w, keep = self.w, {}
        proj = {s: paths @ w["path_" + s] for s in ("f", "b", "out")}
        logit = self.logits(proj, x, mask, keep)
        p = _sig(logit)
        n = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n)
        d = (mask * (p - y) / n)[..., None]
        g = {"out": np.einsum("bth,bto->ho", keep["both"], d), "path_out": np.einsum("btp,bto->po", paths, d),
             "in_out": np.einsum("btx,bto->xo", x, d), "bias_out": d.sum((0, 1))}
        d_both = d @ w["out"].T
        k = HIDDEN
        for s, d_h_out in (("f", d_both[..., :k]), ("b", d_both[..., k:])):
            rec = w["rec_" + s]
            dz = np.zeros((*mask.shape, 4 * k))
            dh, dc = np.zeros((len(x), k)), np.zeros((len(x), k))
            d_rec = np.zeros_like(rec)
            for t, h0, c0, ifo, gg, tc, m in reversed(keep["steps_" + s]):
                dh = dh + d_h_out[:, t]
                i, f, o = ifo[:, :k], ifo[:, k:2 * k], ifo[:, 2 * k:]
                dh_new, dc_new = dh * m, dc * m + dh * m * o * (1 - tc ** 2)
                da = np.concatenate((dc_new * gg * i * (1 - i), dc_new * c0 * f * (1 - f), dh_new * tc * o * (1 - o),
                                     dc_new * i * (1 - gg ** 2)), 1)
                dz[:, t] = da
                d_rec += h0.T @ da
                dh = dh * (1 - m) + da @ rec.T
                dc = dc * (1 - m) + dc_new * f
            g["rec_" + s], g["bias_" + s] = d_rec, dz.sum((0, 1))
            g["in_" + s] = np.einsum("btx,btz->xz", x, dz)
            g["path_" + s] = np.tensordot(paths, dz, ((0, 1), (0, 1)))
        return loss, g

    def fit(self, pages: list[list[Block]], labels: list[list[int]], passes: int = PASSES, seed: int = 3) -> "Labeller":
        """Adam over batches of pages with like lengths, ``TRAIN_BLOCKS`` blocks of each."""
        pages, labels = zip(*[(p[:TRAIN_BLOCKS], y[:TRAIN_BLOCKS]) for p, y in zip(pages, labels) if p])
        cache: dict = {}
        feats = [(np.column_stack((np.stack([word_vector(b.text, cache) for b in p]), numbers(p))), [path_ids(path_bits(b)) for b in p])
                 for p in pages]
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        batches = [order[k:k + 16] for k in range(0, len(order), 16)]
        r = random.Random(seed)
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        sq = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(passes):
            r.shuffle(batches)
            for own in batches:
                t_max = max(len(pages[k]) for k in own)
                x, mask, y = np.zeros((len(own), t_max, WORD_DIM + 6)), np.zeros((len(own), t_max)), np.zeros((len(own), t_max))
                paths = np.zeros((len(own), t_max, PATH_DIM))
                for j, k in enumerate(own):
                    n = len(pages[k])
                    x[j, :n], mask[j, :n], y[j, :n] = feats[k][0], 1, labels[k]
                    for t, ids in enumerate(feats[k][1]):
                        paths[j, t, ids] = 1
                _, g = self.gradients(paths, x, mask, y)
                step += 1
                norm = np.sqrt(sum(float((v ** 2).sum()) for v in g.values()))
                for k, v in g.items():
                    v = v * min(1.0, 5 / (norm + 1e-9))
                    mean[k] = 0.9 * mean[k] + 0.1 * v
                    sq[k] = 0.999 * sq[k] + 0.001 * v * v
                    self.w[k] = self.w[k] - 0.02 * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(sq[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def label(self, pages: list[list[Block]], cache: dict) -> list[np.ndarray]:
        """For each page, whether each block is main text."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        known, words = cache.setdefault("paths", {}), cache.setdefault("words", {})
        groups: list[list[int]] = []
        for k in order:
            # sequences of one batch have like lengths; a very long page is a batch of its own
            if (not groups or len(groups[-1]) == BATCH_PAGES or (len(groups[-1]) + 1) * len(pages[k]) > BATCH_BLOCKS
                    or len(pages[k]) > 4 * len(pages[groups[-1][0]]) + 64):
                groups.append([])
            groups[-1].append(k)
        for some in groups:
            t_max = len(pages[some[-1]])
            x, mask = np.zeros((len(some), t_max, WORD_DIM + 6)), np.zeros((len(some), t_max))
            proj = {"f": np.zeros((len(some), t_max, 4 * HIDDEN)), "b": np.zeros((len(some), t_max, 4 * HIDDEN)),
                    "out": np.zeros((len(some), t_max, 1))}
            for j, k in enumerate(some):
                page = pages[k]
                n = len(page)
                x[j, :n, :WORD_DIM] = [word_vector(b.text, words) for b in page]
                x[j, :n, WORD_DIM:] = numbers(page)
                mask[j, :n] = 1
                for t, b in enumerate(page):
                    key = path_bits(b)
                    if key not in known:
                        if len(known) > 100_000:
                            known.clear()
                        ids = path_ids(key)
                        known[key] = tuple(self.w["path_" + s][ids].sum(0) for s in ("f", "b", "out"))
                    proj["f"][j, t], proj["b"][j, t], proj["out"][j, t] = known[key]
            logit = self.logits(proj, x, mask)
            for j, k in enumerate(some):
                out[k] = logit[j, :len(pages[k])] > 0
        return out


# --- training pages --------------------------------------------------------------------

_ARTICLE = re.compile(r"<(article|main)(?=[\s/>])[^>]*>(.*?)(?:</\1\s*>|\Z)", re.S | re.I)
#: Words of layout names; a block below one of them is no paragraph text.
_LAYOUT = {f"t:{t}" for t in ("nav", "header", "footer", "aside", "form", "button", "select", "figcaption")} | {
    f"c:{w}" for _, classes in CHROME for c in classes for w in c.split("-") if len(w) > 1 and w not in ("main", "right", "column", "page", "list", "top", "site")}


def rewrite(page: str, r: random.Random, plain: bool = False) -> tuple[str, str] | None:
    """A page with known labels made of a sampled page's article, and the name of the attribute
    that carries them, which the page itself doesn't use: the page as it is (plain)
    or another layout around the same text."""
    m = _ARTICLE.search(page)
    if not m:
        return None
    low, nth = page.lower(), 0
    while f"data-label-{nth}" in low:
        nth += 1
    mark = f"data-label-{nth}"
    before, inner, after = page[:m.start()], m[2], page[m.end():]
    if plain:
        return f'<div {mark}="0">{before}</div><article {mark}="1">{inner}</article><div {mark}="0">{after}</div>'.replace(
            "<body", f"<body {mark}=\"0\""), mark
    words = re.sub(r"<[^>]*>|&\S*", " ", inner).split()[:400] or ["text"]
    some = lambda a, b: " ".join(r.choices(words, k=r.randint(a, b)))

    def say() -> str:
        return r.choice(PHRASES) if r.random() < 0.35 else some(1, 14)

    def piece(tag: str, cls: str) -> str:
        attr = f' {r.choice(["class", "id", "class"])}="{cls}"' if cls else ""
        kind = r.random()
        if tag in ("ul", "ol") or kind < 0.3:
            items = "".join(r.choice([f'<li><a href="#">{some(1, 3)}</a></li>', f"<li>{say()}</li>", f"<li><p>{some(3, 30)}</p></li>"])
                            for _ in range(r.randint(1, 7)))
            body = items if tag in ("ul", "ol") else f"<ul>{items}</ul>"
        elif kind < 0.75:
            body = "".join(r.choice([f"<p>{say()}</p>", f"<p>{some(8, 60)}</p>", f"<h{(h := r.randint(1, 4))}>{say()}</h{h}>", f"<div>{some(2, 40)}</div>",
                                     f'<div class="{cls}-item"><p>{some(5, 50)}</p></div>']) for _ in range(r.randint(1, 4)))
        elif tag == "form":
            body = f"<label>{say()}</label><input><button>{say()}</button>"
        else:
            body = say() if r.random() < 0.5 else some(5, 50)
        return f'<{tag}{attr} {mark}="0">{body}</{tag}>'

    def chrome(lo: int, hi: int) -> str:
        out = ""
        for _ in range(r.randint(lo, hi)):
            tag, classes = r.choice(CHROME)
            cls = r.choice(classes)
            if cls and r.random() < 0.3:
                cls = f"{cls} {r.choice(['box', 'wrap', 'block', 'list', 'left', 'small', 'container', 'x1'])}"
            out += piece(tag, cls)
        return out

    parts = re.split(r"(?=<(?:p|h[1-6])\b)", inner)
    body = []
    for part in parts:
        body.append(part)
        u = r.random()
        if u < 0.04:
            body.append(f"<h2>{some(2, 7)}</h2>")
        elif u < 0.08:
            lst = "".join(f"<li>{some(2, 15)}</li>" for _ in range(r.randint(2, 5)))
            body.append(r.choice([f"<ul>{lst}</ul>", f"<ol>{lst}</ol>", f"<blockquote><p>{some(5, 30)}</p></blockquote>",
                                  f"<pre>{some(4, 20)}</pre>", f"<table><tr><td>{some(1, 6)}</td><td>{some(1, 6)}</td></tr></table>",
                                  f"<figure><figcaption>{some(3, 9)}</figcaption></figure>", f"<div>{some(5, 40)}</div>"]))
        elif u < 0.13:
            body.append(piece(r.choice(["div", "aside", "section"]), r.choice(INSIDE)))
    if r.random() < 0.25:
        body.append(r.choice([piece("form", ""), piece("nav", ""), piece("footer", ""), piece("div", "comments"), piece("section", "comments")]))
    tag, cls, outer = r.choice(MAIN)
    main = f'<{tag}{f" {r.choice(["class", "id"])}={cls}" if cls else ""} {mark}="1">{"".join(body)}</{tag}>'
    pre, post = chrome(0, 4), chrome(0, 5)
    if outer:
        o_tag, o_cls = outer
        split = r.random() < 0.5
        main = f'<{o_tag}{f" class={o_cls}" if o_cls else ""} {mark}="0">{chrome(0, 1) if split else ""}{main}{chrome(0, 2)}</{o_tag}>'
    if r.random() < 0.3:
        pre = f'<div class="{r.choice(["wrapper", "container", "page", "site"])}" {mark}="0">' + pre
    return f'<html><body {mark}="0">{pre}{main}{post}</body></html>', mark


def paragraphs(page: str) -> str | None:
    """An article made of a page's paragraph text: blocks outside menus, notices and
    the like, with few links, that are long or end like a sentence (else all blocks)."""
    every = blocks(page)
    below: dict = {None: False}                                         # paths under a layout name

    def in_layout(path) -> bool:
        chain = []
        while path not in below:
            chain.append(path)
            path = path.parent
        for p in reversed(chain):
            below[p] = below[p.parent] or not _LAYOUT.isdisjoint(p.own)
        return below[chain[0] if chain else path]

    own = [b for b in every if b.links < 0.5 and not in_layout(b.path)]
    some = [b for b in own if len(b.text) >= 80 or b.text[-1] in ".!?…"] or own or every
    if not some:
        return None
    return "<article>" + "".join(f"<p>{html.escape(b.text)}</p>" for b in some) + "</article>"


def train(pages: list[str], sequences: int = TRAIN_SEQUENCES, seed: int = 11) -> Labeller:
    """A labeller fitted on the pages with text in an article or main element; where
    there are none, on layouts round the pages' paragraph text (or, if the pages
    have no text at all, round ``PHRASES``)."""
    r = random.Random(seed)
    found, labels = [], []
    usable = [p for p in pages if (m := _ARTICLE.search(p)) and blocks(m[2])]
    share = 0.2 if usable else -1.0                                     # of pages whose own layout is known
    if pages and not usable:
        usable = [a for p in pages if (a := paragraphs(p))] or [f"<article><p>{'. '.join(PHRASES)}.</p></article>"]
    for k in range(sequences if usable else 0):
        page = blocks(*rewrite(usable[k % len(usable)], r, plain=r.random() < share))
        if page:
            found.append(page)
            labels.append([int(bool(b.label)) for b in page])
    model = Labeller()
    return model.fit(found, labels) if found else model


def extract(pages: list[str | None], model: Labeller, cache: dict) -> list[str]:
    found = [blocks(p) for p in pages]
    return ["\n".join(b.text for b, keep in zip(page, main) if keep) for page, main in zip(found, model.label(found, cache))]


def op10_html(pages: DataFrame, sample: int = TRAIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    keyed = pages.filter(F.col("html").isNotNull()).select(F.xxhash64("page_id", "url").alias("h"), "html")
    # the bounded sample, of pages with an article where there are any: hashes first, then the pages below the last of them
    with_article = keyed.filter(F.col("html").rlike(r"(?i)<(?:article|main)[\s/>]"))
    for keyed in (with_article, keyed):
        hashes = [r["h"] for r in keyed.select("h").distinct().orderBy("h").limit(sample).collect()]
        if hashes:
            break
    chosen = (keyed.filter(F.col("h") <= hashes[-1]).groupBy("h")          # pages that share an id: by their text
              .agg(F.min_by(F.substring("html", 1, TRAIN_CHARS), F.xxhash64("html")).alias("html")).collect() if hashes else [])
    rows = sorted(chosen, key=lambda r: r["h"])
    weights = {k: v.astype(np.float32) for k, v in train([r["html"] for r in rows]).w.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller()
        model.w = weights
        cache: dict = {}
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False))
            hi = 0
            while hi < b.num_rows:
                lo, done = hi, int(size[hi - 1]) if hi else 0
                hi = max(lo + 1, int(np.searchsorted(size, done + BATCH_BYTES, side="right")))
                part = b.slice(lo, hi - lo)
                text = extract(part.column(2).to_pylist(), model, cache)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()),
                                                  pa.array([len(t) for t in text], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    src = pages.select("page_id", "url", "html")
    schema = src.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return src.mapInArrow(run, schema)
