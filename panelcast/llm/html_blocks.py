"""Leaf blocks of an HTML page: text, tag path, share of link text.

A block's path is one object that the blocks below the same element share and that links
to its parent, so the memory of a page grows with its size, however deep it nests."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from typing import NamedTuple

#: Elements that end and begin a block of text (fixed values of the language).
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav noscript object ol option "
    "p pre section select summary table tbody td textarea tfoot th thead title tr ul video audio".split())
VOID_TAGS = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: A start tag of the first closes an open element of the second, unless one of the third is nearer.
CLOSES = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
          "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
          "option": ("option", ("select",))}
#: Their content is raw text up to the end tag or the end of the page.
RAW_TAGS = "script|style"
#: Their content isn't shown: skipped up to the end tag, if there is one.
SKIP_TAGS = frozenset("template svg iframe canvas".split())
#: What can stand in a head; any other tag, and text, ends it.
HEAD_TAGS = frozenset("html head title base basefont bgsound link meta noscript noframes script style template".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({RAW_TAGS})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"'<]+|\"[^\"<]*\"|'[^'<]*')*)|[^>]*?)(?:>|\Z)",
    re.S | re.I)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in (*SKIP_TAGS, "noscript")}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: Buckets of hashed path features.
PATH_DIM = 1024


def bucket(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


class Path:
    """An open element and those around it: ``bits`` are the hashed features of all of
    them, ``size`` their number, ``label`` the nearest label (made training pages only)."""

    __slots__ = ("parent", "own", "bits", "size", "label")

    def __init__(self, parent: Path | None, own: tuple[str, ...], label: int | None = None):
        self.parent, self.own = parent, own
        self.size = len(own) + (parent.size if parent else 0)
        self.bits = parent.bits if parent else 0
        for t in own:
            self.bits |= 1 << bucket(t, PATH_DIM)
        self.label = label if label is not None else parent.label if parent else None

    def __contains__(self, token: str) -> bool:
        at: Path | None = self
        while at is not None:
            if token in at.own:
                return True
            at = at.parent
        return False


NOWHERE = Path(None, ())


class Block(NamedTuple):
    text: str
    path: Path
    last: str                  # the innermost block element
    links: float               # share of the text that is inside links

    @property
    def label(self) -> int | None:
        return self.path.label


def path_tokens(tag: str, attrs: str, marker: str | None = None) -> tuple[tuple[str, ...], int | None]:
    """Tag, and words and word beginnings of class, id and role. ``marker`` is the
    attribute that carries the labels of a made page; a page's own attributes never do."""
    out, label = ["t:" + tag], None
    if "=" in attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if marker is not None and name == marker:
                label = int(value)
            elif name in ("class", "id", "role"):
                for word in _NAME.findall(value):
                    word = word.lower()
                    out += ["c:" + word, "p:" + word[:4]]
    return tuple(out), label


def blocks(page: str | None, marker: str | None = None) -> list[Block]:
    """Leaf blocks in page order. Comments, scripts, styles and closed templates,
    svg, iframe and canvas elements are no text (``/>`` closes one of the latter, and
    an end tag that is missing skips nothing); <br> is white space; character
    references are decoded; a broken end of the page ends its last tag; the head
    ends at the first tag or text that can't stand in it."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []
    opened: Counter[str] = Counter()                           # tags in the stack
    text: list[str] = []
    linked, in_link, at = 0, 0, 0
    head_at = 0                                                # where the head stands in the stack, if it is open
    endless: set[str] = set()                                  # tags that aren't closed from here on

    def flush():
        nonlocal linked
        words = " ".join("".join(text).split())
        if words:
            last, path = stack[-1] if stack else ("", NOWHERE)
            if not opened["head"]:
                out.append(Block(words, path, last, min(1.0, linked / len(words))))
        text.clear()
        linked = 0

    def shut(first: int):
        """Close the elements from ``first`` on."""
        for t, _ in stack[first:]:
            opened[t] -= 1
        del stack[first:]

    def put(raw: str):
        nonlocal linked
        if raw:
            if stack and stack[-1][0] == "head" and not raw.isspace():
                shut(len(stack) - 1)
            raw = html.unescape(raw) if "&" in raw else raw
            text.append(raw)
            if in_link:
                linked += len(raw)

    while m := _TOKEN.search(page, at):
        put(page[at:m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                text.append(" ")
            continue
        tag = tag.lower()
        in_head = head_at < len(stack) and stack[head_at][0] == "head"
        if not m[2] and (tag in SKIP_TAGS or in_head and tag == "noscript"):
            end = None
            if not (m[4] or "").endswith("/") and tag not in endless:
                end = _END[tag].search(page, at)
                if end is None:
                    endless.add(tag)
            if end:
                at = end.end()
                text.append(" ")
                continue
        if in_head and not m[2] and tag not in HEAD_TAGS:
            flush()
            shut(head_at)
        if tag == "head" and not m[2]:
            if in_head:
                continue
            flush()
            if stack and stack[-1][0] == "p":
                shut(len(stack) - 1)
            head_at = len(stack)
        if tag == "a":
            in_link = 0 if m[2] else 1
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            if m[2]:
                if opened[tag]:
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    shut(k)
                    in_link = 0
                continue
            if stack and stack[-1][0] == "p":
                shut(len(stack) - 1)                           # a paragraph ends where another block begins
            if tag in CLOSES:
                ended, fence = CLOSES[tag]
                if any(opened[t] for t in ended.split()):
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in fence:
                            break
                        if stack[k][0] in ended.split():
                            shut(k)
                            break
            if tag == "body":
                roots = [p for t, p in stack if t == "html"]
                shut(0)
                for p in roots:
                    stack.append(("html", Path(stack[-1][1] if stack else None, p.own, p.label)))
                    opened["html"] += 1
            if tag not in VOID_TAGS:
                own, label = path_tokens(tag, m[4] or "", marker)
                stack.append((tag, Path(stack[-1][1] if stack else None, own, label)))
                opened[tag] += 1
    put(page[at:])
    flush()
    return out
