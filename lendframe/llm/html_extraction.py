"""Main text of web pages with site templates removed.

Every element's subtree is hashed; Spark counts on how many different pages of a host each hash
occurs, and subtrees that recur on many of them are deleted. Pages of a host with the same text are
one page. What counts as many is a least number and a share of the host's pages, which is small for
link lists, larger for prose, and larger still for prose inside <article> or <main>, where a
recurring paragraph is mostly the author's. Elements that are never text (scripts, forms, navigation
and the like, by tag, role or class, and those that are hidden) go in any case. A page of any length is
parsed whole, in time that grows with its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.llm.tables import batch_of, mapped, signed, written

#: Pages of a host on which a subtree must occur to count as template.
MIN_PAGES = 5
#: Least share of the host's different pages: for link lists, for prose, for prose in the main element.
SHARES = (0.01, 0.2, 0.5)

# Fixed values of HTML: kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math".split())
INLINE = set("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup "
             "time tt u var label".split())
NEVER = set("nav footer aside form script style noscript template iframe svg math button select textarea dialog head "
            "title object canvas menu".split())
WORDS = set("ad ads advert adverts advertisement advertising banner cookie cookies consent notice notices newsletter "
            "subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments related share sharing "
            "social promo sponsored footer popup modal teaser teasers".split())
#: What may follow a word in a name, and what a name that only speaks of a layout begins with.
ENDINGS = WORDS | set("area bar block box btn button buttons container content footer form group header inner item items left "
                      "link links list main middle outer overlay panel placeholder post posts primary right secondary "
                      "section slot text top bottom title toggle unit widget widgets wrap wrapper".split())
LAYOUT = set("has is no not with without hide show".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())

#: Comments, declarations and odd closing marks end at the next ">"; a tag only begins here.
_MARK = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)|<(?:[!?]|/[^a-zA-Z])", re.S)
#: Up to the end of a tag or an attribute's opening quote; quotes in names and in bare values are plain characters.
_TAG_REST = re.compile(r"(?:[^>=]|=\s*+(?![\"'\s])[^\s>]*+)*+(?:>|=\s*+([\"']))")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_SPLIT = re.compile(r"[_-]+")
_CLOSE = {t: re.compile(rf"</{t}[\s>/]", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "attrs", "parts", "hash", "text", "linked")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.parts, self.hash, self.text, self.linked = tag, attrs, [], 0, 0, 0


def _end_of_tag(html: str, at: int, missing: set[str]) -> int:
    """Where a tag ends, with its ">"; -1 if the page ends first.

    A quote that is never closed holds no value: the tag ends at the next ">". `missing` holds quotes known
    not to occur further on, so that a page with many of them is read in one pass.
    """
    while True:
        m = _TAG_REST.match(html, at)
        if m is None:
            return -1
        if not m[1]:
            return m.end()
        close = -1 if m[1] in missing else html.find(m[1], m.end())
        if close < 0:
            missing.add(m[1])
            return html.find(">", m.end()) + 1 or -1
        at = close + 1


def parse(html: str) -> Node:
    """A tree of nodes and decoded strings; unclosed elements end with their parent or the next block.

    A tag or declaration that the page's end cuts off is markup and goes. Work grows with the length of the
    page: a closing tag is looked for only while an element of its name is open.
    """
    root = Node("")
    stack, blocks, at = [root], [0], 0  # blocks: places in the stack of the elements that are not inline
    missing: set[str] = set()
    open_tags: Counter[str] = Counter()

    def close_from(k: int) -> None:
        for node in stack[k:]:
            open_tags[node.tag] -= 1
        del stack[k:]
        while blocks[-1] >= k:
            blocks.pop()

    while True:
        m = _MARK.search(html, at)
        if m is None:
            stack[-1].parts.append(unescape(html[at:]))
            return root
        if m.start() > at:
            stack[-1].parts.append(unescape(html[at : m.start()]))
        if not m[2]:
            at = m.end() if m[0].startswith("<!--") else html.find(">", m.start() + 2) + 1
            if not at:
                return root
            continue
        at = _end_of_tag(html, m.end(), missing)
        if at < 0:
            return root
        tag, attrs = m[2].lower(), html[m.end() : at - 1]
        if m[1]:
            if open_tags[tag]:
                close_from(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag not in INLINE and tag not in VOID or tag == "hr":
            last = stack[blocks[-1]].tag
            if last == "p" or last == tag and tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
                close_from(blocks[-1])
        node = Node(tag, attrs)
        stack[-1].parts.append(node)
        if tag in VOID or attrs.endswith("/"):
            continue
        if tag in RAW:
            end = _CLOSE[tag].search(html, at)
            at = end.start() if end else len(html)
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append(node)
        open_tags[tag] += 1


def _never(node: Node, inside: bool) -> bool:
    if node.tag in NEVER or node.tag == "header" and not inside:
        return True
    if not node.attrs:
        return False
    for name, a, b, c in _ATTRIBUTE.findall(node.attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and _UNSEEN.search(value) or name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and any(_boilerplate(x) for x in value.split()):
            return True
    return False


def _boilerplate(name: str) -> bool:
    """A whole name or its end is one of WORDS ("site-nav"), or known endings follow one ("share-buttons")."""
    parts = [x for x in _SPLIT.split(name) if x]
    if not parts or parts[0] in LAYOUT:
        return False
    return parts[-1] in WORDS or parts[0] in WORDS and all(x in ENDINGS or x.isdigit() for x in parts[1:])


def digest(root: Node) -> list[Node]:
    """All block elements, their subtrees hashed bottom up."""
    out, todo = [], [(root, False)]
    while todo:
        node, ready = todo.pop()
        if not ready:
            todo.append((node, True))
            todo.extend((x, False) for x in node.parts if isinstance(x, Node))
            continue
        pieces, text, linked = [node.tag], 0, 0
        for x in node.parts:
            if isinstance(x, Node):
                pieces.append(str(x.hash))
                text += x.text
                linked += x.text if x.tag == "a" else x.linked
            else:
                words = " ".join(x.split())
                pieces.append(words)
                text += len(words)
        node.hash, node.text, node.linked = xxhash.xxh3_64_intdigest("\x00".join(pieces)), text, linked
        if node.tag not in INLINE and node.tag not in ("", "html", "body", "head", "meta", "br"):
            out.append(node)
    return out


def _find(root: Node, tag: str, skip: Callable[[Node], bool]) -> list[Node]:
    """The outermost elements of a name that are not skipped and don't lie in a skipped element."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if skip(node):
            continue
        if node.tag == tag:
            out.append(node)
        else:
            todo.extend(x for x in reversed(node.parts) if isinstance(x, Node))
    return out


def _main(root: Node) -> list[Node]:
    """Articles, else main elements, outside what is never text; a wrapper may have a name like "with-sidebar"."""
    for skip in (lambda x: _never(x, True), lambda x: x.tag in NEVER or x.tag in ("article", "main") and _never(x, True)):
        found = _find(root, "article", skip) or _find(root, "main", skip)
        if found:
            return found
    return []


def _kinds(root: Node) -> tuple[list[Node], dict[int, int]]:
    """The main elements, and the kind of each node as its place in SHARES."""
    main = _main(root)
    kinds, todo = {}, [(root, False)]
    at = {id(x) for x in main}
    while todo:
        node, inside = todo.pop()
        inside = inside or id(node) in at
        kinds[id(node)] = 0 if node.linked * 2 > node.text else 2 if inside else 1
        todo.extend((x, inside) for x in node.parts if isinstance(x, Node))
    return main, kinds


def main_text(root: Node, main: list[Node], kinds: dict[int, int], template: dict[int, int]) -> str:
    """template: hash to the highest kind for which the subtree is one."""
    blocks: list[str] = []
    piece: list[str] = []

    def flush():
        text = " ".join("".join(piece).split())
        if text:
            blocks.append(text)
        piece.clear()

    inside = bool(main)
    todo: list = list(reversed(main or [root]))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            piece.append(x)
        elif x.tag == "br":
            piece.append(" ")
        elif x.tag == "hr":
            flush()
        elif _never(x, inside) or kinds[id(x)] <= template.get(x.hash, -1):
            if x.tag not in INLINE:
                flush()
        else:
            block = x.tag not in INLINE and x.tag not in VOID
            if block:
                flush()
                todo.append(None)
            todo.extend(reversed(x.parts))
    flush()
    return "\n".join(blocks)


def host_of(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


def _host_key(url: str | None) -> int:
    return xxhash.xxh3_64_intdigest(host_of(url or ""))


def _subtrees(batches):
    """One row per subtree of a page, and one with hash 0 for the page itself."""
    for batch in batches:
        th = batch.column("th")
        row, hosts, pages, hashes = [], [], [], []
        for i, (url, html) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist())):
            root = parse(html)
            nodes = digest(root)
            main, kinds = _kinds(root)
            found = {n.hash for n in nodes if n.text} | {0}
            row.extend([i] * len(found))
            hosts.extend([_host_key(url)] * len(found))
            pages.extend([xxhash.xxh3_64_intdigest(main_text(root, main, kinds, {}))] * len(found))
            hashes.extend(found)
        yield batch_of(th=th.take(pa.array(np.array(row, np.int64))), host=signed(np.array(hosts, np.uint64)),
                       page=signed(np.array(pages, np.uint64)), hash=signed(np.array(hashes, np.uint64)))


def _packed(batches):
    """Every page compressed by itself, as pages are shuffled to meet their marks; size is that of the whole page."""
    for batch in batches:
        pages = [x.as_buffer() for x in batch.column("html")]
        yield batch_of(page_id=batch.column("page_id"), url=batch.column("url"), th=batch.column("th"),
                       size=pa.array([p.size for p in pages], pa.int64()),
                       packed=pa.array([pa.compress(p, codec="zstd", asbytes=True) for p in pages], pa.binary()))


def _unpacked(packed: bytes, size: int) -> str:
    return pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True).decode() if size else ""


def _extract(batches):
    for batch in batches:
        texts = []
        for packed, size, marks in zip(batch.column("packed"), batch.column("size").to_pylist(), batch.column("marks").to_pylist()):
            root = parse(_unpacked(packed.as_py(), size))
            digest(root)
            main, kinds = _kinds(root)
            texts.append(main_text(root, main, kinds, {m["hash"] & 0xFFFFFFFFFFFFFFFF: m["kind"] for m in marks or ()}))
        yield batch_of(page_id=batch.column("page_id"), url=batch.column("url"), text=pa.array(texts, pa.string()))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              min_pages: int = MIN_PAGES, shares: tuple[float, float, float] = SHARES) -> DataFrame:
    """page_id, url, text for every page row; text is empty where nothing is left.

    A null html is empty; a null or odd url belongs to the host ""; no rows give no rows, and other
    columns of any name are left aside. A subtree on very many pages of a host is one key of a join whose
    other side holds templates alone: adaptive execution splits its rows. Rows of a host with the same text
    (outside the elements that are never text) count as one page. Blocks are joined by line feeds;
    white space in a block is one space.
    """
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), url.alias("url"), html.alias("html"),
                        F.xxhash64(url, html).alias("th"))
    trees = written(mapped(rows, _subtrees, "th long, host long, page long, hash long"), "subtrees")
    counts = trees.groupBy("host", "hash").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= min_pages)
    counts = written(counts, "counts")
    sizes = counts.where("hash = 0").select("host", F.col("n").alias("pages"))
    kind = F.lit(-1)
    for k, share in enumerate(shares):
        kind = F.when(F.col("n") >= F.col("pages") * share, k).otherwise(kind)
    often = counts.where("hash <> 0").join(sizes, "host").select("host", "hash", kind.alias("kind")).where("kind >= 0")
    marks = trees.join(often, ["host", "hash"]).groupBy("th").agg(F.collect_set(F.struct("hash", "kind")).alias("marks"))
    marks = marks.withColumnRenamed("th", "m_th")
    packed = mapped(rows, _packed, "page_id long, url string, th long, size long, packed binary")
    both = packed.join(marks, packed["th"] == marks["m_th"], "left")
    return mapped(both.select("page_id", "url", "size", "packed", "marks"), _extract, "page_id long, url string, text string")
