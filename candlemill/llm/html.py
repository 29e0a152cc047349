"""Main text of web pages: a suffix array over each host's pages decides what structure leaves open.

A small tag reader cuts a page into blocks of text and notes where each stands. Menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are junk by their
element, role or whole class or id word. An article in a junk box is a teaser and goes, unless the page
has no other: then class words and forms around it prove nothing, as layouts name their wrappers so
(LIFTS gives the order); menus, headers, footers and sidebars by element or role stay junk. So does a
header inside the article, title included. Plain blocks of an article (or of a main element, where there is no article) are the
text, whole, whatever repeats. The rest is open: on a page without article or main every block that
is not junk, elsewhere blocks in boxes of the article whose compound class or id holds a junk word
(ad-free, menu-board), and blocks of main beside the article. For these the token streams of the
host's pages, junk included and plain article text left out, are concatenated, a suffix array finds
runs of at least MIN_RUN tokens that stand on two or more distinct pages, and open blocks that such
runs cover are boilerplate and go; unique runs stay. A host of more than SHARD_PAGES pages is read in
shards; the shards' runs are then counted together over the host, so the split changes no result.

Null or empty html, and pages without blocks, give empty text; a table without pages gives none. A
page without url belongs to the host "". Tags left open end with what holds them; text cut off in a
tag or character reference is kept as far as it goes. References are decoded in each piece of text
between tags by itself. Very long texts are blocks like others. Repeated pages are pages of their
own and all returned, but equal streams count as one page, so copies do not make boilerplate of
themselves. Only page_id, url and html are read; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlemill.llm.common import read, small, table

MIN_RUN, COVERED, SHARD_PAGES = 8, 0.8, 2000
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>?|<[!?][^>]*>?", re.S)
_MARK = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
_DROP = frozenset(("head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "canvas", "object", "audio", "video"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_BLOCK = frozenset((
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
))
_BOX = frozenset(("div", "section", "ul", "ol", "dl", "p", "span", "table", "article", "figure", "details"))
#: Whole class or id words that name reader comments; articles in them are comments too.
_COMMENTS = frozenset(("comment", "comments", "comment-list", "comments-list", "comment-section", "comments-section", "comments-area", "disqus", "disqus_thread", "discussion", "replies", "respond"))
#: Other whole class or id words that name junk.
_JUNK = _COMMENTS | frozenset((
    "nav", "navbar", "navigation", "main-nav", "site-nav", "menu", "main-menu", "breadcrumb", "breadcrumbs", "header", "site-header", "page-header", "footer", "site-footer", "page-footer",
    "sidebar", "left-sidebar", "right-sidebar", "aside", "widget", "widgets", "widget-area", "notice", "cookie", "cookies", "cookie-notice", "cookie-banner", "cookie-bar", "cookie-consent", "consent", "banner",
    "alert", "ad", "ads", "ad-banner", "ad-container", "ad-slot", "advert", "adverts", "advertisement", "advertising", "promo", "promotion", "sponsor", "sponsored", "share", "sharing", "social", "share-buttons",
    "social-links", "related", "related-posts", "recommended", "newsletter", "newsletter-signup", "subscribe", "subscription", "signup", "login", "search", "search-form", "popup", "modal", "overlay", "pagination", "pager",
))
#: Junk words as parts of a compound word prove nothing; the suffix array decides.
_PARTS = frozenset(w for w in _JUNK if w.isalpha())
_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert"))


def _marks(attributes: str) -> tuple[set, str]:
    words, role = set(), ""
    for name, *values in _MARK.findall(attributes):
        value = "".join(values).lower()
        if name.lower() in ("class", "id"):
            words.update(value.split())
        else:
            role = value
    return words, role


class _Box:
    """An element that is junk, is hinted to be, or is an article or main."""

    __slots__ = ("junk", "comments", "hint", "main", "weak", "holds")

    def __init__(self, tag: str, attributes: str):
        words, role = _marks(attributes) if "=" in attributes else ((), "")
        self.comments = tag in _BOX and not _COMMENTS.isdisjoint(words)
        strong = (tag in _DROP and tag != "form") or role in _ROLES
        self.junk = self.comments or strong or tag == "form" or (tag in _BOX and not _JUNK.isdisjoint(words))
        self.weak, self.holds = not (strong or self.comments), False
        self.main = "" if self.junk else "article" if tag == "article" or role in ("article", "articlebody") else "main" if tag == "main" or role == "main" else ""
        self.hint = not self.junk and not self.main and tag in _BOX and any(not _PARTS.isdisjoint(re.split(r"[^a-z0-9]+", w)) for w in words)

    def __bool__(self) -> bool:
        return self.junk or self.hint or bool(self.main)


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(place, text) of each block in page order; place is article, open or junk.

    On a page with an article or main, what stands outside it is junk.
    """
    page = page or ""
    found: list[tuple[tuple, str]] = []
    stack: list[tuple[str, _Box | None]] = []
    opened: dict[str, int] = {}
    boxes: tuple[_Box, ...] = ()
    text: list[str] = []

    def end() -> None:
        if text:
            words = " ".join("".join(text).split())
            if words:
                found.append((boxes, words))
            text.clear()

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            text.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if page[at - 1] != ">" and page[at : at + 1] in ('"', "'"):  # a quote that never closes
            at = page.find(">", at) + 1 or len(page)
        if m[1]:
            if tag in _BLOCK:
                end()
            elif tag in ("td", "th"):
                text.append(" ")
            if opened.get(tag):
                while True:
                    name, box = stack.pop()
                    opened[name] -= 1
                    if box:
                        end()
                        boxes = boxes[:-1]
                    if name == tag:
                        break
            continue
        if tag in _BLOCK:
            end()
        elif tag == "br" or tag in ("td", "th"):
            text.append(" ")
        if tag in _RAW:
            close = _RAW[tag].search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in _VOID or m[0].endswith("/>"):
            continue
        box = _Box(tag, m[3]) if m[3] or tag in _DROP or tag in ("article", "main") else None
        if box:
            end()
            if box.main and not any(b.comments or b.main == "article" for b in boxes):
                for b in boxes:
                    b.holds = True
            boxes = (*boxes, box)
        stack.append((tag, box))
        opened[tag] = opened.get(tag, 0) + 1
    if at < len(page):
        rest = page[at:]
        text.append(html.unescape(rest) if not re.match(r"<[/!?a-zA-Z]", rest) else "")
    end()
    return _placed(found)


#: Order in which a page's text is looked for: whether weak marks of boxes around an article or main are lifted, the element, and the one around it.
LIFTS = ((False, "article", ""), (True, "article", "main"), (False, "main", ""), (True, "article", ""), (True, "main", ""))


def _kind(boxes: tuple, lift: bool) -> tuple[bool, str, bool, bool]:
    """(junk, article or main or neither, hinted, whether an article lies in a main) of a block in boxes."""
    lifted = [lift and b.holds and b.weak for b in boxes]
    mains = {b.main for b in boxes}
    return (
        any(b.junk and not x for b, x in zip(boxes, lifted)), "article" if "article" in mains else "main" if "main" in mains else "",
        any(b.hint and not x for b, x in zip(boxes, lifted)), {"article", "main"} <= mains,
    )


def _placed(found: list[tuple[tuple, str]]) -> list[tuple[str, str]]:
    plain = [_kind(boxes, False) for boxes, _ in found]
    lifted = [_kind(boxes, True) for boxes, _ in found] if any(b.holds for boxes, _ in found for b in boxes) else plain
    kinds, best = lifted, ""
    for lift, main, around in LIFTS:
        of = lifted if lift else plain
        if any(not junk and own == main and (not hint or lift) and (inside or not around) for junk, own, hint, inside in of):
            kinds, best = of, main
            break
    out = []
    for (junk, main, hint, _), (_, words) in zip(kinds, found):
        out.append(("junk" if junk or (best and not main) else "open" if hint or main != best or not best else "article", words))
    return out


def suffix_classes(tokens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of tokens as far as length (a power of two) decides, and each suffix's rank.

    Prefix doubling: suffixes of equal rank agree in their first length tokens.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order, size = np.argsort(rank, kind="stable"), 1
    while size < length:
        after = np.r_[rank[size:], np.full(min(size, len(rank)), -1)]
        pair = rank * (len(rank) + 1) + after + 1
        order = np.argsort(pair, kind="stable")
        ranked = pair[order]
        new = np.empty_like(rank)
        new[order] = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]])
        rank, size = new, 2 * size
    return order, rank


def repeated(streams: list[list[str]], pages: list[int]) -> list[np.ndarray]:
    """For each page's tokens, which lie in a run of MIN_RUN that stands on another distinct page too."""
    known: dict[str, int] = {}
    own = [[known.setdefault(t, len(known)) for t in s] for s in streams]
    flat, page = [], []
    for k, (s, p) in enumerate(zip(own, pages)):
        flat += [*s, len(known) + k]  # an end of its own: no run crosses it
        page += [p] * (len(s) + 1)
    tokens, page = np.array(flat, np.int64), np.array(page, np.int64)
    if not len(tokens):
        return [np.zeros(0, bool) for _ in streams]
    order, rank = suffix_classes(tokens, MIN_RUN)
    ranked, paged = rank[order], page[order]
    begin = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    wide = np.minimum.reduceat(paged, begin) != np.maximum.reduceat(paged, begin)
    many = np.zeros(len(tokens), bool)
    many[order] = np.repeat(wide, np.diff(np.r_[begin, len(order)]))
    cover = np.zeros(len(tokens) + MIN_RUN, bool)
    for d in range(MIN_RUN):
        cover[d : d + len(tokens)] |= many
    cut = np.cumsum([len(s) + 1 for s in own])
    return [c[: len(s)] for c, s in zip(np.split(cover[: len(tokens)], cut[:-1]), own)]


def _read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds text (null where a block is open) and the blocks that are not plain article text, or all if one is open."""
    for b in batches:
        rows = []
        for page in b.column(b.num_columns - 1).to_pylist():
            found = blocks(page)
            text = None if any(p == "open" for p, _ in found) else "\n\n".join(t for p, t in found if p == "article")
            rest = [x for x in found if text is None or x[0] != "article"]
            rows.append((text, [p for p, _ in rest], [t for _, t in rest]))
        text, places, texts = zip(*rows) if rows else ((), (), ())
        arrays = [pa.array(text, pa.string()), pa.array(places, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], names=[*b.schema.names[:-1], "text", "places", "texts"])


def _streams(own) -> list[list[str]]:
    """Tokens of each page's blocks outside plain article text."""
    return [[w for p, t in zip(ps or (), ts or ()) if p != "article" for w in t.split()] for ps, ts in zip(own["places"].to_pylist(), own["texts"].to_pylist())]


def _hash(tokens: list[str]) -> str:
    return hashlib.blake2b("\0".join(tokens).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _shard_runs(key, own):
    """Distinct runs of MIN_RUN tokens of one shard with the least and greatest stream that holds each."""
    seen: dict[str, tuple[str, str]] = {}
    for s in _streams(own):
        page = _hash(s)
        for i in range(len(s) - MIN_RUN + 1):
            run = _hash(s[i : i + MIN_RUN])
            lo, hi = seen.get(run, (page, page))
            seen[run] = (min(lo, page), max(hi, page))
    n = len(seen)
    lo, hi = zip(*seen.values()) if seen else ((), ())
    cols = [pa.array([key[0].as_py()] * n, pa.string()), pa.array([key[1].as_py()] * n, pa.int64()), *(pa.array(list(x), pa.string()) for x in (seen, lo, hi))]
    return pa.Table.from_arrays(cols, names=["host", "shard", "run", "lo", "hi"])


def _decide(key, own, elsewhere):
    """Text of one shard's pages with open blocks; elsewhere has the shard's runs that other shards repeat."""
    streams, known = _streams(own), set(elsewhere["run"].to_pylist())
    page = np.unique(np.array([_hash(s) for s in streams], str), return_inverse=True)[1].tolist()
    out = []
    for text, places, texts, s, c in zip(own["text"].to_pylist(), own["places"].to_pylist(), own["texts"].to_pylist(), streams, repeated(streams, page)):
        if text is not None:
            out.append(None)
            continue
        if known:
            for i in range(len(s) - MIN_RUN + 1):
                if _hash(s[i : i + MIN_RUN]) in known:
                    c[i : i + MIN_RUN] = True
        keep, at = [], 0
        for place, t in zip(places, texts):
            n = len(t.split()) if place != "article" else 0
            if place == "article" or place == "open" and c[at : at + n].mean() < COVERED:
                keep.append(t)
            at += n
        out.append("\n\n".join(keep))
    new = own.select(["page_id", "url"]).append_column("text", pa.array(out, pa.string()))
    return new.filter(pa.array([x is not None for x in out], pa.bool_()))


def extract(pages: DataFrame, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """(page_id, url, text) of every row of pages(page_id, url, html)."""
    kept = T.StructType([pages.schema["page_id"], pages.schema["url"]])
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*://([^/?#]*)", 1))
    schema = T.StructType([*kept, T.StructField("host", T.StringType())]).add("text", "string").add("places", T.ArrayType(T.StringType())).add("texts", T.ArrayType(T.StringType()))
    parsed = table(pages.select("page_id", "url", host.alias("host"), "html").mapInArrow(_read_pages, schema), "pages")
    counts = parsed.groupBy("host").agg(F.count("*").alias("n"), F.max(F.col("text").isNull()).alias("open"))
    shards = counts.where("open").select("host", F.ceil(F.col("n") / shard_pages).cast("int").alias("shards"))
    # plain article texts stay behind: only the blocks of hosts with an open one are dealt, by host and shard
    some = parsed.join(small(table(shards, "shards"), 500_000), "host")
    dealt = some.withColumn("shard", F.pmod(F.xxhash64("page_id", "url"), F.col("shards")).cast("long"))
    split = dealt.where("shards > 1").select("host", "shard", "places", "texts")
    runs = table(split.groupBy("host", "shard").applyInArrow(_shard_runs, "host string, shard long, run string, lo string, hi string"), "shard-runs")
    often = runs.groupBy("host", "run").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).where("least <> most")
    elsewhere = runs.where("lo = hi").join(often.select("host", "run"), ["host", "run"]).select("host", "shard", "run")
    both = dealt.drop("shards").groupBy("host", "shard").cogroup(elsewhere.groupBy("host", "shard"))
    text = both.applyInArrow(_decide, T.StructType([*kept]).add("text", "string"))
    return parsed.where("text is not null").select("page_id", "url", "text").unionByName(text)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.char_length("text").cast("long"))
