"""Main text of web pages by site template removal.

A page is cut into its element tree; what no reader sees (scripts, styles, hidden elements) is dropped.
All block subtrees of the page, menus and footers like everything else, are hashed and their hashes
counted per host in Spark. A subtree that recurs on many distinct pages of its host is template and is
deleted from its pages: a container (div, section, list, table, nav ...) from an absolute count on that
grows slowly with the host (``MIN_PAGES``, or ``GROWTH`` times log2 of its pages), so other sections of a
host don't change the verdict; a bare text block (p, li, heading, quote ...) only from ``MIN_SHARE`` of the
host's pages on, as articles quote each other. Pages with equal own text count once, so copies of one
article don't turn it into template, and a page whose whole text recurs keeps it.

Tags, roles, class names and <article> are hints for what is left. Elements that say what they are
(navigation, header, footer, sidebar, form, advert, notice, comments) go; a compound name that only
mentions one ("has-sidebar") is no hint. <article> (or <main>) is the page's text where it holds at least
half of what is left; a smaller one is a teaser, and all that is left is kept.

Counting moves one slim row per subtree and distinct page, combined before the shuffle. The pages are then
read again where they lie, and each looks its subtrees up in the sorted template hashes (64 bits, the host
among what is hashed), which are sent to the tasks while there are at most ``MAX_SENT`` of them. Beyond
that the pages that hold a template subtree are found with a join on (host, hash), whose hot keys Spark
can split, and joined back by a 64-bit key of the row.

Edge cases: null html has the empty text; unclosed, crossed and unknown tags are read as browsers do
(nearest open element, implied ends of p, li, cells); texts are read whole; a null url is a host of
its own, ""; repeated rows get equal texts and count once; an empty table gives an empty result;
other columns are not read.
"""
from __future__ import annotations

import html as H
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.store import materialize

MIN_PAGES = 8    # distinct pages of a host that a template container stands on, at least
GROWTH = 2.0     # or this many times log2 of the host's distinct pages
MAX_SENT = 1 << 21  # template hashes sent to every task: 16 MB
MIN_SHARE = 0.5  # share of a host's distinct pages that a template text block stands on

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[a-z0-9]+")

RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
         "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main",
         "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
TEXT_BLOCKS = {"address", "blockquote", "caption", "dd", "dt", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "legend", "li", "option", "p", "pre", "summary", "tr"}
UNSEEN = {"head", "script", "style", "noscript", "template", "svg", "select", "iframe", "object", "canvas", "textarea", "title", "map", "audio", "video"}
HINTS = {"nav", "footer", "aside", "form", "button", "dialog", "menu"}
MENTIONS = {"has", "with", "no", "without", "is", "not"}  # a compound name that begins so only mentions the rest
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
NAMES = {"nav", "navbar", "navigation", "menu", "menubar", "sidebar", "footer", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "ad", "ads", "advert",
         "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "comment", "comments", "disqus", "respond", "replies",
         "breadcrumb", "breadcrumbs", "newsletter", "subscribe", "popup", "modal", "social", "share", "sharing", "related", "banner", "pagination", "pager", "widget"}
OUTSIDE_ONLY = {"header"}   # a page's header goes, an article's own header holds its title
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "table", "dl", "select", "article", "main", "section", "div", "body", "blockquote", "aside", "nav", "form", "footer", "header"}


SEEN, HINTED, GONE = 0, 1, 2  # what an element's text is: ordinary, left out by a hint, never shown


def _kind(tag: str, attrs: str, in_article: bool) -> int:
    if tag in UNSEEN:
        return GONE
    kind = HINTED if tag in HINTS or (tag in OUTSIDE_ONLY and not in_article) else SEEN
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower() or tag in ("html", "body", "main"):
        return kind
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return GONE
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return GONE
        if name == "role" and value in ROLES:
            kind = HINTED
        if name in ("class", "id"):
            for token in value.split():
                words = _WORD.findall(token)
                if words and words[0] not in MENTIONS and (NAMES.intersection(words) or (not in_article and OUTSIDE_ONLY.intersection(words))):
                    kind = HINTED
    return kind


class Page:
    """``blocks``: (text, where, hinted) with where 2 in an article, 1 in main, 0 elsewhere; ``trees``: (first
    block, one past the last, tag) of every closed block element that holds a block. ``hints`` off
    takes every shown element for an ordinary one."""

    def __init__(self, source: str, hints: bool = True):
        self.hints = hints
        self.blocks: list[tuple[str, int, bool]] = []
        self.trees: list[tuple[int, int, str]] = []
        self._cur: list[str] = []
        self._stack: list[tuple[str, int, int, int]] = []  # tag, first block, kind, where
        self._read(source)

    def _text(self, s: str) -> None:
        if s and not (self._stack and self._stack[-1][2] == GONE):
            self._cur.append(H.unescape(s) if "&" in s else s)

    def _flush(self) -> None:
        if self._cur:
            t = " ".join("".join(self._cur).split())
            self._cur = []
            if t:
                _, _, kind, where = self._stack[-1] if self._stack else ("", 0, SEEN, 0)
                self.blocks.append((t, where, kind == HINTED))

    def _close(self, depth: int) -> None:
        while len(self._stack) > depth:
            tag, first, _, _ = self._stack[-1]
            if tag in BLOCK:
                self._flush()
            self._stack.pop()
            if tag in BLOCK and len(self.blocks) > first:
                self.trees.append((first, len(self.blocks), tag))

    def _read(self, s: str) -> None:
        at = 0
        while m := _TAG.search(s, at):
            self._text(s[at:m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(s, at)
                at = end.end() if end else len(s)
                continue
            self._start(tag, m[3])
        self._text(s[at:])
        self._flush()
        self._close(0)

    def _start(self, tag: str, attrs: str) -> None:
        if tag in ("td", "th", "br"):
            self._text(" ")
        if tag in BLOCK or tag in IMPLIED:
            ends = IMPLIED.get(tag, set()) | ({"p"} if tag in BLOCK else set())
            for d in range(len(self._stack) - 1, -1, -1):
                if self._stack[d][0] in ends:
                    self._close(d)
                    break
                if self._stack[d][0] in SCOPES:
                    break
        _, _, above, where = self._stack[-1] if self._stack else ("", 0, SEEN, 0)
        kind = max(above, _kind(tag, attrs, where == 2))
        if kind == HINTED and not self.hints:
            kind = above
        if tag in BLOCK or kind != above:
            self._flush()
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            return
        where = max(where, 2 if tag == "article" else 1 if tag == "main" or "main" == (re.search(r"role\s*=\s*[\"']?(\w+)", attrs) or [0, ""])[1] else 0)
        self._stack.append((tag, len(self.blocks), kind, where))

    def _end(self, tag: str) -> None:
        for d in range(len(self._stack) - 1, -1, -1):
            if self._stack[d][0] == tag:
                self._close(d)
                return
            if tag not in BLOCK and self._stack[d][0] in BLOCK:
                return

    def own(self, gone: set[int]) -> list[int]:
        """Indexes of the page's own blocks, those in ``gone`` left out: without the hinted ones, and of
        these the articles' (or main's) if they are no mere teaser."""
        left = [i for i, (_, _, hinted) in enumerate(self.blocks) if not hinted and i not in gone]
        most = max((self.blocks[i][1] for i in left), default=0)
        inner = [i for i in left if self.blocks[i][1] == most]
        size = lambda ids: sum(len(self.blocks[i][0]) for i in ids)
        return inner if 2 * size(inner) >= size(left) or not self.hints else left


def _hash(tag: str, texts: list[str]) -> int:
    h = xxhash.xxh3_64_intdigest("\x1f".join([tag, *texts]).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def subtrees(page: Page, host: str = "") -> tuple[int, list[tuple[int, int, int, bool]]]:
    """Hash of the page's own text, and (hash, first block, one past the last, container or not) of the
    block subtrees that aren't the whole page."""
    texts = [t for t, _, _ in page.blocks]
    out = [(_hash(f"{host}\x1e{tag}", texts[a:b]), a, b, tag not in TEXT_BLOCKS) for a, b, tag in page.trees if b - a < len(texts)]
    return _hash("", [texts[i] for i in page.own(set())]), out


def main_text(page: Page, host: str, template: np.ndarray) -> str:
    """The page's own text without the subtrees in ``template`` (sorted hashes)."""
    gone: set[int] = set()
    if len(template):
        found = subtrees(page, host)[1]
        h = np.array([x[0] for x in found], np.int64)
        at = np.minimum(np.searchsorted(template, h), len(template) - 1)
        for k in np.flatnonzero(template[at] == h).tolist():
            gone.update(range(found[k][1], found[k][2]))
    keep = page.own(gone) or page.own(set())
    return "\n".join(page.blocks[i][0] for i in keep)


def _subtree_rows(batches: Iterator[pa.RecordBatch], hints: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, host, whole, tree, wide = [], [], [], [], []
        for k, h, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            page, found = subtrees(Page(s.as_py() or "", hints), h)
            hashes = {None: False} | {x: w for x, _, _, w in found}  # None: the page itself
            key += [k] * len(hashes)
            host += [h] * len(hashes)
            whole += [page] * len(hashes)
            tree += hashes
            wide += hashes.values()
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(host, pa.string()), pa.array(whole, pa.int64()), pa.array(tree, pa.int64()), pa.array(wide, pa.bool_())],
                                         names=["key", "host", "page", "tree", "wide"])


def _text_rows(batches: Iterator[pa.RecordBatch], hints: bool, sent: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        trees = cols["trees"].to_pylist() if sent is None else None
        texts = [main_text(Page(s.as_py() or "", hints), host, sent if sent is not None else np.sort(np.array(trees[i] or [], np.int64)))
                 for i, (s, host) in enumerate(zip(cols["html"], cols["host"].to_pylist()))]
        yield pa.RecordBatch.from_arrays([cols["page_id"], cols["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def template_subtrees(rows: DataFrame, min_pages: int = MIN_PAGES, growth: float = GROWTH, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, tree) of the subtrees that recur, from one row per subtree and page (a null tree stands
    for the page itself)."""
    seen = (rows.groupBy("host", "tree", "page").agg(F.max("wide").alias("wide"))
            .groupBy("host", "tree").agg(F.count(F.lit(1)).alias("pages"), F.max("wide").alias("wide")))
    seen = materialize(seen.where((F.col("pages") >= min_pages) | F.col("tree").isNull()), "subtree-counts")
    total = seen.where("tree is null").select("host", F.col("pages").alias("total"))
    many = (F.col("pages") >= F.lit(growth) * F.log2("total")) & (F.col("wide") | (F.col("pages") >= F.col("total") * min_share))
    return materialize(seen.where("tree is not null").join(total, "host").where(many).select("host", "tree"), "template-subtrees")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES,
            growth: float = GROWTH, min_share: float = MIN_SHARE, hints: bool = True, max_sent: int = MAX_SENT) -> DataFrame:
    """page_id, url and the main text of every row. With ``hints`` off, tags and names decide nothing
    and only the recurring subtrees go."""
    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    key = F.xxhash64("page_id", "url", "html")
    rows = slim.select(key.alias("key"), _host(F.col("url")).alias("host"), "html").mapInArrow(
        lambda bs: _subtree_rows(bs, hints), "key bigint, host string, page bigint, tree bigint, wide boolean")
    rows = materialize(rows, "subtrees")
    template = template_subtrees(rows, min_pages, growth, min_share)
    where, id_type, url_type = _host(F.col("url")).alias("host"), slim.schema["page_id"].dataType.simpleString(), slim.schema["url"].dataType.simpleString()
    if template.count() <= max_sent:
        sent = np.sort(np.array([r[0] for r in template.select("tree").toLocalIterator()], np.int64))
        both = slim.select("page_id", "url", "html", where)
    else:
        sent = None
        listed = materialize(rows.join(template, ["host", "tree"]).groupBy("key").agg(F.collect_set("tree").alias("trees")), "template-pages")
        both = slim.withColumn("key", key).join(listed, "key", "left").select("page_id", "url", "html", where, "trees")
    return both.mapInArrow(lambda bs: _text_rows(bs, hints, sent), f"page_id {id_type}, url {url_type}, text string")
