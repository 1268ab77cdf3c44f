"""Operator 1, HTML extraction by site template removal.

Pages are parsed into a stream of opened and closed elements and texts. The subtree of every block element with text is
hashed: its tag, its texts and the hashes of its children. Spark counts, per host, the different pages with each hash; pages
that say the same count once. What recurs on ``PAGES`` pages of a host and on ``SHARE`` of them is that site's template and is
deleted: menus, mastheads, footers, boxes, of which a site may have several. A lone paragraph or heading is what pages quote
from each other too, and needs ``PARAGRAPH_PAGES`` and ``PARAGRAPH_SHARE``. What stands in an article or main element is
never deleted by its count. The hot host's counts are summed in the tasks first, and joins are plain equi-joins.

What doesn't recur is judged by what HTML says of it: an article or main element bounds the text, where there is one, and
navigation, headers, footers, asides, forms, scripts and elements with the usual class, id or role names of adverts,
notices, comments and the like are left out.

Cases: a null or empty page has an empty text; a page cut off in the middle of a tag or comment ends
there; elements that are never closed end with the element around them; pages of one id are parsed
each, and lose the templates found for that id; a null id is one id; a null url is a host of its own; very long pages are
parsed alone; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import bound_batches, materialize, pieces, table

SHARE, PAGES, PARAGRAPH_SHARE, PARAGRAPH_PAGES, CHUNK = 0.05, 3, 0.5, 8, 2 << 20

#: Elements whose text is never shown in the page, raw or not.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
DROPPED = RAW | frozenset("head nav header footer aside form button select option datalist svg canvas math object embed audio video map dialog menu fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PARAGRAPHS = HEADINGS | {"p", "blockquote", "pre"}
#: What the start of an element ends besides paragraphs, and where the search for it stops.
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead header footer sidebar aside ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget "
    "toolbar pagination pager skip copyright paywall".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
UNSURE = frozenset("with has no without layout".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

_TOKEN = re.compile(r"""<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|$)""", re.I)
_NAME = re.compile(r"[a-z0-9]+")

OPEN, CLOSE, TEXT = 0, 1, 2
NO_ID = -(1 << 63)


def _named(tag: str, attributes: str) -> str:
    """'' to keep an element by its attributes, 'name' or 'comment' to drop it."""
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    if not found:
        return ""
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return "name"
    if found.get("role") in ROLES:
        return "name"
    names = set(_NAME.findall(f"{found.get('class', '')} {found.get('id', '')}"))
    if names & UNSURE or tag in ("html", "body", "main"):
        return ""
    if names & COMMENTS:
        return "comment"
    return "name" if names & NAMES and tag != "article" else ""


class Page:
    """A parsed page: tags, parents and marks of its elements, and what is opened, closed and said in order."""

    def __init__(self, html: str):
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.drop: list[str] = []
        self.events: list[tuple[int, int, str]] = []
        self._parse(html)
        self._settle()

    def _parse(self, html: str) -> None:
        stack: list[int] = []
        tags, events = self.tags, self.events

        def close_to(depth: int) -> None:
            while len(stack) > depth:
                events.append((CLOSE, stack.pop(), ""))

        def close(names, stops) -> None:
            for d in range(len(stack) - 1, -1, -1):
                t = tags[stack[d]]
                if t in names:
                    close_to(d)
                    return
                if t in stops:
                    return

        at = 0
        while True:
            m = _TOKEN.search(html, at)
            if m is None:
                # the rest is text, but for a tag that is cut off
                rest = html[at:]
                cut = re.search(r"<[a-zA-Z/!?]", rest)
                if rest := rest[: cut.start()] if cut else rest:
                    events.append((TEXT, stack[-1] if stack else -1, rest))
                break
            if m.start() > at:
                events.append((TEXT, stack[-1] if stack else -1, html[at : m.start()]))
            at = m.end()
            if m.group(0) == "<!--":
                end = html.find("-->", at)
                if end < 0:
                    break
                at = end + 3
                continue
            if m.group(2) is None:
                continue
            tag = m.group(2).lower()
            if m.group(1):
                for d in range(len(stack) - 1, -1, -1):
                    if tags[stack[d]] == tag:
                        close_to(d)
                        break
                continue
            if tag in BLOCKS:
                close(("p",), ("td", "th", "table", "div", "section", "article", "main", "body", "blockquote", "li", "button"))
            if tag in CLOSES:
                names, stops = CLOSES[tag]
                close(names.split(), stops)
            node = len(tags)
            tags.append(tag)
            self.parents.append(stack[-1] if stack else -1)
            self.drop.append("tag" if tag in DROPPED else _named(tag, m.group(3)) if m.group(3) else "")
            events.append((OPEN, node, ""))
            if tag in VOID or m.group(3).endswith("/") and tag in ("svg", "path"):
                events.append((CLOSE, node, ""))
            elif tag in RAW:
                end = re.compile(f"</{re.escape(tag)}\\s*>?", re.I).search(html, at)
                events.append((CLOSE, node, ""))
                if end is None:
                    break
                at = end.end()
            else:
                stack.append(node)
        close_to(0)

    def _settle(self) -> None:
        """Marks go down to children; what holds an article isn't dropped by name; headings stay in an article's header."""
        tags, parents, drop = self.tags, self.parents, self.drop
        for n, t in enumerate(tags):
            if t in ("article", "main") and drop[n] != "comment":
                p = parents[n]
                while p >= 0:
                    if drop[p] == "name":
                        drop[p] = ""
                    p = parents[p]
        inside = [False] * len(tags)
        self.out, self.inside = [False] * len(tags), inside
        for n, t in enumerate(tags):
            p = parents[n]
            inside[n] = (p >= 0 and inside[p]) or (t in ("article", "main") and drop[n] == "" and not (p >= 0 and self.out[p]))
            dropped = drop[n] != ""
            if t == "header" and drop[n] == "tag" and p >= 0 and inside[p]:
                dropped = False  # judged by its children
            if p >= 0 and (self.out[p] or tags[p] == "header" and t not in HEADINGS):
                dropped = True
            self.out[n] = dropped
        self.bounded = any(i and not o for i, o in zip(inside, self.out))

    def counts(self, node: int) -> bool:
        """Whether text directly in the element belongs to the page's main text."""
        if node < 0:
            return not self.bounded
        return not self.out[node] and self.tags[node] != "header" and (self.inside[node] or not self.bounded)

    def hashes(self) -> list[int]:
        """A hash of each block element's subtree, as a signed 64-bit number; 0 where it has no text or an article around it, and for words marked inside a block."""
        parts: list[list[bytes]] = [[t.encode("utf-8", "replace")] for t in self.tags]
        said = [False] * len(self.tags)
        out = [0] * len(self.tags)
        for kind, n, text in self.events:
            if kind == TEXT:
                if n >= 0 and (words := text.split()):
                    parts[n].append(" ".join(words).encode("utf-8", "replace"))
                    said[n] = True
            elif kind == CLOSE and said[n]:
                h = xxhash.xxh3_64_intdigest(b"\x1f".join(parts[n]))
                if self.tags[n] in BLOCKS and not self.inside[n]:
                    out[n] = h - (1 << 64) if h >> 63 else h
                if (p := self.parents[n]) >= 0:
                    parts[p].append(h.to_bytes(8, "big"))
                    said[p] = True
        return out

    def templates(self, deleted: frozenset[int] | set[int]) -> list[bool]:
        """Which elements are or lie in subtrees of these hashes."""
        gone = [False] * len(self.tags)
        if deleted:
            for n, h in enumerate(self.hashes()):
                gone[n] = h in deleted or (self.parents[n] >= 0 and gone[self.parents[n]])
        return gone

    def text(self, deleted: frozenset[int] | set[int] = frozenset()) -> str:
        """The blocks of the main text, without the subtrees of these hashes."""
        return self.parted(deleted)[0]

    def parted(self, deleted: frozenset[int] | set[int] = frozenset()) -> tuple[str, int]:
        """The blocks of the main text, without the subtrees of these hashes, and the characters of these subtrees."""
        gone = self.templates(deleted)
        blocks: list[str] = []
        now: list[str] = []
        lost = 0

        def flush() -> None:
            if now:
                if said := " ".join(entities.unescape("".join(now)).split()):
                    blocks.append(said)
                now.clear()

        for kind, n, text in self.events:
            if kind == TEXT:
                if n >= 0 and gone[n]:
                    lost += len(text)
                elif self.counts(n):
                    now.append(text)
            elif self.tags[n] in BLOCKS:
                flush()
            elif self.tags[n] == "br" and kind == OPEN:
                now.append(" ")
        flush()
        return "\n".join(blocks), lost


def host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\s]*)", url or "")
    return m.group(1).rpartition("@")[2].partition(":")[0].lower() if m else ""


def subtrees(pages: DataFrame) -> DataFrame:
    """page_id, host, content (a hash of what the page says), paragraph, hash: one row for each different subtree of a page, and one with hash 0 for the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64())
        for batch in pieces(batches, CHUNK, "html"):
            cols: tuple[list, ...] = ([], [], [], [], [])
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                parsed = Page(html or "")
                content = xxhash.xxh3_64_intdigest(parsed.text().encode("utf-8", "replace")) >> 1
                hashes = {0: False} | {h: t in PARAGRAPHS for h, t in zip(parsed.hashes(), parsed.tags) if h}
                n = len(hashes)
                for c, v in zip(cols, ([page] * n, [host(url)] * n, [content] * n, hashes.values(), hashes)):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["page_id", "host", "content", "paragraph", "hash"])

    return pages.mapInArrow(run, "page_id long, host string, content long, paragraph boolean, hash long")


def templates(found: DataFrame, share: float = SHARE, pages: int = PAGES) -> DataFrame:
    """host, hash of the subtrees that recur on that host."""
    counts = found.groupBy("host", "hash").agg(F.countDistinct("content").alias("n"), F.max("paragraph").alias("paragraph")).filter(F.col("n") >= pages)
    hosts = counts.filter("hash = 0").select("host", F.col("n").alias("of"))
    enough = (F.col("n") >= share * F.col("of")) & (~F.col("paragraph") | ((F.col("n") >= PARAGRAPH_PAGES) & (F.col("n") >= PARAGRAPH_SHARE * F.col("of"))))
    return counts.filter("hash <> 0").join(hosts, "host").filter(enough).select("host", "hash")


def extracted(pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars, n_templates (subtrees deleted as the site's template), template_chars (what they say)."""
    spark = pages.sparkSession
    bound_batches(spark)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = materialize(subtrees(source), "subtrees")
    deleted = found.join(templates(found, share, least), ["host", "hash"]).groupBy(F.coalesce("page_id", F.lit(NO_ID)).alias("_page")).agg(F.collect_set("hash").alias("deleted"))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in pieces(batches, CHUNK, "html"):
            body = [None if h is None else pack(h.encode("utf-8", "replace")) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(body, pa.binary())], names=["page_id", "url", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, CHUNK >> 2, "body"):
            texts, gone, lost = [], [], []
            unpack = zstandard.ZstdDecompressor().decompress
            for body, hashes in zip(batch.column("body").to_pylist(), batch.column("deleted").to_pylist()):
                parsed = Page("" if body is None else unpack(body).decode())
                text, n = parsed.parted(set(hashes or ()))
                texts.append(text)
                gone.append(len(hashes or ()))
                lost.append(n)
            cols = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in (map(len, texts), gone, lost))]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars", "n_templates", "template_chars"])

    # the pages move compressed
    small = source.mapInArrow(shrink, "page_id long, url string, body binary")
    return small.join(deleted, F.coalesce(small["page_id"], F.lit(NO_ID)) == deleted["_page"], "left").select("page_id", "url", "body", "deleted").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_templates long, template_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
