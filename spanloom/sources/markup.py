"""Blocks of HTML: the general reader follows the tags, the flat one is regular expressions."""

from __future__ import annotations

import html as html_library
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from spanloom.functions.dialect import SPARK, WS, Spark, struct_of
from spanloom.functions.text import squash, strip

#: Tags of blocks, the kinds and levels that they give (fixed values).
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCK_TAGS = {"p": "paragraph", "li": "list_item", "blockquote": "block_quote", "pre": "code"} | dict.fromkeys(HEADING_TAGS, "heading")
VOID_TAGS = ("br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr")
#: Tags whose beginning ends a paragraph, and elements beyond which none is ended (fixed values of HTML).
ENDS_P = ("p", "ul", "ol", "div", "blockquote", "pre", "article", "section", "nav", "header", "footer", "aside", "main", "table", "form", "hr", *HEADING_TAGS)
SCOPES = ("td", "th", "table", "button", "object", "html")
BLOCKS = ArrayType(struct_of("kind:string level:int text:string"))
#: Elements within one another, at most, for the general reader.
DEPTH = 512


#: A reference by name without its semicolon, and what stands for its sign meanwhile, which is no character.
OPEN_NAME, UNREAD = re.compile(r"&(?=[A-Za-z][A-Za-z0-9]*(?![A-Za-z0-9;]))"), "\ufdd0"


def plain(text: str, closed: bool = False) -> str:
    """The text with its character references read. HTML reads some names without their semicolon too; with ``closed`` those stay, as in XML."""
    return html_library.unescape(OPEN_NAME.sub(UNREAD, text)).replace(UNREAD, "&") if closed else html_library.unescape(text)


class Reader(HTMLParser):
    """Collects the text of the outermost blocks, in the order in which they begin; ``closed`` as in ``plain``."""

    def __init__(self, closed: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.closed = closed
        self.open: list[str] = []
        self.depth: int | None = None
        self.found: list[dict] = []
        self.runs: list[str] = []
        self.joined = False

    def feed(self, data: str) -> None:
        super().feed(OPEN_NAME.sub(UNREAD, data) if self.closed else data)

    def handle_starttag(self, tag: str, attrs) -> None:
        self.joined = False
        if tag in VOID_TAGS:
            return
        if len(self.open) >= DEPTH:
            raise ValueError(f"elements are nested more than {DEPTH} deep")
        if tag in ENDS_P:
            self.end_open("p", SCOPES)
        if tag == "li":
            self.end_open("li", ("ul", "ol"))
        self.open.append(tag)
        if self.depth is None and tag in BLOCK_TAGS:
            self.depth = len(self.open)
            kind = BLOCK_TAGS[tag]
            lists = sum(t in ("ul", "ol") for t in self.open)
            level = int(tag[1]) if kind == "heading" else max(1, lists) if kind == "list_item" else 0
            self.found.append({"kind": kind, "level": level, "parts": []})

    def end_open(self, tag: str, scopes: tuple[str, ...]) -> None:
        """End an element whose end tag was left out, if it is open and nothing that holds others is between."""
        for t in reversed(self.open):
            if t == tag:
                return self.handle_endtag(tag)
            if t in scopes:
                return None
        return None

    def handle_endtag(self, tag: str) -> None:
        self.joined = False
        if tag not in self.open:
            return
        while self.open:
            last = self.open.pop()
            if self.depth is not None and len(self.open) < self.depth:
                self.depth = None
            if last == tag:
                return

    def handle_comment(self, data: str) -> None:
        self.joined = False

    def handle_data(self, data: str) -> None:
        if {"script", "style"} & set(self.open[-1:]):
            return
        if self.closed:
            data = data.replace(UNREAD, "&")
        if self.joined:
            self.runs[-1] += data
        else:
            self.runs.append(data)
        self.joined = True
        if self.depth is not None and data.strip():
            self.found[-1]["parts"].append(data.strip())


def read_blocks(html: str | None) -> list[dict]:
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    return [{"kind": b["kind"], "level": b["level"], "text": " ".join(b["parts"])} for b in reader.found if b["parts"]]


@F.pandas_udf(BLOCKS)
def blocks_of(html: pd.Series) -> pd.Series:
    return html.map(read_blocks)


def markup_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, ord, kind, level, text): headings, paragraphs, list items, quotes and code of each page, nested ones with their outermost."""
    return pages.select("page_id", F.posexplode(blocks_of("html")).alias("ord", "b")).select("page_id", "ord", "b.kind", "b.level", "b.text")


def visible(d: Spark, html: str) -> str:
    """Without scripts, styles and comments."""
    return d.sub(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")


def flat_parts(d: Spark, html: str) -> str:
    """The elements of a page that are blocks, each up to its first end tag (an array)."""
    one = "|".join(rf"<{t}(?:\s[^>]*)?>.*?</{t}>" for t in BLOCK_TAGS)
    return d.find_all(visible(d, html), f"(?is)(?:{one})")


def element_text(d: Spark, element: str) -> str:
    return strip(d, squash(d, d.sub(element, r"(?s)<[^>]*>", " ")))


def element_tag(d: Spark, element: str) -> str:
    return f"lower({d.pick(element, '^<([A-Za-z0-9]+)', 1)})"


def crude_text(d: Spark, html: str) -> str:
    """The text of a page by regular expressions alone; spaces are all that is left of its lines."""
    s = d.sub(html, r"(?i)<br\s*/?>", "\n")
    s = d.sub(d.sub(s, r"(?i)</p\s*>", "\n\n"), "<[^>]+>", " ")
    return strip(d, d.sub(s, f"{WS}+", " "))


def text_nodes(d: Spark, html: str) -> str:
    """The text of a page, each run between tags on a line of its own; character references are left as they are."""
    return d.join(d.keep(d.each(d.split(visible(d, html), "<[^>]*>"), lambda x: strip(d, x)), lambda x: f"{x} <> ''"), "\n")


def block_text(d: Spark, html: str) -> str:
    """The text of a page with a blank line after blocks and a line feed for breaks; runs of spaces are one."""
    s = d.sub(visible(d, html), r"(?i)<br\s*/?>", "\n")
    s = d.sub(s, r"(?i)</(?:p|div|section|article|li|h[1-6])\s*>", "\n\n")
    return strip(d, d.sub(d.sub(s, "<[^>]*>"), r"[ \t]+", " "))


def page_text(pages: DataFrame, closed: bool = False) -> DataFrame:
    """(page_id, text) of pages (page_id, html); ``closed`` as in ``plain``. Only texts with character references are looked at one by one."""

    @F.pandas_udf(StringType())
    def unescaped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else plain(t, closed))

    t = pages.select("page_id", F.expr(text_nodes(SPARK, "html")).alias("t"))
    return t.select("page_id", F.coalesce(unescaped(F.when(F.col("t").contains("&"), F.col("t"))), F.col("t")).alias("text"))


def decoded(content: bytes) -> str:
    """Bytes of a page as text: by their mark, by the encoding that the page names, as UTF-8, or as Windows' Latin, whatever fits first."""
    if content.startswith(b"\xef\xbb\xbf"):
        return content[3:].decode("utf-8", "replace")
    named = re.search(rb"""(?i)(?:charset|encoding)\s*=\s*["']?([\w.:-]+)""", content[:2048])
    for encoding in ([named[1].decode("ascii")] if named else []) + ["utf-8", "windows-1252"]:
        try:
            return content.decode(encoding)
        except (UnicodeDecodeError, LookupError):
            continue
    return content.decode("windows-1252", "replace")


def general(content: bytes, closed: bool = False) -> tuple[str, list[dict]]:
    """First tier: text nodes a line each, and the blocks. Declarations of an unknown kind and very deep nesting are errors."""
    reader = Reader(closed)
    reader.feed(decoded(content))
    reader.close()
    text = "\n".join(r.strip() for r in reader.runs if r.strip())
    return text, [{"kind": b["kind"], "level": b["level"], "text": " ".join(b["parts"])} for b in reader.found if b["parts"]]


def flat(content: bytes, closed: bool = False) -> tuple[str, list[dict]]:
    """Second tier: blank lines after blocks, line feeds for breaks, no blocks. A page without any element is an error."""
    html = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<!.*?>", " ", decoded(content))
    if not re.search(r"<[A-Za-z]", html):
        raise ValueError("no element")
    html = re.sub(r"(?i)<br\s*/?>", "\n", html)
    html = re.sub(r"(?i)</(?:p|div|section|article|li|h[1-6])\s*>", "\n\n", html)
    return re.sub(r"[ \t]+", " ", plain(re.sub(r"<[^>]*>", "", html), closed)).strip(), []


def crude(content: bytes, closed: bool = False) -> tuple[str, list[dict]]:
    """Last tier, which never fails: tags are cut out, and all blanks are single spaces; bytes that are no UTF-8 are left out."""
    s = re.sub(r"(?i)</p\s*>", "\n\n", re.sub(r"(?i)<br\s*/?>", "\n", content.decode("utf-8", "ignore")))
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", s)).strip(), []


TIERS = (general, flat, crude)


def read_page(content: bytes | None, closed: bool = False) -> tuple[str, int, str | None, list[dict]]:
    """(text, tier, error, blocks) of one page: by the first tier that does not fail; the error is what the one before it said."""
    error = None
    for k, tier in enumerate(TIERS, 1):
        try:
            text, blocks = tier(content or b"", closed)
            return text, k, error, blocks
        except (ValueError, AssertionError, RecursionError) as e:
            error = str(e)
    raise AssertionError("the last tier takes every page")


def read_pages(pages: DataFrame, key: str, closed: bool = False) -> DataFrame:
    """(key, text, tier, error, blocks) of pages (key, content), whose content is bytes, each page in one pass over the tiers; ``closed`` as in ``plain``.

    Null and empty pages have an empty text. Rows of one key are rows of their own.
    """
    kind = pages.schema[key].dataType.simpleString()
    block = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [read_page(c, closed) for c in b.column(1).to_pylist()]
            text, tier, error, blocks = zip(*found, strict=True) if found else ((),) * 4
            columns = [b.column(0), pa.array(text, pa.string()), pa.array(tier, pa.int32()), pa.array(error, pa.string()), pa.array(blocks, block)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "text", "tier", "error", "blocks"])

    return pages.select(key, "content").mapInArrow(run, f"{key} {kind}, text string, tier int, error string, blocks array<struct<kind:string,level:int,text:string>>")
