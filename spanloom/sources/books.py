"""Books of several kinds, derived from the supplied tables where those have too little structure of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.dialect import SPARK
from spanloom.shared import spread

LAYOUT = "book_id long, ord int, page_index int, block_index int, text string, size double, bold boolean, top double, page_height double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: A character that stands for another one meanwhile; one that a text has itself is followed by another sign.
SIGN, OWN, REPLACED = chr(0xE0FE), "0", "1"


def decoded(content: Column) -> Column:
    """UTF-8 bytes as text; bytes that are none are left out.

    They become replacement characters, which are then taken out; those that a text has itself stand aside meanwhile.
    """
    text = content.cast("string")
    aside = F.replace(F.replace(text, F.lit(SIGN), F.lit(SIGN + OWN)), F.lit("\ufffd"), F.lit(SIGN + REPLACED))
    valid = F.replace(F.make_valid_utf8(aside), F.lit("\ufffd"), F.lit(""))
    back = F.replace(F.replace(valid, F.lit(SIGN + REPLACED), F.lit("\ufffd")), F.lit(SIGN + OWN), F.lit(SIGN))
    return F.when(F.is_valid_utf8(text), text).otherwise(back)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files; what is no UTF-8 is left out of a text. Spark's reader gives no row for an empty file."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("text"))


def pages_text(pages: DataFrame) -> DataFrame:
    """(book_id, text): lines of layouts (book_id, page_index, ord, text) page by page, with a blank line between, as they are read."""
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    whole = pages.groupBy("book_id", "page_index").agg(page.alias("page")).groupBy("book_id").agg(join_parts("page_index", "page").alias("raw"))
    return whole.select("book_id", F.expr(T.normalize_text(SPARK, T.dehyphenate(SPARK, "raw"))).alias("text"))


def format_of(path) -> F.Column:
    """How a file is read, by its suffix: text, markdown, layout, markup, or converted first; an unknown suffix is an error."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    known = {"txt": "text", "md": "markdown", "pdf": "layout", "epub": "markup", "mobi": "convert", "azw": "convert", "azw3": "convert", "prc": "convert", "kfx": "convert"}
    out = F.raise_error(F.concat(F.lit("unsupported format: "), suffix)).cast("string")
    for s, kind in known.items():
        out = F.when(suffix == s, F.lit(kind)).otherwise(out)
    return out


def join_parts(by: str, part: str) -> F.Column:
    """The parts of a group in the order of ``by``, with a blank line between."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, part))), lambda x: x[part]), "\n\n")


def books(documents: DataFrame) -> DataFrame:
    """(book_id, text): eight documents as the chapters of a book, with contents, running heads, page numbers and rules."""
    k = F.col("doc_id") % 8
    contents = "Contents\n\nPrologue . . . . . . 1\nChapter 1 . . . . . . 7\n\n"
    title = F.when(k == 0, F.lit("Prologue")).otherwise(F.concat(F.lit("Chapter "), k.cast("string")))
    part = F.concat(
        F.when(k == 0, F.lit(contents)).otherwise(""), title, F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\nTHE COLLECTED PAPERS "), k.cast("string"),
        F.lit("\n\n"), (k + 10).cast("string"), F.lit("\n\n---"),
    )
    return documents.select(F.expr("doc_id div 8").alias("book_id"), k.alias("k"), part.alias("part")).groupBy("book_id").agg(join_parts("k", "part").alias("text"))


def markdown_books(conversations: DataFrame) -> DataFrame:
    """(conv_id, text): each conversation as a markdown document with headings, lists, quotes and fenced code."""
    turn = F.col("turn").cast("string")
    part = F.concat(
        F.lit("## "), F.col("role"), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n- **turn** "), turn, F.lit("\n  - `nested` item\n\n> quoted "), F.col("role"),
        F.lit("\n> and on\n\n```\nx = "), turn, F.lit("\n# not a heading\n\n```\n\n* * *\n\nSet _off_ in "), turn, F.lit("\n------\n#### Deep \\*mark\\*\n3) third\n\n==\n==\n~~~\n```\n~~~\n\n---"),
    )
    joined = conversations.select("conv_id", "turn", part.alias("part")).groupBy("conv_id").agg(join_parts("turn", "part").alias("body"))
    return joined.select("conv_id", F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.col("body")).alias("text"))


def layout_lines(lines: DataFrame) -> DataFrame:
    """Lines of books as a page layout gives them: with type size, position, page and block."""
    line, n = F.col("line"), F.col("n")
    line = F.when(n % 250 == 30, "Index").otherwise(line)  # an index page
    size = F.when(line.startswith("Chapter ") | line.isin("Prologue", "Contents", "Index"), 18.0).when(line.startswith("THE COLLECTED"), 9.0).otherwise(10.0)
    top = F.when(line.startswith("THE COLLECTED"), 20.0).when(F.length(line) == 2, 770.0).otherwise(120.0 + 20 * (n % 25))
    return lines.where("line <> ''").select("book_id", n.alias("ord"), F.expr("cast(n div 25 as int)").alias("page_index"), F.expr("cast(n div 3 as int)").alias("block_index"), line.alias("text"), size.alias("size"), (n % 11 == 0).alias("bold"), top.cast("double").alias("top"), F.lit(800.0).alias("page_height"))


def layout_from_json(pages: DataFrame) -> DataFrame:
    """Lines of page layouts, from (book_id, page_index, json) with nested blocks, lines and spans.

    A line's text is its spans', its size the largest of theirs, and it is bold when one of them is (bit 4 of the flags). Blocks without
    lines, such as images, and blank lines are left out; so is a page that is no valid document.
    """
    span = "array<struct<text:string,size:double,flags:int>>"
    nested = f"struct<height:double,blocks:array<struct<lines:array<struct<bbox:array<double>,spans:{span}>>>>>"
    p = pages.withColumn("page", F.from_json("json", nested, {"mode": "PERMISSIVE"})).where("page is not null")
    b = p.select("book_id", "page_index", F.col("page.height").alias("page_height"), F.posexplode("page.blocks").alias("block_index", "block"))
    rows = b.select("*", F.posexplode("block.lines").alias("line_no", "l"))
    out = rows.select(
        "book_id", "page_index", "block_index", "line_no", "page_height", F.array_join(F.transform("l.spans", lambda s: F.coalesce(s["text"], F.lit(""))), "").alias("text"),
        F.array_max(F.transform("l.spans", lambda s: s["size"])).alias("size"), F.exists("l.spans", lambda s: s["flags"].bitwiseAND(16) > 0).alias("bold"),
        F.col("l.bbox")[1].alias("top"), F.col("l.bbox")[3].alias("bottom"),
    )
    return out.where(F.trim("text") != "")
