"""From files to books with blocks: read by format, named, modelled as the format allows, believed or not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.dialect import SPARK
from spanloom.operators import chunking, structure
from spanloom.operators.markdown import blocks_of_lines
from spanloom.shared import checkpoint
from spanloom.sources import books as B
from spanloom.sources import packages
from spanloom.sources.markup import read_pages

BLOCK = ("book_id", "block_no", "kind", "level", "start", "end", "text")


def parsed(files: DataFrame) -> DataFrame:
    """(book_id, path, format, title, raw, text) of text and markdown files (path, content): decoded, normalised as the format is, named by title and beginning."""
    t = files.select("path", B.format_of(F.col("path")).alias("format"), F.regexp_extract("path", r"([^/\\]*?)(?:\.[^./\\]*)?$", 1).alias("title"), B.decoded(F.col("content")).alias("raw"))
    text = F.when(F.col("format") == "markdown", F.expr(T.normalize_markdown(SPARK, "raw"))).otherwise(F.expr(T.normalize_text(SPARK, "raw")))
    return t.withColumn("text", text).withColumn("book_id", F.expr(T.book_id(SPARK, "title", "text")))


def typed(blocks: DataFrame) -> DataFrame:
    return blocks.selectExpr("book_id", "cast(block_no as bigint) as block_no", "kind", "cast(level as int) as level", "cast(start as bigint) as start", "cast(`end` as bigint) as `end`", "text")


def chosen(native: DataFrame, drafted: DataFrame) -> DataFrame:
    """Blocks that a format knows itself; of books that have none the drafts that were found in the text."""
    return typed(native).unionByName(typed(drafted.join(native.select("book_id").distinct(), "book_id", "left_anti")))


def modelled(books: DataFrame, native: DataFrame, drafts: DataFrame) -> DataFrame:
    """The blocks of each book (book_id, text): its format's own, else its drafts (book_id, ord, kind, level, text) where they are in the text; one paragraph where neither is believed."""
    return structure.guarded_blocks(books, chosen(native, chunking.anchored(books, drafts)))


def loaded(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Books (book_id, path, format, title, text) and their guarded blocks, from text and markdown files (path, content).

    Files of the same title and beginning are one book. Books and blocks are written once: each is read several times.
    """
    t = parsed(files)
    first = t.groupBy("book_id").agg(F.min_by(F.struct("path", "format", "title", "text"), "path").alias("b"))
    books = checkpoint(first.select("book_id", "b.*"))
    plain = structure.blocks(structure.lines(books.where("format = 'text'").select("book_id", "text")))
    marked = blocks_of_lines(structure.lines(books.where("format = 'markdown'").select("book_id", "text")), "book_id")
    own = checkpoint(typed(plain).unionByName(typed(marked)))
    return books, structure.guarded_blocks(books.select("book_id", "text"), own)


def packaged(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Books (book_id, path, title, text) and their guarded blocks, from the documents (path, ord, name, content, error) of archives.

    A book's text is its documents' texts in reading order, a blank line between; its drafts are what the tags say. What
    could not be read is left out, and a book of which nothing could has no row. Files of the same title and beginning
    are one book, the first by path. The archives are read once, before this returns.
    """
    asked = documents.where("error is null and content is not null").select(F.struct("path", "ord").alias("at"), "content")
    pages = checkpoint(read_pages(asked, "at").select("at.path", "at.ord", "text", "blocks"))
    raw = pages.where("text <> ''").groupBy("path").agg(B.join_parts("ord", "text").alias("raw"))
    title = F.regexp_extract("path", r"([^/\\]*?)(?:\.[^./\\]*)?$", 1).alias("title")
    named = raw.select("path", title, "raw", F.expr(T.normalize_text(SPARK, "raw")).alias("text")).withColumn("book_id", F.expr(T.book_id(SPARK, "title", "text")))
    first = named.groupBy("book_id").agg(F.min("path").alias("path"))
    books = checkpoint(named.join(first, ["book_id", "path"], "left_semi").select("book_id", "path", "title", "text"))
    rows = pages.join(books.select("path", "book_id"), "path").select("book_id", "ord", F.posexplode("blocks").alias("k", "b"))
    drafts = rows.select("book_id", F.struct("ord", "k").alias("ord"), "b.kind", "b.level", "b.text")
    none = typed(books.selectExpr("book_id", "0L as block_no", "'' as kind", "0 as level", "0L as start", "0L as `end`", "'' as text").limit(0))
    return books, modelled(books.select("book_id", "text"), none, drafts)


#: Files that are texts, whatever the case of their suffix; archives are told by theirs.
TEXTS, ARCHIVES = "*.{[tT][xX][tT],[mM][dD]}", "*.[eE][pP][uU][bB]"


def from_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Books (book_id, path, title, text) and their guarded blocks, from all text, markdown and archive files under a folder.

    Other files are passed over. Files of the same title and beginning are one book: a text's before an archive's.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", TEXTS).load(path).select("path", "content")
    columns = ["book_id", "path", "title", "text"]
    texts, text_blocks = loaded(files)
    texts = checkpoint(texts.select(columns))
    packed, packed_blocks = packaged(packages.read(spark, path, glob=ARCHIVES))
    ids = texts.select("book_id")
    return texts.unionByName(packed.select(columns).join(ids, "book_id", "left_anti")), typed(text_blocks).unionByName(typed(packed_blocks.join(ids, "book_id", "left_anti")))
