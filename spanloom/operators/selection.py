"""What to do next: which chunks are spoken, missing, ahead; where a chunk is trimmed; whose index nodes point where."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from spanloom.functions import text as T
from spanloom.functions.dialect import SPARK
from spanloom.operators.structure import of_book

#: Chunks that are made ahead of the one that plays; chunks made at a start (fixed values).
AHEAD, AT_START = 6, 2
NODES = "struct<nodes:array<struct<node_id:string,label:string,primary_anchor_id:string>>,anchors:array<struct<anchor_id:string,chunk_index:int,char_offset:long>>>"
INDEX = "struct<schema_version:int,book:struct<fingerprint_sha256:string>,status:struct<state:string>>"
ALIGNMENT = "struct<chunk_id:int,duration_ms:int,spans:array<struct<start_char:int,end_char:int,audio_start_ms:int,audio_end_ms:int,confidence:double>>>"


def spoken(chunks: DataFrame) -> DataFrame:
    """Chunks (book_id, span_no, text, ...) that are not silent, with ``say`` and their own numbers ``play_no``."""
    t = chunks.withColumn("say", F.expr(T.sanitize(SPARK, "text"))).where("say <> ''")
    return t.withColumn("play_no", F.row_number().over(of_book("span_no")) - 1)


def within_reach(rows: DataFrame) -> DataFrame:
    """Rows (play_no, playing, paused) with ``allowed``: at most AHEAD past the one that plays, none past it while paused; before the first, AHEAD counts as playing."""
    ahead = F.when(F.col("paused"), 0).otherwise(AHEAD)
    return rows.withColumn("allowed", F.col("play_no") <= F.when(F.col("playing") < 0, ahead).otherwise(F.col("playing")) + ahead)


def first_missing(chunks: DataFrame, starts: DataFrame, cached: DataFrame, n: int = AT_START) -> DataFrame:
    """Of the first ``n`` spoken chunks that end after their book's start (book_id, start), those that are not cached (book_id, span_no)."""
    t = chunks.join(starts, "book_id").where(F.col("end") > F.col("start_at"))
    t = t.withColumn("r", F.row_number().over(of_book("span_no"))).where(F.col("r") <= n)
    return t.join(cached, ["book_id", "span_no"], "left_anti").select("book_id", "span_no")


def trimmed(chunks: DataFrame, starts: DataFrame) -> DataFrame:
    """Chunks in which the one that holds its book's start (book_id, start_at) begins there."""
    t = chunks.join(starts, "book_id", "left")
    inside = F.expr("start <= start_at and start_at < end")
    text = F.when(inside, F.expr("substr(text, cast(start_at - start + 1 as int))")).otherwise(F.col("text"))
    return t.select("book_id", "span_no", F.when(inside, F.col("start_at")).otherwise(F.col("start")).alias("start"), "end", text.alias("text"))


def node_targets(docs: DataFrame) -> DataFrame:
    """Nodes of index documents (book_id, doc) with the place of their anchor; nodes without a name or label are left out, and one without an anchor has no place."""
    d = docs.select("book_id", F.from_json("doc", NODES, {"mode": "PERMISSIVE"}).alias("d"))
    n = d.select("book_id", F.explode("d.nodes").alias("n")).select("book_id", F.trim("n.node_id").alias("node_id"), F.trim("n.label").alias("label"), F.trim("n.primary_anchor_id").alias("anchor_id"))
    a = d.select("book_id", F.explode("d.anchors").alias("a")).select("book_id", F.trim("a.anchor_id").alias("anchor_id"), "a.chunk_index", "a.char_offset")
    last = a.groupBy("book_id", "anchor_id").agg(F.max(F.struct("chunk_index", "char_offset")).alias("at"))
    t = n.where("node_id <> '' and label <> ''").join(last, ["book_id", "anchor_id"], "left")
    return t.select("book_id", "node_id", "label", "at.chunk_index", "at.char_offset")


def alignments(docs: DataFrame) -> DataFrame:
    """Timed spans of alignment documents (book_id, doc); a missing confidence is 0.5, a broken document has none."""
    d = docs.select("book_id", F.from_json("doc", ALIGNMENT, {"mode": "PERMISSIVE"}).alias("d"))
    s = d.select("book_id", "d.chunk_id", F.posexplode("d.spans").alias("k", "s"))
    return s.select("book_id", "chunk_id", "k", "s.start_char", "s.end_char", "s.audio_start_ms", "s.audio_end_ms", F.coalesce("s.confidence", F.lit(0.5)).alias("confidence"))


def offsets_of(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (book_id, span_no, ...) with the start of their chunk; a number that no chunk has gives null."""
    return rows.join(chunks.select("book_id", "span_no", "start"), ["book_id", "span_no"], "left")




def alignment_documents(spans: DataFrame) -> DataFrame:
    """(book_id, doc): alignments as JSON documents, from spans (book_id, chunk_id, duration_ms, k, start_char, end_char, audio_start_ms, audio_end_ms, confidence)."""
    span = F.struct("k", F.struct("start_char", "end_char", "audio_start_ms", "audio_end_ms", "confidence").alias("s"))
    each = spans.groupBy("book_id", "chunk_id", "duration_ms").agg(F.transform(F.array_sort(F.collect_list(span)), lambda x: x["s"]).alias("spans"))
    return each.select("book_id", F.to_json(F.struct("chunk_id", "duration_ms", "spans")).alias("doc"))


def published(results: DataFrame) -> DataFrame:
    """Results (book_id, span_no, ready, ...) that can be given out: those that are ready, and all before them too, in order."""
    w = of_book("span_no").rowsBetween(W.Window.unboundedPreceding, 0)
    return results.withColumn("_all", F.min("ready").over(w)).where("_all").drop("_all")


def from_index(chunks: DataFrame, starts: DataFrame) -> DataFrame:
    """Chunks (book_id, span_no, ...) from their book's start index (book_id, start_index) on, numbered anew as ``play_no``."""
    t = chunks.join(starts, "book_id").where("span_no >= start_index")
    return t.withColumn("play_no", F.row_number().over(of_book("span_no")) - 1).drop("start_index")


def completed(docs: DataFrame) -> DataFrame:
    """Index documents (book_id, doc) that can be used: of the known schema, and completed; with the fingerprint of their text."""
    d = docs.select("book_id", F.from_json("doc", INDEX, {"mode": "PERMISSIVE"}).alias("d"))
    return d.where("d.schema_version = 1 and d.status.state = 'completed'").select("book_id", F.trim("d.book.fingerprint_sha256").alias("fingerprint"))


def fresh(docs: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id) of usable index documents that are of the text as it is now."""
    now = books.select("book_id", F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint"))
    return completed(docs).join(now, ["book_id", "fingerprint"], "left_semi").select("book_id")
