"""The concept index of a text: frequent words, headings, labels, and the nodes that point to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from spanloom.functions import predicates as P
from spanloom.functions import text as T
from spanloom.functions.dialect import SPARK, Spark, column
from spanloom.operators import asof, chunking
from spanloom.operators.structure import lines, of_book, only
from spanloom.shared import checkpoint

#: Concepts and headings of a text, at most (fixed values of the feature); characters of a text that are indexed: None is all of them.
CONCEPTS, HEADINGS, CHARACTERS = 5, 50, None
#: Labels without blanks around them.
LABEL = Spark(("label",))
TOKEN = "[A-Za-z][A-Za-z'-]+"
#: Words that a weak label takes from its paragraph, at least and at most (fixed values).
TAKEN = (2, 4)


def top_concepts(texts: DataFrame, key: str, most: int = CONCEPTS) -> DataFrame:
    """(key, term, label, n, char_offset): the most frequent words, ties by the alphabet; the offset is of the letters' first occurrence."""
    words = texts.select(key, F.explode(F.expr(f"regexp_extract_all(text, {SPARK.lit(TOKEN)}, 0)")).alias("w")).select(key, F.lower("w").alias("term"))
    words = words.where(~F.col("term").isin(*P.STOPWORDS) & (F.length("term") >= 3))
    counted = words.groupBy(key, "term").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.Window.partitionBy(key).orderBy(F.desc("n"), "term"))
    top = counted.withColumn("r", rank).where(F.col("r") <= most).groupBy(key).agg(F.collect_list(F.struct("term", "n")).alias("_terms"))
    # a text is put in small letters once, not for each of its words
    met = top.join(texts.select(key, F.lower("text").alias("_low")), key).select(key, F.expr("inline(transform(_terms, x -> struct(x.term as term, x.n as n, instr(_low, x.term) - 1 as at)))"))
    return met.select(key, "term", F.expr(T.title_case(SPARK, "replace(term, '-', ' ')")).alias("label"), "n", F.col("at").cast("long").alias("char_offset"))


def index_headings(rows: DataFrame, most: int = HEADINGS) -> DataFrame:
    """(book_id, label, char_offset): lines that the index takes for headings.

    A chapter's or part's line always counts; another one of at most eight words does when half its words have a
    capital. The search ends at the line with which ``most`` are reached, unless that is a chapter's or part's.
    """
    t = rows.withColumn("label", F.expr(T.strip(SPARK, "line"))).where(only("length(label) between 3 and 80", P.is_reasonable_heading(LABEL, "label")))
    mark = F.col("label").rlike(r"(?i)^(?:chapter|part)[ \t]+(?:[0-9]+|[ivxlcdm]+)($|[^\p{L}\p{N}_])")
    capital = P.words_of(SPARK, "label")
    n, caps = F.expr(f"size({capital})"), F.expr(f"size(filter({capital}, x -> substr(x, 1, 1) = upper(substr(x, 1, 1)) and substr(x, 1, 1) <> lower(substr(x, 1, 1))))")
    t = t.withColumn("mark", mark).withColumn("weak", ~mark & (n <= 8) & (caps >= F.greatest(F.lit(1), F.floor(n / 2))))
    w = of_book("n")
    t = t.withColumn("so_far", F.sum((F.col("mark") | F.col("weak")).cast("int")).over(w))
    full = F.min(F.when(~F.col("mark") & (F.col("so_far") >= most), F.col("n"))).over(of_book())
    t = t.withColumn("full", full).where("(mark or weak) and (full is null or n <= full)")
    return t.select("book_id", "label", F.col("start").alias("char_offset"))


def expanded(label: str, tail: str) -> str:
    """SQL text for a label; one of only weak words takes up to four that are not from the text at it, up to a mark or the paragraph's end.

    ``tail`` is the text from the label on. Its first words, as many as the label has, are the label's own.
    """
    base = f"case when {T.strip(SPARK, label)} = '' then 'Ideas' else {T.strip(SPARK, label)} end"
    own = f"size({P.words_of(SPARK, base)})"
    paragraph = f"regexp_extract(replace(substring_index({tail}, '\\n\\n', 1), '\\n', ' '), '^[^,.;:!?]*', 0)"
    words = f"regexp_extract_all({paragraph}, {SPARK.lit(TOKEN[:-1] + '*')}, 0)"
    strong = f"filter(slice({words}, {own} + 1, greatest(size({words}), 1)), x -> lower(x) not in {P.listed([*P.STOPWORDS, *P.JOIN_WORDS])})"
    return f"case when {P.is_weak_label(SPARK, base)} and size({strong}) >= {TAKEN[0]} then concat({base}, ' ', array_join(slice({strong}, 1, {TAKEN[1]}), ' ')) else {base} end"


def expand_labels(rows: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Rows (key, label, char_offset, ...) with their labels expanded from the texts (key, text); only weak labels meet a text."""
    weak = column(P.is_weak_label, "label")
    tail = texts.select(key, F.col("text").alias("_text"))
    met = rows.where(weak).join(tail, key).withColumn("_tail", F.expr("substr(_text, cast(greatest(char_offset, 0) + 1 as int))"))
    own = met.withColumn("label", F.expr(expanded("label", "_tail"))).select(*rows.columns)
    return rows.where(~weak).withColumn("label", F.expr(T.strip(SPARK, "label"))).unionByName(own)


def index_nodes(texts: DataFrame) -> DataFrame:
    """(book_id, node_id, label, anchor_id, chunk_index, char_offset) of texts (book_id, text, from): one node for all, then headings, then concepts, each with its chunk.

    Texts are indexed from where they are read to their end. Furniture and what lies in an essay index give no
    node; neither does what no spoken chunk follows.
    """
    start = F.greatest(F.lit(0), F.least(F.coalesce("from", F.lit(0)), F.length("text"))).cast("long")
    body = checkpoint(texts.withColumn("from", start).select("book_id", "from", F.expr("substr(text, cast(from + 1 as int))").alias("text")))
    own = body.select("book_id", "text")
    w = of_book("k")
    cut = own.select("book_id", F.posexplode(chunking.raw_chunk_udf("text")).alias("k", "c")).select("book_id", "k", "c.text", "c.end")
    # a letter is spoken wherever it stands: only chunks without one are cleaned to see whether anything is left
    cut = cut.where(only(SPARK.has("text", "[A-Za-z]"), "true", f"{T.sanitize(SPARK, 'text')} <> ''")).select("book_id", (F.row_number().over(w) - 1).alias("chunk_index"), "end")
    # ends go back where a sentence was wrapped: only a chunk that ends past all before it can be the first to end past an offset
    past = F.coalesce(F.max("end").over(of_book("chunk_index").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(-1))
    reach = checkpoint(cut.withColumn("past", past).where("end > past").select("book_id", "chunk_index", "end"))
    heads = index_headings(lines(own)).where(~column(P.is_artefact, "label"))
    words = top_concepts(own, "book_id").where("lower(label) <> 'top concepts'")
    some = reach.select("book_id").distinct().select("book_id", F.lit(0).alias("part"), F.lit("Top Concepts").alias("label"), F.lit(0).cast("long").alias("char_offset"), F.lit(0).cast("long").alias("n"), F.lit("").alias("term"))
    rows = heads.select("book_id", F.lit(1).alias("part"), "label", F.col("char_offset").cast("long").alias("char_offset"), F.lit(0).cast("long").alias("n"), F.lit("").alias("term"))
    rows = rows.unionByName(words.select("book_id", F.lit(2).alias("part"), "label", "char_offset", (-F.col("n")).alias("n"), "term"))
    rows = some.unionByName(expand_labels(rows, own, "book_id"))
    rows = rows.join(chunking.essay_spans(own), "book_id", "left").where("lo is null or char_offset < lo or char_offset >= hi").drop("lo", "hi")
    hit = asof.forward(rows, "char_offset", reach, "end", "book_id").where("hit is not null")
    number = F.row_number().over(of_book("part", "char_offset", "n", "term")).cast("string")
    t = hit.withColumn("number", number).join(body.select("book_id", "from"), "book_id")
    return t.select("book_id", F.concat(F.lit("n"), "number").alias("node_id"), F.expr(T.strip(SPARK, "label")).alias("label"), F.concat(F.lit("a"), "number").alias("anchor_id"), F.col("hit.chunk_index").alias("chunk_index"), (F.col("from") + F.col("char_offset")).alias("char_offset"))


def concept_index(books: DataFrame, bounds: DataFrame) -> DataFrame:
    """(book_id, node_id, label, anchor_id, chunk_index, char_offset): the index of each book."""
    return index_nodes(books.join(bounds.select("book_id", F.col("body_opening").alias("from")), "book_id"))


def index_documents(nodes: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, doc): the index of each book as one JSON document, with the fingerprint of its text; a book without nodes has an empty one."""
    anchor, node = F.struct("anchor_id", "chunk_index", "char_offset"), F.struct("node_id", "label", F.col("anchor_id").alias("primary_anchor_id"))
    number = F.substring("node_id", 2, 20).cast("int").alias("number")
    per = nodes.select("book_id", F.struct(number, anchor.alias("a"), node.alias("n")).alias("x")).groupBy("book_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    t = books.select("book_id", F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint_sha256")).join(per, "book_id", "left").withColumn("x", F.coalesce("x", F.array().cast(per.schema["x"].dataType)))
    book, status = F.struct(F.col("book_id").cast("string").alias("book_id"), "fingerprint_sha256"), F.struct(F.lit("completed").alias("state"))
    parts = [F.lit(1).alias("schema_version"), book.alias("book"), status.alias("status"), F.transform("x", lambda x: x["a"]).alias("anchors"), F.transform("x", lambda x: x["n"]).alias("nodes")]
    return t.select("book_id", F.to_json(F.struct(*parts)).alias("doc"))
