"""Page layouts: the body's type size, furniture, kinds, heading levels and drafts of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from spanloom.functions import predicates as P
from spanloom.functions import text as T
from spanloom.functions.dialect import SPARK, WS, column
from spanloom.operators.structure import BRIEF, STRIPPED, of_book, only

#: Pages that a line must be on to be a running head; deepest heading level (fixed values).
PAGES, DEEPEST = 3, 6
#: Three words with letters.
THREE = rf"\p{{L}}.*?{WS}.*?\p{{L}}.*?{WS}.*?\p{{L}}"


def populated(rows: DataFrame) -> DataFrame:
    """Lines that are not blank, with stripped text ``t``, whether they lie in a margin, and their repetition key.

    A key is compared with other lines' in margins alone, and else with titles, which have two words at most: of lines elsewhere
    that begin with three words it is empty.
    """
    bottom = "bottom" if "bottom" in rows.columns else "top + size"
    t = rows.withColumn("t", F.expr(T.strip(SPARK, "text"))).where("t <> ''")
    t = t.withColumn("margin", F.expr(P.in_margin("top", f"({bottom})", "page_height")))
    return t.withColumn("key", only(f"case when margin then false else {SPARK.has(f'substr(t, 1, {BRIEF})', THREE)} end", "''", T.repetition_key(STRIPPED, "t")))


def body_sizes(rows: DataFrame) -> DataFrame:
    """(book_id, body): the type size, to a tenth, of most text; of equal shares the larger."""
    sums = populated(rows).groupBy("book_id", F.bround("size", 1).alias("s")).agg(F.sum(F.length("t")).alias("n"))
    return sums.groupBy("book_id").agg(F.max_by("s", F.struct("n", "s")).alias("body"))


def running_heads(rows: DataFrame) -> DataFrame:
    """(book_id, key, n_pages): what the margins of at least PAGES pages have, numbers aside."""
    t = populated(rows).where("margin and key <> ''")
    return t.groupBy("book_id", "key").agg(F.count_distinct("page_index").alias("n_pages")).where(F.col("n_pages") >= PAGES)


def classified(rows: DataFrame) -> DataFrame:
    """Lines with ``kind``, and with ``first_kind``, which it was before page numbers beside contents entries were told."""
    # what is known of a book is joined by book, as the lines are dealt: a join by more columns would move and sort all lines again
    heads = running_heads(rows).groupBy("book_id").agg(F.collect_list("key").alias("_heads"))
    t = populated(rows).join(body_sizes(rows).join(heads, "book_id", "left"), "book_id")
    t = t.withColumn("repeats", only("margin", "array_contains(_heads, key)")).drop("_heads")
    t = t.withColumn("large", F.expr(P.is_large(STRIPPED, "t", "size", "bold", "body")))
    page = W.Window.partitionBy("book_id", "page_index")
    t = t.withColumn("indexed", F.max(F.expr(f"key in {P.listed(P.INDEX_TITLES)} and (margin or large)")).over(page))
    # cases and no conjunctions, of which the optimizer would work out what they share for every line
    entry, folio = only(P.may_have_leader(STRIPPED, "t"), P.is_contents_entry(STRIPPED, "t")), P.is_folio(STRIPPED, "t")
    kind = (
        F.when(entry, "toc_entry").when(only("margin", folio), "page_number").when(F.col("margin") & F.col("repeats"), "running_head")
        .when(F.col("large"), "heading").when(F.col("indexed"), "index_entry").otherwise("paragraph")
    )
    t = t.withColumn("first_kind", kind)
    w = of_book("ord")
    beside = [F.coalesce(f("first_kind").over(w) == "toc_entry", F.lit(False)) for f in (F.lag, F.lead)]
    t = t.withColumn("beside", beside[0] | beside[1])
    return t.withColumn("kind", F.when(only("first_kind = 'paragraph' and beside", folio), "page_number").otherwise(F.col("first_kind"))).drop("beside")


def levels(c: DataFrame) -> DataFrame:
    """(book_id, size, level): the sizes of headings from the largest, DEEPEST levels at most."""
    sizes = c.where("kind = 'heading'").select("book_id", F.bround("size", 1).alias("size")).distinct()
    return sizes.withColumn("level", F.least(F.dense_rank().over(of_book(F.col("size").desc())), F.lit(DEEPEST)))


def furniture(c: DataFrame) -> DataFrame:
    """(book_id, page_index, text, n): running heads and page numbers in the margin, page by page."""
    gone = (F.col("kind") == "running_head") | ((F.col("kind") == "page_number") & F.col("margin"))
    return c.where(gone).groupBy("book_id", "page_index", F.col("t").alias("text")).agg(F.count("*").alias("n"))


def stripped(rows: DataFrame, f: DataFrame) -> DataFrame:
    """Lines without the furniture of their page: of equal lines the first ``n`` go."""
    t = rows.withColumn("t", F.expr(T.strip(SPARK, "text")))
    t = t.withColumn("rank", F.row_number().over(W.Window.partitionBy("book_id", "page_index", "t").orderBy("ord")))
    f = f.withColumnRenamed("text", "t")
    return t.join(f, ["book_id", "page_index", "t"], "left").where("n is null or rank > n").select(*rows.columns)


def cleared(rows: DataFrame) -> DataFrame:
    """Lines without the furniture of their page, as ``stripped`` leaves them, told in one pass over the kinds: furniture is lines of these rows, so no join finds it."""
    same = W.Window.partitionBy("book_id", "page_index", "t")
    c = classified(rows)
    gone = (F.col("kind") == "running_head") | ((F.col("kind") == "page_number") & F.col("margin"))
    t = c.withColumn("_rank", F.row_number().over(same.orderBy("ord"))).withColumn("_n", F.count_if(gone).over(same))
    return t.where("_rank > _n").select(*rows.columns).unionByName(rows.where(F.expr(T.strip(SPARK, "text")) == ""))


def drafts(c: DataFrame) -> DataFrame:
    """(book_id, ord, kind, level, text): lines of one block, kind and level are one draft; furniture gives none, but parts drafts."""
    w = of_book("ord")
    lv = levels(c).withColumnRenamed("size", "s")
    t = c.withColumn("s", F.bround("size", 1)).join(lv, ["book_id", "s"], "left").withColumn("level", F.when(F.col("kind") == "heading", F.coalesce("level", F.lit(1))).otherwise(0))
    run = F.struct("page_index", "block_index", "kind", "level")
    wraps = F.col("kind").isin("paragraph", "heading")
    same = wraps & F.coalesce(F.lag(run).over(w) == run, F.lit(False))
    t = t.withColumn("draft", F.sum((~same).cast("int")).over(w))
    gone = (F.col("kind") == "running_head") | ((F.col("kind") == "page_number") & F.col("margin"))
    t = t.where(~gone)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"])
    # a word that a hyphen breaks at the end of a line is joined to its rest
    joined = F.aggregate(parts, F.lit(""), lambda a, x: F.when(a == "", x).when(a.rlike("[A-Za-z][-‑]$") & x.rlike("^[a-z]"), F.concat(F.regexp_replace(a, "[-‑]$", ""), x)).otherwise(F.concat(a, F.lit(" "), x)))
    out = t.groupBy("book_id", "draft").agg(F.min("ord").alias("ord"), F.min("kind").alias("kind"), F.min("level").alias("level"), joined.alias("text"))
    return rejoined(out.drop("draft"))


def rejoined(d: DataFrame) -> DataFrame:
    """Drafts in which a heading that is only a number is one with the heading after it; the level is the lesser."""
    w = of_book("ord")
    number = (F.col("kind") == "heading") & F.col("text").rlike(r"^\d+(?:\.\d+){0,99}\.?$")
    t = d.withColumn("number", number)
    prev = F.struct(F.lag("number").over(w).alias("number"), F.lag("text").over(w).alias("text"), F.lag("level").over(w).alias("level"))
    t = t.withColumn("prev", prev).withColumn("takes", (F.col("kind") == "heading") & ~F.col("number") & F.coalesce(F.col("prev.number"), F.lit(False)))
    t = t.withColumn("taken", F.col("number") & F.coalesce(F.lead("takes").over(w), F.lit(False))).where("not taken")
    text = F.when(F.col("takes"), F.concat(F.col("prev.text"), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    level = F.when(F.col("takes"), F.least("prev.level", "level")).otherwise(F.col("level"))
    return t.select("book_id", "ord", "kind", level.alias("level"), text.alias("text"))
