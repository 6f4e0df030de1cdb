"""Costly tests of lines are worked out where they can hold, and not for every line."""

import re

from pyspark.sql import functions as F

from spanloom.functions import headings as H
from spanloom.functions.dialect import DUCK, SPARK, nested, with_steps
from spanloom.operators import layout, structure
from spanloom.sources.books import LAYOUT


def conjunctions(df, costly: str) -> list[str]:
    """Conjunctions of the optimized plan that hold ``costly``: what their sides share is worked out for every row."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if re.search(rf" AND (?:(?!THEN)[^,])*{costly}", line.split("Join")[0])]


def books(spark):
    prose = "Some words of a long line that goes on and on, as paragraphs do. " * 12
    text = ["Contents", "Chapter 1 .... 3", "Part 2 . . . . 9", "", "Prologue", "", prose, prose + " . . . . 7", "- 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 -", "", "Running 1", "", "Running 2", "", "RUNNING 3", "", "* " * 80, "", "index" + "." * 90, "xii", "PAGE 12"]
    return spark.createDataFrame([(1, "\n".join(text)), (2, prose)], "book_id long, text string")


def test_lines_are_gated(spark):
    c = structure.classified(structure.lines(books(spark)))
    assert not conjunctions(c, r"lower\(")
    kinds = [r.kind for r in c.where("book_id = 1").orderBy("n").collect()]
    assert kinds == ["heading", "toc_entry", "toc_entry", None, "heading", None, "paragraph", "toc_entry", "paragraph", None, "running_head", None, "running_head", None, "running_head", None, "separator", None, "toc_entry", "page_number", "page_number"]
    assert [r.kind for r in c.where("book_id = 2").collect()] == ["paragraph"]


def test_words_of_layouts_are_counted_where_the_type_is_large(spark):
    t = structure.lines(books(spark)).where("line <> ''").select("book_id", F.col("n").alias("ord"), F.lit(0).alias("page_index"), F.lit(0).alias("block_index"), F.col("line").alias("text"), F.when(F.col("n") == 4, 18.0).otherwise(10.0).alias("size"), (F.col("n") == 6).alias("bold"), F.lit(300.0).alias("top"), F.lit(800.0).alias("page_height"))
    c = layout.classified(t)
    assert not conjunctions(c, r"split\(")
    kinds = {r.ord: r.kind for r in c.where("book_id = 1").collect()}
    assert (kinds[4], kinds[6], kinds[7], kinds[1], kinds[0]) == ("heading", "paragraph", "toc_entry", "toc_entry", "paragraph")


def test_furniture_goes_without_moving_lines(spark):
    """By more than the book no line is dealt out, whatever the size of what it meets; what is left is what a join by page and text leaves."""
    rows = [(1, 10 * p + k, p, p, text, 10.0, False, top, 800.0) for p in range(4) for k, (text, top) in enumerate([("Run 1", 20.0), ("Run 1", 20.0), ("Run 1", 400.0), (" ", 20.0), (str(p), 770.0), ("Some prose here.", 300.0)])]
    t = spark.createDataFrame(rows, LAYOUT).repartition("book_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = layout.cleared(t)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not re.findall(r"Exchange hashpartitioning\(book_id#\d+L?, (?!\d+\))", plan)
        want = layout.stripped(t, layout.furniture(layout.classified(t)))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and 0 < got.count() < len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


LABELS = ["Chapter  iv .. 12", "chapter 3 - The Way", "Part IV: Of Time . . . . xii", "Axiom 2 — ", " prologue ", "One two three four five 12", "Chapter 4 -", "a ․ ․ b", "Title: it xii", "Part 7–", "x . . 3", "", None]


def test_labels_are_cleaned_without_searching_blanks(spark):
    """A leader and a page are looked for where they can be, not at each blank of a label; what is cleaned is as by the plain steps."""
    steps = H.clean_steps(SPARK, "label", "out")
    assert not any("{4}" in e and "instr" not in e for _, e in steps)
    import duckdb

    got = [r.out for r in with_steps(spark.createDataFrame([(k, s) for k, s in enumerate(LABELS)], "k int, label string"), steps).orderBy("k").collect()]
    given = duckdb.connect()
    given.execute("create table t (k int, label varchar)")
    given.executemany("insert into t values (?, ?)", list(enumerate(LABELS)))
    assert got == [r[0] for r in given.sql(f"select out from {nested('t', H.clean_steps(DUCK, 'label', 'out'))} order by k").fetchall()]
