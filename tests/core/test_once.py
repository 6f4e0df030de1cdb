"""What several branches of a query tell from is worked out once; files of few row groups are many tasks."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import headings as H
from spanloom.functions.dialect import SPARK
from spanloom.operators import landmarks
from spanloom.plans import catalogue, further, more, reading, streams, whole  # noqa: F401
from spanloom.sources import books as B

DATA = "/root/testdata/sf0.001"
#: Query, and how often its plan may cut texts into lines; navigation looks for an essay index too.
LINES = {"matched_occurrences": 0, "navigation_chunks_forced": 1, "heading_occurrences": 1, "navigation_chunks": 1, "cache_misses": 0, "chapter_chunks": 0, "merged_landmarks": 0, "chapter_progress_ranged": 0, "narration_chunks": 0}


@pytest.mark.parametrize("name", LINES)
def test_texts_are_cut_into_lines_once(spark, name):
    plan = catalogue.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    cuts = [line for line in plan.splitlines() if "posexplode(split(" in line or "posexplode(regexp_extract_all(" in line]
    assert len(cuts) <= LINES[name], cuts


def test_a_row_group_is_many_tasks(spark, tmp_path):
    spark.range(20_000).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        sizes = [len(p) for p in B.table(spark, str(tmp_path), "documents").rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(sizes) == 20_000 and max(sizes) < 10_000


WORDS = {"The Way of All": (4, 4), "over The -- hill": (2, 2), "1984 in Kew": (2, 3), "7B 7b 7-8 x": (1, 1), "aé (An) É 12. ÉA": (4, 5), "…  andy": (1, 1)}


@pytest.mark.parametrize("digits", (False, True))
def test_title_words(spark, digits):
    rows = spark.createDataFrame([(w,) for w in WORDS], "w string").selectExpr("w", f"{H.title_words(SPARK, 'w', digits)} as n").collect()
    assert {r.w: r.n for r in rows} == {w: n[digits] for w, n in WORDS.items()}


def test_labels_of_lines_are_matched_without_a_join(spark):
    """Labels taken from the lines of a book meet no other rows than those of their key, and have the occurrences that a join finds."""
    text = "Chapter 1: A Storm\n\nChapter 1\n\nThe Way\nof All\n\nThe Way of All\n\nthe way\nOF ALL\n\nPart 2\n\nPart 2 - On\n\nContents .... 3\n\nThe Way\n"
    o = landmarks.occurrences(spark.createDataFrame([(1, text), (2, text[20:])], "book_id long, text string"))
    got = landmarks.matched_own(o)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    mark = F.regexp_extract("label", r"(?i)^((?:chapter|part|book)\s+[0-9ivxlcdm]+)(?:$|[^\p{L}\p{N}_])", 1)
    wanted = o.where("not probable_toc and match <> 'prefix'").groupBy("book_id", "key").agg(F.any_value(F.when(mark != "", F.lower(mark))).alias("prefix_key"))
    want = landmarks.matched(wanted, o).select("book_id", "key", "match", "at")
    assert sorted(map(tuple, got.select("book_id", "key", "match", "char_offset").collect())) == sorted(map(tuple, want.collect())) and got.count() > 20


def test_lines_are_not_wrapped_where_only_exact_ones_are_asked_for(spark):
    plan = catalogue.queries()["best_occurrence"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "wrapped" not in plan and "prefix" not in plan
