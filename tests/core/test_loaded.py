"""Files are parsed and cut once, and of files of one title and beginning the first by path is the book."""

from spanloom.operators import loading
from spanloom.plans import catalogue, further  # noqa: F401


def test_files_are_parsed_and_cut_once(spark):
    plan = catalogue.queries()["load_blocks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "make_valid_utf8" not in plan and "validate" not in plan.lower() and "posexplode(split(" not in plan


def test_one_book_of_equal_files(spark):
    files = spark.createDataFrame([(f"/{d}/Same.txt", bytearray(b"Chapter 1\n\nSome prose, and more of it.")) for d in "cab"] + [("/z/Other.md", bytearray(b"# Head\n\nText."))], "path string, content binary")
    books, blocks = loading.loaded(files.repartition(4))
    assert sorted((r.path, r.format) for r in books.collect()) == [("/a/Same.txt", "text"), ("/z/Other.md", "markdown")]
    assert blocks.select("book_id").distinct().count() == 2


def test_blocks_of_every_document(spark, tmp_path):
    """Markdown and documents without a text have blocks as others do."""
    texts = [(3, "# Head\n\nSome prose, and more of it."), (4, "Chapter 1\n\nSome prose, and more of it."), (5, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = catalogue.queries()["load_blocks"](spark, str(tmp_path)).collect()
    assert len({r.book_id for r in rows}) == 3
    assert {"Head", "Chapter 1"} <= {r.text for r in rows if r.kind == "heading"} and len([r for r in rows if r.text.endswith("End.")]) == 3
