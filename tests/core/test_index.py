"""The concept index cleans, folds and tests no more text than it must."""

from spanloom.operators import concepts, structure


def test_a_text_is_folded_once_for_all_its_words(spark):
    t = spark.createDataFrame([(1, "Storm and storms. A STORM, the harbour-light; harbour-light Island island island")], "book_id long, text string")
    top = concepts.top_concepts(t, "book_id", most=3)
    assert "instr(lower" not in top._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.term, r.label, r.n, r.char_offset) for r in top.collect()) == [("harbour-light", "Harbour Light", 2, 31), ("island", "Island", 3, 60), ("storm", "Storm", 2, 0)]


def test_headings_among_long_and_odd_lines(spark):
    text = "\n".join(["Chapter 4", "The Storm", "x" * 300, "Ends here.", "a:b:c", "12", "é", "The Isle"])
    h = concepts.index_headings(structure.lines(spark.createDataFrame([(1, text)], "book_id long, text string")))
    assert [r.label for r in h.orderBy("char_offset").collect()] == ["Chapter 4", "The Storm", "The Isle"]


def test_a_long_text_is_indexed_to_its_end(spark):
    """The last heading is past 200,000 characters, and the most frequent word is only there."""
    prose = "".join(f"Mills{k} and towers{k} stood by the water as they always had. " for k in range(4000))
    text = f"Chapter 1\n\n{prose}\n\nChapter 2\n\n{'Harbour lights went out. ' * 5000}"
    rows = concepts.index_nodes(spark.createDataFrame([(1, text, 0)], "book_id long, text string, from long")).collect()
    at = {r.label: r.char_offset for r in rows}
    assert at["Chapter 2"] == text.index("Chapter 2") > 200_000 and at["Harbour"] == text.index("Harbour")
    assert max(r.chunk_index for r in rows) > 200_000 // 220
