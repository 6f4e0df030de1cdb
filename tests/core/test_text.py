"""Text functions, predicates and labels, by both engines: golden results on short strings."""

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.functions import headings as H
from spanloom.functions import predicates as P
from spanloom.functions import text as T
from spanloom.functions.dialect import DUCK, SPARK, nested
from spanloom.operators import chunking, concepts, landmarks, markdown


def both(spark, f, values):
    """The function's results over the values, which must be the same in both engines."""
    rows = list(enumerate(values))
    mine = [r.o for r in spark.createDataFrame(rows, "i int, s string").select("i", F.expr(f(SPARK, "s")).alias("o")).orderBy("i").collect()]
    c = duckdb.connect()
    c.execute("create table t (i int, s varchar)")
    c.executemany("insert into t values (?, ?)", rows)
    assert mine == [r[0] for r in c.execute(f"select {f(DUCK, 's')} from t order by i").fetchall()]
    return mine


def check(spark, f, pairs):
    assert both(spark, f, [p[0] for p in pairs]) == [p[1] for p in pairs]


def test_normal_forms(spark):
    check(spark, T.normalize_text, [("a\r\nb\rc", "a\nb\nc"), ("  a \t b\n\n\n\nc ", "a b\n\nc"), ("", "")])
    check(spark, T.normalize_markdown, [("# a  \n\n\n  - b\t\n", "# a\n\n  - b"), ("x  y", "x  y")])
    check(spark, T.dehyphenate, [("per-\nformance", "performance"), ("per-\nFormance", "per-\nFormance"), ("so­ft non‑br", "soft non-br")])
    check(spark, T.repetition_key, [("Page 12  of 30", "page of"), ("STRAẞE", "strasse")])
    check(spark, T.match_key, [("a b­‑c\n d", "ab-cd")])
    check(spark, T.marker_key, [("  My-Book: (2nd ed.) ", "my book: (2nd ed"), ("— Title —", "title")])


def test_speech(spark):
    cases = [
        ("1.2 One line\n12\n-----\nTwo", "One line Two"), ("The U.K. and NATO met", "The U K and N A T O met"), ("MPs and GDP", "M P s and G D P"), ("wait… now . then", "wait. now then"), ("aBC ABCDEFGH", "aBC ABCDEFGH"),
        ("a b\x0bc", "a b c"), ("", ""), ("xU.K.", "xU.K."), ("e.g. U.S.A. here", "e.g. U S A here"),
    ]
    check(spark, T.sanitize, cases)
    for s, want in cases:
        assert chunking.spoken(s) == want
    check(spark, T.american, [("Organisational Behaviour", "Organizational behavior"), ("realised, advise rise wise", "realized, advise rise wise"), ("the centred theatres", "the centered theaters"), ("a—b", "a - b"), ("raised", "raized"), ("metre glamour", "meter glamor")])
    check(spark, lambda d, s: T.title_case(d, s), [("don't stop", "Don'T Stop")])


def test_line_tests(spark):
    check(spark, P.is_folio, [("12", True), ("- 12 -", True), ("page 7", True), ("xiv", True), ("Civic", True), ("12345", False), ("", False), ("é", False), ("chapter", False)])
    check(spark, P.is_contents_entry, [("One ..... 5", True), ("One .. 5", True), ("One .. five", False), ("A . . . . 3", True), ("Plain line 3", False), ("One..vi", True)])
    check(spark, lambda d, s: P.is_wrapped_entry(d, "'Experience'", s), [(". . . .", True), ("11", True), ("xi", True), ("·····", True), ("Next", False), ("", False), ("...x", False)])
    check(spark, P.is_index_line, [("", True), ("On Time ..... 3", True), ("3.1", True), ("A short title", True), ("It ends.", False), ("MORE THAN SIX WORDS BUT ALL CAPITALS", True), ("this one has got more than six words", False)])
    check(spark, P.is_rule, [("---", True), ("* * *", True), ("__", False), ("-*-", False), ("    ---", False), ("-" * 9000, True)])
    check(spark, P.is_division, [("Chapter 1", True), ("PROLOGUE.", True), ("Chapters of it", False), ("part: two", True), ("Index", True)])
    check(spark, P.is_shouted, [("ALL CAPS", True), ("Straße", False), ("STRAßE", False), ("123", False)])
    check(spark, P.ends_abbreviated, [("the best.", True), ("Dr.", True), ("dog.", False)])
    check(spark, P.is_paragraph_line, [("This is a line.", True), ("THIS IS IT.", False), ("two words", False)])
    check(spark, P.is_weak_label, [("With", True), ("When now", True), ("Decision Architecture", False), ("", True)])
    check(spark, P.markdown_kind, [("# a", "heading"), ("===", "underline"), ("---", "underline"), ("* * *", "rule"), ("> q", "quote"), ("- i", "item"), ("3) i", "item"), ("~~~", "fence"), (" ", "blank"), ("x", "text"), ("#x", "text")])
    check(spark, P.markdown_level, [("### a", 3), ("===", 1), ("--", 2), ("    - x", 3), ("x", 0)])


@pytest.mark.parametrize(
    ("label", "clean", "kind"),
    [
        ("chapter iv", "Chapter IV", "chapter"), ("Chapter 3 - The End", "Chapter 3: The End", "chapter"), ("CHAPTER 2: Foo Bar ..... 12", "Chapter 2: Foo Bar", "chapter"), ("part ii", "Part II", "part"), ("prologue", "Prologue", "prologue"),
        ("Contents", "Contents", None), ("Appendix A Notes", "Appendix A Notes", "section"), ("appendix", "appendix", "appendix"), ("The Art of War", "The Art of War", "section"), ("Book 2", "Book 2", "book"), ("axiom 3 on time", "axiom 3: on time", "axiom"),
        ("plain words in a row here", "plain words in a row here", None), ("Chapter 5:", "Chapter 5", "chapter"), ("Ch. 7 Something", "Ch. 7 Something", "chapter"), ("Introduction . . . . . 4", "Introduction", "introduction"), ("", "", None),
    ],
)
def test_labels(spark, label, clean, kind):
    row = landmarks.cleaned(spark.createDataFrame([(label,)], "label string")).first()
    assert (row.clean, row.kind) == (clean, kind)
    sql = f"select clean, {H.kind(DUCK, 'clean')} from {nested('(select ? as label)', H.clean_steps(DUCK, 'label', 'clean'))}"
    assert duckdb.execute(sql, [label]).fetchone() == (clean, kind)


def test_chunks():
    text = "Tiny bit. This sentence is long enough to stand alone here. Another one follows now."
    out = chunking.chunk(text, 20, 40)
    assert " ".join(t for t, _, _ in out).split() == text.split()
    assert chunking.sentences("Mr. Smith left. He ran.") == ["Mr. Smith left.", "He ran."]
    assert chunking.sentences("It was the best. So there.") == ["It was the best. So there."]
    # cut after a comma rather than a space; a run of blanks across the limit is cut there
    assert [p for p, _ in chunking.Cuts("aaa, bbb ccc ddd eee").pieces(12)] == ["aaa,", "bbb ccc ddd", "eee"]
    assert [p for p, _ in chunking.Cuts("aaaa      bbbb").pieces(6)] == ["aaaa", "bb", "bb"]
    assert [p for p, _ in chunking.Cuts("x" * 25).pieces(10)] == ["x" * 10, "x" * 10, "x" * 5]
    # a sentence that is too long is a chunk where another follows it, and wrapped as the last
    two = "Word " * 10 + "end. Short one."
    assert [t for t, _ in chunking.packed(two, 5, 20)][0] == ("Word " * 10 + "end.")
    long = "word " * 100
    assert all(len(t) <= 40 for t, _, _ in chunking.chunk(long, 20, 40))
    run = "One  two­ three. Four."
    for c in chunking.run_chunks(run):
        assert chunking.Folded.key(run[c["start"] : c["end"]]) == chunking.Folded.key(c["text"])


def test_located():
    assert chunking.located("ab cd  ef", ["a b", "nope", "cdef"]) == [(0, 2), None, (3, 9)]
    assert chunking.located("aa", ["a", "a", "a"]) == [(0, 1), (1, 2), None]


def test_character_map():
    for s in ("ONE two", "1.2 A — B\n\n12\nC", "", "  x  ", "U.K. rules"):
        say, offsets = chunking.mapped(s)
        assert len(say) == len(offsets) and all(0 <= o < len(s) for o in offsets)


def texts(spark, *of):
    return spark.createDataFrame(list(enumerate(of)), "book_id long, text string")


def test_heading_scan(spark):
    text = "Prologue\n\nSome text that goes on here.\n\nChapter 1: The Long\nRoad Home\n\nBody text is here, and it ends.\n\nA Quiet Evening\n\nmore"
    rows = chunking.heading_scan(texts(spark, text, "", "Part IV\nOf Time and\nThe World\nAgain Then\nOnce More\nThe Last Word\n\nChapter 7\nThe Title Below\n", "A Half-\nForgotten Thing\n\nend")).collect()
    got = [(h.label, h.char_offset) for h in rows if h.book_id == 0]
    assert ("Prologue", 0) in got and ("Chapter 1: The Long Road Home", text.index("Chapter")) in got and ("A Quiet Evening", text.index("A Quiet")) in got
    assert not any(label == "Road Home" for label, _ in got)
    labels = [h.label for h in sorted((h for h in rows if h.book_id == 2), key=lambda h: h.char_offset)]
    assert labels == ["Part IV", "The Last Word", "Chapter 7", "The Title Below"]
    assert [h.label for h in rows if h.book_id == 3] == ["A HalfForgotten Thing", "end"]


def test_essay_index(spark):
    text = "Prologue\n\nEssay Index\n\nOn Time ..... 3\nAppendix A ···· 12\nOn Space ..... 9\n\nChapter 1\n\nBody"
    row = chunking.essay_spans(texts(spark, text, "No such thing", "Essay index without an end", "ESSAY INDEX\r\nOne\r\nIntroduction\r\n")).collect()
    spans = {r.book_id: (r.lo, r.hi) for r in row}
    assert set(spans) == {0, 3}
    lo, hi = spans[0]
    assert text[lo:hi].strip().startswith("Essay Index") and text[hi:].startswith("Chapter 1") and text[:lo] == "Prologue\n"
    assert spans[3] == (0, 18)


def test_markdown(spark):
    text = "# Title\n\nFirst *para*\ngoes on\n\nUnder\n=====\n\n- a\n  - b `c`\n> q1\n> **q2**\n```\n# no\n\n```\n---\nlast \\*x\\*"
    rows = markdown.markdown_blocks(texts(spark, text, "", "==\n==\n==\n\n- - -\n~~~\nopen\n````\n", "> \n\n****\n`` ``\n1. one\n\t2) two", chr(0xE100) + " \\* " + chr(0xE0FF) + chr(0xE1FF) + " \\_a\\_ _b_ _c_"), "book_id").collect()
    of = lambda k: [(b.kind, b.level, b.text) for b in sorted((r for r in rows if r.book_id == k), key=lambda r: r.block_no)]
    assert of(0) == [("heading", 1, "Title"), ("paragraph", 0, "First para goes on"), ("heading", 1, "Under"), ("list_item", 1, "a"), ("list_item", 2, "b c"), ("block_quote", 0, "q1 q2"), ("code", 0, "# no"), ("separator", 0, ""), ("paragraph", 0, "last *x*")]
    assert all(text[b.start : b.end].strip() for b in rows if b.book_id == 0)
    assert of(1) == []
    # the first underlines nothing and is text, the second underlines it, the third is text again; an open fence reaches the end
    assert of(2) == [("heading", 1, "=="), ("paragraph", 0, "=="), ("separator", 0, ""), ("code", 0, "open\n````")]
    assert of(3)[0] == ("block_quote", 0, "") and of(3)[1][0] == "separator" and of(3)[-2:] == [("list_item", 1, "one"), ("list_item", 1, "two")]
    assert of(4) == [("paragraph", 0, chr(0xE100) + " * " + chr(0xE0FF) + chr(0xE1FF) + " _a_ b c")]


def test_weak_labels_are_expanded(spark):
    t = texts(spark, "When decisions are made\n\nX", "When: decisions are made", "x", "The world of\nmen and women, then\n\nmore", "  Of old kings and queens")
    rows = spark.createDataFrame([(0, "When", 0), (1, "When", 0), (2, "Decision Architecture", 0), (3, "The", 0), (3, "of", 10), (4, " ", 0)], "book_id long, label string, char_offset long")
    got = {(r.book_id, r.char_offset): r.label for r in concepts.expand_labels(rows, t, "book_id").collect()}
    assert got == {(0, 0): "When decisions made", (1, 0): "When", (2, 0): "Decision Architecture", (3, 0): "The world men women", (3, 10): "of men women", (4, 0): "Ideas"}


def test_character_map_places():
    """White space stands for the next run, a character for itself before one alike, and what is nowhere moves nothing."""
    assert chunking.mapped("a  b\n\nc") == ("a b c", [0, 1, 3, 4, 6])
    assert chunking.mapped("wait…")[0] == "wait." and chunking.mapped("wait…")[1] == [0, 1, 2, 3, 4]
    # a letter whose lower case is longer does not end the search for others that are alike but for case
    index = chunking.Index("İx B b")
    assert (index.first("b", 0), index.first("b", 6), index.first("β", 0), index.first("B", 4), index.first(" ", 3)) == (5, None, None, 5, 4)
    long = "abc " * 50_000
    assert chunking.mapped(long)[1] == list(range(len(long) - 1))
