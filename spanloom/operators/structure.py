"""Plain text to lines, blocks, sections and contents; where the body begins; what is shown and what is spoken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from spanloom.functions import predicates as P
from spanloom.functions import text as T
from spanloom.functions.dialect import ND, SPARK, WS, Spark, column
from spanloom.operators import asof

#: A structure is believed when its blocks cover so much of the text and show so much of it (fixed values).
COVERED, DISPLAYED = 0.90, 0.05
#: Times that a line must come alone for its repetitions to be running heads; entries of a contents list, at least.
REPEATS, ENTRIES = 3, 2
#: Lines without blanks around them, as column ``t``.
STRIPPED = Spark(("t",))
#: Characters of a line in which more words than a short line has are looked for, and least parts that they then are: one may be empty at either end.
HEAD, PARTS = 400, 15
#: Characters at a line's beginning in which three words tell that it is neither a number nor a rule, and how they look.
BRIEF, PROSE = 64, r"[\p{L}\p{N}][^\p{L}\p{N}]+[\p{L}\p{N}]+[^\p{L}\p{N}]+[\p{L}\p{N}]"
#: Most characters of a title that is compared with known ones; each of those is shorter.
TITLE = 40


def of_book(*order: str) -> W.WindowSpec:
    return W.Window.partitionBy("book_id").orderBy(*order) if order else W.Window.partitionBy("book_id")


def before(w: W.WindowSpec) -> W.WindowSpec:
    return w.rowsBetween(W.Window.unboundedPreceding, -1)


def kinds(where: int) -> list[str]:
    """Kinds that are shown (1) or spoken (2)."""
    return [k[0] for k in P.BLOCK_KINDS if k[where]]


def running(rows: DataFrame, key: str, n: str, value: str, segment: int) -> DataFrame:
    """Rows (key, n, ...) with ``before``: the sum of ``value`` over the rows of a key before each, ``n`` counting them from 0.

    In two levels: sums within segments of so many rows, each a group of its own, and the segments' totals, a row each,
    summed and joined to them. A key of any size so is many tasks.
    """
    t = rows.withColumn("_segment", F.floor(F.col(n) / segment))
    within = W.Window.partitionBy(key, "_segment").orderBy(n).rowsBetween(W.Window.unboundedPreceding, -1)
    totals = t.groupBy(key, "_segment").agg(F.sum(value).alias("_total"))
    past = F.sum("_total").over(W.Window.partitionBy(key).orderBy("_segment").rowsBetween(W.Window.unboundedPreceding, -1))
    past = totals.select(F.col(key).alias("_key"), F.col("_segment").alias("_at"), F.coalesce(past, F.lit(0)).alias("_past"))
    met = t.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(past, (F.col(key) == F.col("_key")) & (F.col("_segment") == F.col("_at")))
    return met.select(*rows.columns, (F.col("_past") + F.col("_within")).alias("before"))


def lines(books: DataFrame, segment: int | None = None) -> DataFrame:
    """(book_id, n, start, end, line): every line of each text with its span; joined by line feeds they are the text.

    With ``segment``, for texts of very many lines, offsets are summed in two levels, so many lines a group; else a
    book's windows stay in the one task where all that follows on it runs too.
    """
    rows = books.where("text <> ''").select("book_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    if segment is None:
        rows = rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before(of_book("n"))), F.lit(0)))
    else:
        rows = running(rows.withColumn("size", F.length("line") + 1), "book_id", "n", "size", segment).withColumnRenamed("before", "start")
    return rows.select("book_id", "n", "start", (F.col("start") + F.length("line")).alias("end"), "line")


def only(test: str, then: str, other: str = "false") -> Column:
    """``then`` where ``test`` holds, from SQL text: a case and no conjunction, of which the optimizer would work out for every row what its parts share."""
    return F.expr(f"case when {test} then {then} else {other} end")


def wordy(s: str) -> str:
    """SQL text for: a text that has more words than a short line without its digits, told from its first HEAD characters."""
    head = SPARK.sub(f"substr({s}, 1, {HEAD})", f"{ND}+")
    return f"case when length({s}) > {HEAD} then size(split({head}, {SPARK.lit(WS + '+')}, {PARTS})) >= {PARTS} else false end"


def classified(rows: DataFrame) -> DataFrame:
    """Lines with ``kind`` and ``level``; blank lines have none.

    What a line is by itself is tested once, before the windows over its book.
    """
    w = of_book("n")
    t = rows.withColumn("t", F.expr(T.strip(SPARK, "line")))
    # a line may be a whole paragraph: what only a title, a number or an entry can be is tested where it can be one;
    # the key of a line with more words than a short one has is no short line's, and is left out
    t = t.withColumn("wordy", F.expr(wordy("t"))).withColumn("prose", only(f"length(t) > {BRIEF}", SPARK.has(f"substr(t, 1, {BRIEF})", PROSE)))
    t = t.withColumn("bare", only(f"length(trim(trailing '.' from t)) <= {TITLE}", P.bare(STRIPPED, "t"), "''"))
    t = t.select(
        "*", (F.col("t") == "").alias("blank"), only("wordy", "''", T.repetition_key(STRIPPED, "t")).alias("key"), only(P.may_have_leader(STRIPPED, "t"), P.is_contents_entry(STRIPPED, "t")).alias("entry_like"),
        column(P.ends_sentence, "right(t, 1)").alias("stops"), only("wordy", "false", P.is_short(STRIPPED, "t")).alias("short"), only("wordy", "false", P.is_shouted(STRIPPED, "t")).alias("shouted"),
        only("prose", "false", P.is_folio(STRIPPED, "t")).alias("folio"), only("prose", "false", P.is_rule(STRIPPED, "t")).alias("rule"), only(P.may_be_numbered(STRIPPED, "t"), P.is_numbered_division(STRIPPED, "t")).alias("numbered"),
        F.expr(f"bare in {P.listed(P.CONTENTS)}").alias("lists"), F.expr(f"bare in {P.listed(P.STANDALONE)}").alias("standing"),
    ).drop("wordy", "prose", "bare")
    t = t.withColumn("division", F.col("standing") | F.col("numbered")).drop("standing", "numbered")
    t = t.withColumn("alone", F.coalesce(F.lag("blank").over(w), F.lit(True)) & F.coalesce(F.lead("blank").over(w), F.lit(True)))
    counted = F.expr("not blank and short and not stops and alone and key <> ''")
    t = t.withColumn("running", (F.sum(counted.cast("int")).over(W.Window.partitionBy("book_id", "key")) >= REPEATS) & (F.col("key") != ""))
    t = t.withColumn("heads", F.min(F.when(F.col("lists"), F.col("n"))).over(of_book()))
    t = t.withColumn("from", F.min(F.when((F.col("n") > F.col("heads")) & ~F.col("blank"), F.col("n"))).over(of_book()))
    t = t.withColumn("to", F.coalesce(F.min(F.when((F.col("n") >= F.col("from")) & (F.col("blank") | ~F.col("short") | F.col("stops")), F.col("n"))).over(of_book()), F.max("n").over(of_book()) + 1))
    entry = (F.col("n") >= F.col("from")) & (F.col("n") < F.col("to")) & (F.col("to") - F.col("from") >= ENTRIES)
    t = t.withColumn("entry", F.coalesce(entry, F.lit(False))).withColumn("looks", F.expr("case when short and shouted then 1 when short and alone and not stops then 2 end"))
    kind = """case when blank then null when entry or entry_like then 'toc_entry' when folio then 'page_number' when rule then 'separator' when division then 'heading'
      when running then 'running_head' when looks is not null then 'heading' else 'paragraph' end"""
    t = t.withColumn("kind", F.expr(kind))
    return t.withColumn("level", F.expr("case when kind <> 'heading' then 0 when division then 1 else looks end"))


def running_heads(rows: DataFrame) -> DataFrame:
    """(book_id, key, n): lines that repeat alone, at least REPEATS times, with their count."""
    t = rows.withColumn("t", F.expr(T.strip(SPARK, "line"))).withColumn("blank", F.col("t") == "")
    w = of_book("n")
    alone = F.coalesce(F.lag("blank").over(w), F.lit(True)) & F.coalesce(F.lead("blank").over(w), F.lit(True))
    t = t.withColumn("alone", alone).where("alone and not blank").where(column(P.is_short, "t") & ~column(P.ends_sentence, "t"))
    return t.withColumn("key", column(T.repetition_key, "t")).where("key <> ''").groupBy("book_id", "key").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATS)


def blocks(rows: DataFrame) -> DataFrame:
    """(book_id, block_no, kind, level, start, end, text): neighbouring paragraph lines are one block, other lines one each."""
    w = of_book("n")
    t = classified(rows)
    goes_on = (F.col("kind") == "paragraph") & F.coalesce(F.lag("kind").over(w) == "paragraph", F.lit(False))
    t = t.withColumn("new", (F.col("kind").isNotNull() & ~F.coalesce(goes_on, F.lit(False))).cast("int"))
    t = t.withColumn("block_no", F.sum("new").over(w) - 1).where("kind is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), " ")
    return t.groupBy("book_id", "block_no").agg(F.min("kind").alias("kind"), F.min("level").alias("level"), F.min("start").alias("start"), F.max("end").alias("end"), text.alias("text"))


def numbered_blocks(b: DataFrame) -> DataFrame:
    """Blocks with their section's number: a section begins at each heading, and with the first block."""
    head = (F.col("kind") == "heading").cast("int")
    return b.withColumn("_s", F.sum(head).over(of_book("block_no"))).withColumn("section_no", F.col("_s") - F.min("_s").over(of_book())).drop("_s")


def sections(b: DataFrame) -> DataFrame:
    """(book_id, section_no, title, level, start, end, has_prose, first_spoken, n_blocks), and what ``bounded`` needs of the blocks."""
    spoken = F.col("kind").isin(kinds(2))
    t = numbered_blocks(b)
    t = t.withColumn("_toc", F.max(F.when(F.col("kind") == "toc_entry", F.col("end"))).over(W.Window.partitionBy("book_id", "section_no")))
    return t.groupBy("book_id", "section_no").agg(
        F.coalesce(F.max(F.when(F.col("kind") == "heading", F.col("text"))), F.lit("")).alias("title"), F.max(F.when(F.col("kind") == "heading", F.col("level"))).alias("level"),
        F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.col("kind") == "paragraph").alias("has_prose"), F.min(F.when(spoken, F.col("start"))).alias("first_spoken"), F.count("*").alias("n_blocks"),
        F.max("_toc").alias("toc_end"), F.min(F.when(spoken & (F.col("start") >= F.col("_toc")), F.col("start"))).alias("spoken_after_toc"),
    )


def contents(s: DataFrame) -> DataFrame:
    """(book_id, entry_no, title, level, target): an entry for each section with a heading."""
    return s.where("level is not null").select("book_id", (F.row_number().over(of_book("section_no")) - 1).alias("entry_no"), "title", "level", F.col("start").alias("target"))


def coverage(books: DataFrame, b: DataFrame) -> DataFrame:
    """(book_id, covered, displayed, structured): which share of the text blocks cover and show, and whether that is enough."""
    size = F.col("end") - F.col("start")
    sums = b.groupBy("book_id").agg(F.sum(size).alias("c"), F.sum(F.when(F.col("kind").isin(kinds(1)), size).otherwise(0)).alias("d"))
    share = lambda x: F.when(F.col("n") > 0, F.coalesce(F.col(x), F.lit(0)) / F.col("n")).otherwise(0.0)
    out = books.select("book_id", F.length("text").alias("n")).join(sums, "book_id", "left").select("book_id", share("c").alias("covered"), share("d").alias("displayed"))
    return out.withColumn("structured", (F.col("covered") >= COVERED) & (F.col("displayed") >= DISPLAYED))


def guarded_blocks(books: DataFrame, b: DataFrame) -> DataFrame:
    """The blocks of books whose structure is believed; of the others one paragraph over everything."""
    told = coverage(books, b)
    whole = books.where("text <> ''").join(told.where("not structured"), "book_id").select("book_id", F.lit(0).cast("long").alias("block_no"), F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"), "text")
    return b.join(told.where("structured").select("book_id"), "book_id", "left_semi").select("book_id", F.col("block_no").cast("long").alias("block_no"), "kind", F.col("level").cast("int").alias("level"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text").unionByName(whole)


def bounded(s: DataFrame) -> DataFrame:
    """Sections with their book's contents_end, body_opening and reading_start: where the contents end, the body opens and reading begins.

    The body began with the first opening section that has prose; evidence of contents after it does not count. Past
    the contents, the first section with prose opens the body; without contents, the first with an opening's title.
    Reading begins with the first spoken block of the opening sections, else past the contents, else anywhere.
    """
    w = of_book()
    t = s.select("*", column(P.is_opening, "title").alias("opens"), column(P.is_contents_title, "title").alias("lists"))
    t = t.withColumn("began", F.min(F.when(F.col("opens") & F.col("has_prose"), F.col("start"))).over(w))
    front = F.col("began").isNull() | (F.col("start") < F.col("began"))
    evidence = F.when(front, F.greatest(F.col("toc_end"), F.when(F.col("lists"), F.col("end"))))
    t = t.withColumn("contents_end", F.coalesce(F.max(evidence).over(w), F.lit(0)))
    t = t.withColumn("past", F.expr("contents_end > 0 and start >= contents_end and not lists"))
    t = t.withColumn("prose_past", F.max(F.col("past") & F.col("has_prose")).over(w))
    t = t.withColumn("opening", F.expr("case when contents_end <= 0 then opens when prose_past then past and has_prose else past and opens end"))
    after = F.expr("case when start >= contents_end then first_spoken when toc_end = contents_end then spoken_after_toc end")
    t = t.select("*", *[F.min(c).over(w).alias(n) for n, c in (("first_open", F.when(F.col("opening"), F.col("start"))), ("first_read", F.when(F.col("opening"), F.col("first_spoken"))), ("past_read", after), ("any_read", F.col("first_spoken")))])
    return t.select(*s.columns, "contents_end", F.coalesce("first_open", "contents_end").alias("body_opening"), F.coalesce("first_read", "past_read", "any_read").alias("reading_start"))


def boundary(b: DataFrame) -> DataFrame:
    """(book_id, contents_end, body_opening, reading_start) of each book."""
    return bounded(sections(b)).groupBy("book_id").agg(*[F.first(c).alias(c) for c in ("contents_end", "body_opening", "reading_start")])


def render_blocks(b: DataFrame, bounds: DataFrame) -> DataFrame:
    """Shown blocks past the contents with their span in the rendered text, in which a line feed parts them."""
    shown = b.where(F.col("kind").isin(kinds(1)) & (F.col("text") != "")).join(bounds.select("book_id", "contents_end"), "book_id").where("start >= contents_end")
    w = of_book("start", "block_no")
    at = F.coalesce(F.sum(F.length("text") + 1).over(before(w)), F.lit(0))
    out = shown.withColumn("render_start", at).withColumn("render_end", F.col("render_start") + F.length("text"))
    return out.select("book_id", (F.row_number().over(w) - 1).alias("render_no"), "kind", "level", "start", "end", "render_start", "render_end", "text")


def render_text(r: DataFrame) -> DataFrame:
    """(book_id, text): the rendered text."""
    return r.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("render_no", "text"))), lambda x: x["text"]), "\n").alias("text"))


def translate(probes: DataFrame, r: DataFrame, source: str, at: str, to: str) -> DataFrame:
    """Probes with ``mapped``: their offset in the other space. A gap goes to the next block, and what lies before or after all to the ends."""
    following = F.lead(f"{to}start").over(of_book(f"{at}start"))
    rows = r.withColumn("following", following).select("book_id", F.col(f"{at}start").alias("s"), F.col(f"{at}end").alias("e"), F.col(f"{to}start").alias("ts"), F.col(f"{to}end").alias("te"), "following")
    hit = asof.backward(probes, source, rows, "s", "book_id", clamp=True)
    x, h = F.col(source), F.col("hit")
    mapped = F.when(h.isNull(), 0).when(x < h["s"], h["ts"]).when(x >= h["e"], F.coalesce(h["following"], h["te"])).otherwise(F.least(h["ts"] + x - h["s"], h["te"]))
    return hit.select(*probes.columns, mapped.cast("long").alias("mapped"))


def to_render(probes: DataFrame, r: DataFrame, source: str = "pos") -> DataFrame:
    return translate(probes, r, source, "", "render_")


def to_source(probes: DataFrame, r: DataFrame, source: str = "pos") -> DataFrame:
    return translate(probes, r, source, "render_", "")


def narration_runs(books: DataFrame, b: DataFrame, bounds: DataFrame) -> DataFrame:
    """(book_id, run_no, kind, start, end): spoken blocks of one kind with only white space between, from the reading start on."""
    t = b.drop("text").where(F.col("kind").isin(kinds(2))).join(bounds.select("book_id", "reading_start"), "book_id").where("end > coalesce(reading_start, 0)")
    w = of_book("start", "block_no")
    t = t.withColumn("start", F.greatest("start", F.coalesce("reading_start", F.lit(0)))).withColumn("before", F.lag(F.struct("end", "kind")).over(w))
    # the text is joined for the gaps alone: no window carries it
    gap = F.expr("substr(text, cast(before.end + 1 as int), cast(start - before.end as int))")
    t = t.join(books, "book_id").select("book_id", "block_no", "kind", "start", "end", "before", gap.alias("gap"))
    joins = (F.col("before.kind") == F.col("kind")) & column(P.is_blank, "gap")
    t = t.withColumn("run_no", F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(w) - 1)
    return t.groupBy("book_id", "run_no").agg(F.min("kind").alias("kind"), F.min("start").alias("start"), F.max("end").alias("end"))


def major(s: DataFrame) -> DataFrame:
    """Sections with ``is_major``: on one of the two highest levels of their book, or without a level."""
    rank = F.dense_rank().over(of_book(F.col("level").asc_nulls_last()))
    return s.withColumn("is_major", F.col("level").isNull() | (rank <= 2))


def chapters(s: DataFrame) -> DataFrame:
    """(book_id, chapter_no, title, level, char_offset): titled sections of the major levels from the reading start on."""
    t = bounded(s).withColumn("title", F.expr(T.strip(SPARK, "title")))
    t = t.where((F.col("title") != "") & (F.col("first_spoken") >= F.coalesce("reading_start", F.lit(0))))
    t = major(t).where("is_major")
    return t.select("book_id", (F.row_number().over(of_book("first_spoken")) - 1).alias("chapter_no"), "title", "level", F.col("first_spoken").alias("char_offset"))


def chapter_lines(rows: DataFrame) -> DataFrame:
    """(book_id, title, char_offset): lines that begin with ``chapter`` and a number, and are no contents entries."""
    t = rows.where(F.col("line").rlike(r"(?i)^[ \t]*chapter[ \t]+(?:[0-9]+|[ivxlcdm]+)($|[^\p{L}\p{N}_])")).withColumn("title", F.expr(T.strip(SPARK, "line")))
    return t.where(~column(P.has_leader, "title")).select("book_id", "title", F.col("start").alias("char_offset"))


def placed(probes: DataFrame, ch: DataFrame, books: DataFrame, parts: int = 1) -> DataFrame:
    """Probes (book_id, pos, ...) with current, previous and next chapter and the progress label."""
    w = of_book("chapter_no")
    sized = ch.join(books.select("book_id", F.length("text").alias("size")), "book_id")
    sized = sized.withColumn("previous", F.lag("title").over(w)).withColumn("next", F.lead("title").over(w)).withColumn("until", F.coalesce(F.lead("char_offset").over(w), F.col("size")))
    hit = asof.backward(probes, "pos", sized, "char_offset", "book_id", parts=parts)
    first = ch.where("chapter_no = 0").select("book_id", F.col("title").alias("first_title"))
    h = F.col("hit")
    span = h["until"] - h["char_offset"]
    percent = F.expr("greatest(1, least(99, cast(least(greatest(pos - hit.char_offset, 0), hit.until - hit.char_offset) * 100 div (hit.until - hit.char_offset) as int)))")
    label = F.when(h.isNull(), F.lit(None)).when(span <= 0, h["title"]).otherwise(F.concat(h["title"], F.lit(" - "), F.when(span > 0, percent).cast("string"), F.lit("%")))
    return hit.join(first, "book_id", "left").select(*probes.columns, h["title"].alias("current"), h["previous"].alias("previous"), F.when(h.isNull(), F.col("first_title")).otherwise(h["next"]).alias("next"), label.alias("label"))


def indexed(probes: DataFrame, spans: DataFrame, parts: int = 1) -> DataFrame:
    """Probes (book_id, pos, ...) with ``span_no``: of ordered spans the first that ends after the offset."""
    hit = asof.forward(probes, "pos", spans, "end", "book_id", parts=parts)
    return hit.select(*probes.columns, F.col("hit.span_no").alias("span_no"))


def every(books: DataFrame, step: int = 997) -> DataFrame:
    """(book_id, pos): an offset every ``step`` characters."""
    return books.select("book_id", F.explode(F.expr(f"sequence(0L, cast(length(text) as bigint), {step}L)")).alias("pos"))
