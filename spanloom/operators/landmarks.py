"""Landmarks of a book: heading candidates from several sources, resolved to one offset each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from spanloom.functions import headings as H
from spanloom.functions import predicates as P
from spanloom.functions import text as T
from spanloom.functions.dialect import BLANK, SPARK, WS, column, with_steps
from spanloom.operators import asof
from spanloom.operators.chunking import split_lines
from spanloom.operators.structure import lines, of_book
from spanloom.shared import checkpoint, small

#: Characters between candidates of one cluster; before the cut that still counts as after it; between a heading and its
#: longer form; between a chapter and the section that repeats it; from a book's mark to its prologue (fixed values).
CLUSTER, SOFT, MERGE, REPEAT, PROLOGUE = 400, 250, 120, 160, 40_000
#: Kinds that never lie before the body (fixed values).
STRICT = ("book", "part", "chapter", "appendix", "conclusion", "epilogue", "afterword", "introduction", "prologue", "preface")


def cleaned(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows with ``clean``, ``kind`` and ``priority`` of their label; ``kind`` is null where the label is no heading."""
    out = with_steps(rows, H.clean_steps(SPARK, label, "cleaned"))
    # a generator between the steps: a filter on what follows is not pushed below it, where it would repeat every step
    out = out.select(*rows.columns, F.inline(F.array(F.struct(F.col("cleaned").alias("clean"), column(T.fold, "cleaned").alias("folded")))))
    out = out.withColumn("kind", F.expr(H.kind(SPARK, "clean", "folded"))).drop("folded")
    return out.withColumn("priority", F.expr(H.priority("kind")))


def source_rank(source: Column) -> Column:
    low = F.lower(source)
    return F.when(low.isin("nav", "chapter_parser", "chapter", "parser"), 30).when(low == "text_scan", 10).otherwise(20)


def deduplicated(candidates: DataFrame) -> DataFrame:
    """One candidate of each cluster: those of a label that lie at most CLUSTER characters after the one before.

    Candidates without an offset are clusters of their own. The one with an offset, of the best source, with a chunk
    and the least offset stays.
    """
    t = candidates.withColumn("key", column(T.label_key, "label")).where("key <> ''").withColumn("rank", source_rank(F.col("source"))).withColumn("tie", F.xxhash64("label", "source", "chunk_index"))
    w = W.Window.partitionBy("book_id", "key").orderBy(F.col("char_offset").asc_nulls_last(), "rank", "tie")
    far = F.col("char_offset").isNull() | F.coalesce(F.col("char_offset") - F.lag("char_offset").over(w) > CLUSTER, F.lit(True))
    t = t.withColumn("cluster", F.sum(far.cast("int")).over(w))
    best = W.Window.partitionBy("book_id", "key", "cluster").orderBy(F.col("rank").desc(), F.col("chunk_index").isNotNull().desc(), "char_offset", "tie")
    return t.withColumn("best", F.row_number().over(best)).where("best = 1").select(*candidates.columns)


def first_word(label: str) -> Column:
    """The first run of letters and digits of a folded label. Cleaning a label leaves it as it is."""
    return F.regexp_extract(F.expr(T.fold(SPARK, label)), r"[\p{L}\p{N}]+", 0)


def occurrences(books: DataFrame, wanted: DataFrame | None = None, classes: tuple[str, ...] = ("exact", "wrapped", "prefix")) -> DataFrame:
    """Lines that may be a heading in the text: (book_id, char_offset, kind_of_match, key, label, prev_blank, next_blank, probable_toc).

    A line counts by itself (``exact``), with the next line that is not blank (``wrapped``), and, when it is a chapter's
    or a part's mark, by its mark (``prefix``). ``probable_toc``: a leader is on it; or within the next four lines that
    are not blank one is only a leader, or any has one while the line before is an outline number. With ``wanted``
    (book_id, key, prefix_key) only lines count that begin with the first word of one of these keys; the others are left
    out before any label is cleaned. Only the ``classes`` asked for are made.
    """
    w = of_book("n")
    rows = split_lines(books)
    rows = rows.withColumn("prev_blank", F.coalesce(F.lag("t").over(w) == "", F.lit(True))).withColumn("next_blank", F.coalesce(F.lead("t").over(w) == "", F.lit(True)))
    t = rows.where("t <> ''").withColumn("leader", column(P.has_leader, "t"))
    dotted = F.expr(T.dotted(SPARK, "t"))
    t = t.withColumn("only", F.col("leader") & dotted.rlike(rf"^[.{BLANK}]+$")).withColumn("number", F.col("t").rlike(r"^\d+(?:\.\d+){0,99}$"))
    next_four = w.rowsBetween(1, 4)
    near_only, near_any = (F.coalesce(F.max(c).over(next_four), F.lit(False)) for c in ("only", "leader"))
    t = t.withColumn("probable_toc", F.col("leader") | near_only | (F.coalesce(F.lag("number").over(w), F.lit(False)) & near_any))
    t = t.withColumn("following", F.lead("t").over(w))
    joined = F.when(F.col("t").endswith("-"), F.concat(F.regexp_replace("t", "-$", ""), F.col("following"))).otherwise(F.concat(F.col("t"), F.lit(" "), F.col("following")))
    as_ = lambda label, match: F.struct(label.alias("label"), F.lit(match).alias("match"))
    wrapped = [F.when(F.col("following").isNotNull(), as_(joined, "wrapped"))] if "wrapped" in classes else []
    forms = F.array_compact(F.array(as_(F.col("t"), "exact"), *wrapped))
    kept = ["book_id", "char_offset", "prev_blank", "next_blank", "probable_toc"]
    both = t.select(*kept, F.inline(forms))
    if wanted is not None:
        heads = wanted.select("book_id", F.explode(F.array("key", "prefix_key")).alias("k")).where("k is not null").select("book_id", first_word("k").alias("head")).distinct()
        heads = checkpoint(heads)
        both = both.withColumn("head", first_word("label")).join(F.broadcast(heads) if small(heads) else heads, ["book_id", "head"], "left_semi").drop("head")
    c = cleaned(both)
    c = c.withColumn("key", F.expr(T.label_key(SPARK, "clean")))
    if "prefix" in classes:
        c = c.withColumn("match", F.explode(F.expr("case when match = 'exact' and kind in ('chapter', 'part') then array('exact', 'prefix') else array(match) end")))
    return c.select("book_id", "char_offset", "match", "key", F.col("clean").alias("label"), "prev_blank", "next_blank", "probable_toc")


def matched(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Wanted labels (book_id, key, prefix_key, ...) with the occurrences of their best class: exact, else wrapped, else prefix."""
    o = found.where("not probable_toc").select("book_id", F.col("char_offset").alias("at"), "match", F.col("key").alias("okey"), "prev_blank", "next_blank")
    direct = wanted.join(o.where("match <> 'prefix'").withColumnRenamed("okey", "key"), ["book_id", "key"])
    mark = wanted.where("prefix_key is not null").join(o.where("match = 'prefix'").withColumnRenamed("okey", "prefix_key"), ["book_id", "prefix_key"])
    all_ = direct.unionByName(mark.select(*direct.columns))
    rank = F.expr("case match when 'exact' then 0 when 'wrapped' then 1 else 2 end")
    return all_.withColumn("r", rank).withColumn("best", F.min("r").over(W.Window.partitionBy("book_id", "key"))).where("r = best").drop("r", "best")


def matched_own(found: DataFrame) -> DataFrame:
    """Occurrences of the best class of their label, where labels are taken from the occurrences (book_id, match, key, ...) themselves.

    Each label then has the line that it was taken from, exact or wrapped, so that none is matched by its mark alone:
    a label's occurrences are one group, which meets no other, and a book stays where its lines are.
    """
    rank = F.expr("case match when 'exact' then 0 else 1 end")
    t = found.where("not probable_toc and match <> 'prefix'").withColumn("r", rank)
    return t.withColumn("best", F.min("r").over(W.Window.partitionBy("book_id", "key"))).where("r = best").drop("r", "best")


def best_occurrences(rows: DataFrame) -> DataFrame:
    """Of each label's occurrences (book_id, key, at, prev_blank, next_blank, cut) the best: from SOFT before the cut on the first, else the last best set off by blank lines."""
    soft = F.greatest(F.lit(0), F.col("cut") - SOFT)
    tier = F.when((F.col("at") < F.col("cut")) & (F.col("at") >= soft), 0).when(F.col("at") >= F.col("cut"), 1).otherwise(2)
    score = F.col("prev_blank").cast("int") + F.col("next_blank").cast("int")
    t = rows.withColumn("tier", tier).withColumn("score", F.when(F.col("tier") == 2, -score).otherwise(0)).withColumn("order", F.when(F.col("tier") == 2, -F.col("at")).otherwise(F.col("at")))
    w = W.Window.partitionBy("book_id", "key").orderBy("tier", "score", "order")
    return t.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "tier", "score", "order")


def without_between(marks: DataFrame) -> DataFrame:
    """Landmarks without the sections directly between two chapters, where a book has two chapters or more."""
    w = of_book("char_offset", "label")
    many = F.count_if(F.col("kind") == "chapter").over(of_book()) >= 2
    between = (F.col("kind") == "section") & F.coalesce(F.lag("kind").over(w) == "chapter", F.lit(False)) & F.coalesce(F.lead("kind").over(w) == "chapter", F.lit(False))
    return marks.withColumn("_many", many).withColumn("_between", between).where("not (_many and _between)").drop("_many", "_between")


def prologue_lines(books: DataFrame) -> DataFrame:
    """(book_id, at) of lines that are only ``Prologue``; blank lines before one belong to it."""
    w = of_book("n")
    t = lines(books.where("instr(text, 'Prologue') > 0")).select("book_id", "n", "start", F.expr(T.strip(SPARK, "line")).alias("t"))
    full = F.max(F.when(F.col("t") != "", F.col("n"))).over(w.rowsBetween(W.Window.unboundedPreceding, -1))
    t = t.withColumn("full", F.coalesce(full, F.lit(-1)))
    first = F.min("start").over(W.Window.partitionBy("book_id", "full"))
    return t.withColumn("at", first).where("t = 'Prologue'").select("book_id", F.col("at").cast("long").alias("at"))


def with_prologues(marks: DataFrame, books: DataFrame) -> DataFrame:
    """Landmarks, and after each mark of a book that has no prologue the first prologue line up to the next such mark, if it is near."""
    w = of_book("char_offset")
    b = marks.where("kind = 'book'").select("book_id", F.col("char_offset").alias("lo"), F.lead("char_offset").over(w).alias("hi"))
    b = b.join(books.select("book_id", (F.length("text") + 1).alias("size")), "book_id").select("book_id", "lo", F.coalesce("hi", "size").alias("hi"))
    # the next prologue of either sort decides: no mark meets more than one row of each
    has = marks.where("kind = 'prologue'").select("book_id", F.col("char_offset").alias("at"))
    lacks = asof.forward(b, "lo", has, "at", "book_id").where("hit is null or hit.at >= hi").drop("hit")
    first = asof.forward(lacks, "lo", prologue_lines(books), "at", "book_id").where(f"hit.at < hi and hit.at - lo <= {PROLOGUE}")
    return marks.unionByName(first.select("book_id", F.col("hit.at").alias("char_offset"), F.lit("Prologue").alias("label"), F.lit("prologue").alias("kind")))


def without_title(marks: DataFrame, titles: DataFrame) -> DataFrame:
    """Landmarks whose label is not their book's title (book_id, title)."""
    t = marks.withColumn("mk", F.expr(T.marker_key(SPARK, "label"))).join(titles.withColumn("tk", F.expr(T.marker_key(SPARK, "title"))).select("book_id", "tk").where("tk <> ''").withColumnRenamed("tk", "mk"), ["book_id", "mk"], "left_anti")
    return t.select(*marks.columns)


def longest(labels: DataFrame) -> DataFrame:
    """(book_id, key, label): of the labels of each key (book_id, key, label) the longest."""
    return labels.groupBy("book_id", "key").agg(F.max_by("label", F.struct(F.length("label"), "label")).alias("label"))


def merged(marks: DataFrame) -> DataFrame:
    """Landmarks in which one with a longer form of its label near after it has that form, and takes it.

    Of a run of such pairs the first, third and so on take the one after them. Then one of a kind and offset stays, the
    longest, first in order.
    """
    w = of_book("char_offset", "kind", "label")
    after = F.lead(F.struct("kind", "char_offset", "label")).over(w)
    t = marks.withColumn("after", after)
    pair = F.expr(f"after.kind = kind and after.char_offset - char_offset <= {MERGE} and length(after.label) > length(label) and startswith(after.label, label)")
    t = t.withColumn("pair", F.coalesce(pair, F.lit(False)))
    t = t.withColumn("run", F.sum((~F.coalesce(F.lag("pair").over(w), F.lit(False))).cast("int")).over(w))
    at = F.row_number().over(W.Window.partitionBy("book_id", "run").orderBy("char_offset", "kind", "label"))
    t = t.withColumn("at", at).where("at % 2 = 1").withColumn("label", F.when(F.col("pair"), F.col("after.label")).otherwise(F.col("label")))
    best = W.Window.partitionBy("book_id", "kind", "char_offset").orderBy(F.length("label").desc(), "run", "at")
    return t.withColumn("best", F.row_number().over(best)).where("best = 1").select(*marks.columns)


def without_repeats(marks: DataFrame) -> DataFrame:
    """Landmarks without the sections that only repeat, near after a chapter or part, what its label adds to its number.

    Sections after a chapter are compared with it up to the first that stays; from there on all stay.
    """
    w = of_book("char_offset", "kind")
    t = marks.withColumn("run", F.sum((F.col("kind") != "section").cast("int")).over(w))
    in_run = W.Window.partitionBy("book_id", "run").orderBy("char_offset", "kind")
    t = t.withColumn("head", F.first(F.struct("kind", "label", "char_offset")).over(in_run))
    rest = F.regexp_replace("head.label", rf"(?i)^(?:chapter|part){WS}+[0-9ivxlcdm]+{WS}*[:\x{{2013}}\x{{2014}}-]?{WS}*", "")
    t = t.withColumn("rest", rest)
    repeats = F.expr(f"kind = 'section' and head.kind in ('chapter', 'part') and char_offset - head.char_offset <= {REPEAT} and rest <> head.label and {T.strip(SPARK, 'rest')} <> '' and {T.label_key(SPARK, 'rest')} = {T.label_key(SPARK, 'label')}")
    so_far = F.min(F.when(F.col("kind") == "section", repeats)).over(in_run.rowsBetween(W.Window.unboundedPreceding, 0))
    return t.withColumn("gone", (F.col("kind") == "section") & F.coalesce(so_far, F.lit(False))).where("not gone").select(*marks.columns)


def resolved(books: DataFrame, candidates: DataFrame, bounds: DataFrame) -> DataFrame:
    """(book_id, char_offset, label, kind): the landmarks of each book.

    Candidates (book_id, label, char_offset, chunk_index, source) are cleaned, told by kind and deduplicated. A label goes
    to its best occurrence in the text past the contents, or to an earlier offset that a source gives there; chapters and
    parts that the text does not have go. Then what lies before the body goes, near forms of a label are merged, and
    sections that repeat or part chapters go; each book's mark gets its prologue.
    """
    c = cleaned(candidates).where("kind is not null").withColumn("label", F.col("clean")).select(*candidates.columns)
    c = checkpoint(deduplicated(c).withColumn("key", F.expr(T.label_key(SPARK, "label"))))
    bounds = checkpoint(bounds)
    known = cleaned(longest(c)).where("kind is not null").select("book_id", "key", "label", "kind")
    mark = F.regexp_extract("label", r"(?i)^((?:chapter|part|book)\s+[0-9ivxlcdm]+)(?:$|[^\p{L}\p{N}_])", 1)
    known = checkpoint(known.withColumn("prefix_key", F.when((mark != "") & F.col("label").rlike("[:-]"), F.lower(mark))))
    b = bounds.select("book_id", F.col("contents_end").alias("toc_end"), F.coalesce("reading_start", F.lit(0)).alias("cut"))
    hits = matched(known.join(b, "book_id").select("book_id", "key", "prefix_key", "cut"), occurrences(books, known))
    hits = checkpoint(hits).join(b.select("book_id", "toc_end"), "book_id").where("at >= toc_end").select("book_id", "key", "cut", "at", "prev_blank", "next_blank")
    text = best_occurrences(hits).select("book_id", "key", F.col("at").alias("text_at"))
    meta = c.where("char_offset is not null").join(known.select("book_id", "key", "kind"), ["book_id", "key"]).join(b, "book_id")
    meta = meta.where("char_offset >= toc_end and not (kind in ('chapter', 'part') and char_offset < cut)")
    meta = meta.groupBy("book_id", "key").agg(F.min(F.when(F.col("char_offset") >= F.col("cut"), F.col("char_offset"))).alias("meta_post"), F.min("char_offset").alias("meta_any"))
    t = known.join(text, ["book_id", "key"], "left").join(meta, ["book_id", "key"], "left").join(b, "book_id")
    t = t.where("not (kind in ('chapter', 'part') and text_at is null)")
    post = F.when(F.col("text_at") >= F.col("cut"), F.col("text_at"))
    t = t.withColumn("char_offset", F.coalesce(F.least(post, F.col("meta_post")), "text_at", "meta_any")).where("char_offset is not null")
    t = t.where(~(F.col("kind").isin(list(STRICT)) & (F.col("char_offset") < F.col("cut"))))
    once = without_repeats(merged(t.select("book_id", "char_offset", "label", "kind")))
    return with_prologues(without_between(once), books)
