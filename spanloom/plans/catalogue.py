"""Every query by name: (run, columns, oracle). Columns are ``name:type``; both sides are cast to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from spanloom.functions import audio as A
from spanloom.functions import headings as H
from spanloom.functions import predicates as P
from spanloom.functions import text as T
from spanloom.functions.dialect import DUCK as D
from spanloom.functions.dialect import SPARK as S
from spanloom.functions.dialect import nested, with_steps
from spanloom.operators import asof, chunking, concepts, landmarks, layout, positions, speech, structure
from spanloom.plans import oracle as O
from spanloom.sources import books as B
from spanloom.sources import markup as M
from spanloom.shared import checkpoint
from spanloom.sources import stores

Run = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, tuple[Run, str, str | None]] = {}
DUCK_TYPES = {"long": "bigint", "string": "varchar", "double": "double", "boolean": "boolean"}


def query(name: str, columns: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        CATALOGUE[name] = (run, columns, sql)
        return run

    return add


def typed(df: DataFrame, columns: str) -> DataFrame:
    parts = [c.split(":") for c in columns.split()]
    return df.select(*[(F.round(F.col(n).cast("double"), 6) if t == "double" else F.col(n).cast(t)).alias(n) for n, t in parts])


def queries() -> dict[str, Run]:
    def bound(run: Run, columns: str) -> Run:
        return lambda spark, sf_dir: typed(run(spark, sf_dir), columns)

    return {name: bound(run, columns) for name, (run, columns, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (_, columns, sql) in CATALOGUE.items():
        if sql:
            parts = [c.split(":") for c in columns.split()]
            cols = ", ".join(f'round(cast("{n}" as double), 6) as "{n}"' if t == "double" else f'cast("{n}" as {DUCK_TYPES[t]}) as "{n}"' for n, t in parts)
            out[name] = f"select {cols} from ({sql})"
    return out


# ---- what the queries read -------------------------------------------------------------------------------------


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "documents")


def books(spark: SparkSession, sf: str) -> DataFrame:
    return B.books(documents(spark, sf))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return structure.lines(books(spark, sf))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return structure.blocks(lines(spark, sf))


def sections(spark: SparkSession, sf: str) -> DataFrame:
    return structure.sections(blocks(spark, sf))


def bounds(spark: SparkSession, sf: str) -> DataFrame:
    return structure.boundary(blocks(spark, sf))


def chapters(spark: SparkSession, sf: str) -> DataFrame:
    return structure.chapters(sections(spark, sf))


def outline(b: DataFrame) -> DataFrame:
    """Blocks with the text of headings alone, written once for all that is told from them."""
    return checkpoint(b.withColumn("text", F.when(F.col("kind") == "heading", F.col("text"))))


def render(spark: SparkSession, sf: str) -> DataFrame:
    b = checkpoint(blocks(spark, sf))
    return structure.render_blocks(b, structure.boundary(b))


def layout_lines(spark: SparkSession, sf: str) -> DataFrame:
    return B.layout_lines(lines(spark, sf))


def playhead(spark: SparkSession, sf: str) -> DataFrame:
    return positions.playhead(B.table(spark, sf, "events"), books(spark, sf).count())


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunks_of(books(spark, sf), outline(blocks(spark, sf)))


def chunks_of(b: DataFrame, own: DataFrame) -> DataFrame:
    """The chunks of books, given their blocks."""
    return chunking.narration_chunks(b, own, structure.boundary(own))


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spoken blocks in order, as given spans."""
    b = blocks(spark, sf).where(F.col("kind").isin(structure.kinds(2)))
    return b.select("book_id", (F.row_number().over(structure.of_book("block_no")) - 1).alias("span_no"), "start", "end")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Heading lines as three sources give them: exactly, some shifted or without an offset, some farther on."""
    h = structure.classified(lines(spark, sf)).where("kind = 'heading'").select("book_id", "n", F.col("t").alias("label"), F.col("start").alias("at"))
    nav = h.select("book_id", "label", F.col("at").alias("char_offset"), F.col("n").cast("int").alias("chunk_index"), F.lit("nav").alias("source"))
    scan = h.select("book_id", "label", F.when(F.col("n") % 5 != 0, F.col("at") + F.col("n") * 37 % 600).alias("char_offset"), F.lit(None).cast("int").alias("chunk_index"), F.lit("text_scan").alias("source"))
    other = h.where("n % 3 = 0").select("book_id", "label", (F.col("at") + 900).alias("char_offset"), F.lit(None).cast("int").alias("chunk_index"), F.lit("other").alias("source"))
    return nav.unionByName(scan).unionByName(other)


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels made from the words of documents, four after four to the texts' ends, in the forms that books give them."""
    w = documents(spark, sf).select("doc_id", F.expr(T.words(S, "coalesce(text, '')")).alias("words"))
    w = w.select("doc_id", F.posexplode(F.expr("transform(sequence(0, greatest(size(words) - 1, 0) div 4), i -> array_join(slice(words, 4 * i + 1, 4), ' '))")).alias("i", "w"))
    form = F.expr("""case i % 10 when 0 then concat('chapter ', doc_id % 40, ' . . . . . ', doc_id % 300) when 1 then concat('Chapter ', doc_id % 9, ' - ', w) when 2 then concat('PART iv: ', w, ' ..... ', doc_id % 300)
      when 3 then w when 4 then concat(w, ' . . . . . xii') when 5 then upper(replace(w, 'ß', 'ss')) when 6 then concat('Axiom ', doc_id % 7, ' ', w) when 7 then concat('  prologue  ', case when doc_id % 2 = 0 then '' else ' 12' end)
      when 8 then concat('Appendix A ', w) else case i div 10 % 8 when 0 then concat('Book ', doc_id % 5, ': ', w) when 1 then ' Introduction  · · · · ix' when 2 then 'PREFACE' when 3 then 'epilogue' when 4 then 'Closing Reflections' when 5 then 'Afterword' when 6 then concat('appendix: ', w) else 'Table of Contents' end end""")
    return w.select((F.col("doc_id") * 100_000 + F.col("i")).alias("label_id"), form.alias("label"))


# ---- text ------------------------------------------------------------------------------------------------------

MESSY = "concat('  ', replace(text, ' ', '  '), {n}, {n}, {n}, {n}, 'per-', {n}, 'formance ', {n}, {t}, 'x y  ', {n}, '   - item  ', {n})"


def messy(d) -> str:
    return MESSY.format(n="chr(10)", t="chr(9)")


for _name, _f in (("normalize_text", T.normalize_text), ("normalize_markdown", T.normalize_markdown), ("dehyphenate", T.dehyphenate), ("normalize_chunk", T.normalize_chunk)):
    query(_name, "doc_id:long out:string", f"select doc_id, {_f(D, 'm')} as out from (select doc_id, {messy(D)} as m from documents)")(
        lambda spark, sf, f=_f: documents(spark, sf).select("doc_id", F.expr(messy(S)).alias("m")).select("doc_id", F.expr(f(S, "m")).alias("out"))
    )


@query("line_offsets", "book_id:long n:long start:long end:long line:string", O.q(O.BOOKS, O.LINES, select="select * from lines"))
def line_offsets(spark, sf):
    return lines(spark, sf)


@query("line_offsets_segmented", *CATALOGUE["line_offsets"][1:])
def line_offsets_segmented(spark, sf):
    """The same offsets by sums in two levels, as for a text of very many lines."""
    return structure.lines(books(spark, sf), segment=16)


_TESTS = {"folio": P.is_folio, "contents_entry": P.is_contents_entry, "leader": P.has_leader, "rule": P.is_rule, "artefact": P.is_artefact, "paragraph_like": P.is_paragraph_line, "reasonable": P.is_reasonable_heading, "opening": P.is_opening, "abbreviated": P.ends_abbreviated}


@query("line_predicates", "book_id:long n:long " + " ".join(f"{k}:boolean" for k in _TESTS), O.q(O.BOOKS, O.LINES, select="select book_id, n, " + ", ".join(f"{f(D, 'line')} as {k}" for k, f in _TESTS.items()) + " from lines"))
def line_predicates(spark, sf):
    return lines(spark, sf).select("book_id", "n", *[F.expr(f(S, "line")).alias(k) for k, f in _TESTS.items()])


@query("sanitize_text", "doc_id:long out:string", f"select doc_id, {T.sanitize(D, 'm')} as out from (select doc_id, concat('1.2 ', text, chr(10), '12', chr(10), '-----', chr(10), 'The U.K. and NATO MPs met… at 9 . then') as m from documents)")
def sanitize_text(spark, sf):
    m = F.expr("concat('1.2 ', text, chr(10), '12', chr(10), '-----', chr(10), 'The U.K. and NATO MPs met… at 9 . then')")
    return documents(spark, sf).select("doc_id", m.alias("m")).select("doc_id", F.expr(T.sanitize(S, "m")).alias("out"))


@query("expand_initialisms", "conv_id:long turn:long out:string", f"select conv_id, turn, {T.initialisms(D, 'm')} as out from (select conv_id, turn, concat(text, ' U.S.A. GDP CEOs aBC ABCDEFGH') as m from conversations)")
def expand_initialisms(spark, sf):
    t = B.table(spark, sf, "conversations").select("conv_id", "turn", F.expr("concat(text, ' U.S.A. GDP CEOs aBC ABCDEFGH')").alias("m"))
    return t.select("conv_id", "turn", F.expr(T.initialisms(S, "m")).alias("out"))


_BRITISH = "concat(text, ' Organisational behaviour, the Centre—organised and realise; advise rise metres glamour')"


@query("spelling_normalize", "conv_id:long turn:long out:string", f"select conv_id, turn, {T.american(D, 'm')} as out from (select conv_id, turn, {_BRITISH} as m from conversations)")
def spelling_normalize(spark, sf):
    return B.table(spark, sf, "conversations").select("conv_id", "turn", F.expr(_BRITISH).alias("m")).select("conv_id", "turn", F.expr(T.american(S, "m")).alias("out"))


@query("match_keys", "doc_id:long match_key:string marker_key:string stem:string", f"select doc_id, {T.match_key(D, 'text')} as match_key, {T.marker_key(D, 'text')} as marker_key, {T.safe_stem(D, 'text')} as stem from documents")
def match_keys(spark, sf):
    return documents(spark, sf).select("doc_id", F.expr(T.match_key(S, "text")).alias("match_key"), F.expr(T.marker_key(S, "text")).alias("marker_key"), F.expr(T.safe_stem(S, "text")).alias("stem"))


@query("strip_inline", "conv_id:long n:long out:string", O.q(O.MD_BOOKS, O.lines_of("md_lines", "md_books", "conv_id"), select=f"select conv_id, n, out from {nested('md_lines', T.inline_steps(D, 'line', 'out'))}"))
def strip_inline(spark, sf):
    return with_steps(md_lines(spark, sf), T.inline_steps(S, "line", "out"))


def md_books(spark, sf):
    return B.markdown_books(B.table(spark, sf, "conversations"))


def md_lines(spark, sf):
    return structure.lines(md_books(spark, sf).withColumnRenamed("conv_id", "book_id")).withColumnRenamed("book_id", "conv_id")


@query("markdown_line_kinds", "conv_id:long n:long kind:string level:long", O.q(O.MD_BOOKS, O.lines_of("md_lines", "md_books", "conv_id"), select=f"select conv_id, n, {P.markdown_kind(D, 'line')} as kind, {P.markdown_level(D, 'line')} as level from md_lines"))
def markdown_line_kinds(spark, sf):
    return md_lines(spark, sf).select("conv_id", "n", F.expr(P.markdown_kind(S, "line")).alias("kind"), F.expr(P.markdown_level(S, "line")).alias("level"))


# ---- structure -------------------------------------------------------------------------------------------------


@query("running_heads_text", "book_id:long key:string n:long", O.q(O.BOOKS, O.LINES, O.CLASSIFIED, select="select book_id, key, count(*) as n from l2 where not blank and short and not stops and alone and key <> '' group by book_id, key having count(*) >= 3"))
def running_heads_text(spark, sf):
    return structure.running_heads(lines(spark, sf))


@query("contents_entries", "book_id:long n:long line:string", O.q(O.BOOKS, O.LINES, O.CLASSIFIED, select="select book_id, n, line from l6 where entry"))
def contents_entries(spark, sf):
    return structure.classified(lines(spark, sf)).where("entry").select("book_id", "n", "line")


@query("plain_blocks", "book_id:long block_no:long kind:string level:long start:long end:long text:string", O.q(O.BOOKS, O.LINES, O.CLASSIFIED, O.BLOCKS, select="select * from blocks"))
def plain_blocks(spark, sf):
    return blocks(spark, sf)


@query("sections", "book_id:long section_no:long title:string level:long start:long end:long has_prose:boolean first_spoken:long n_blocks:long", O.q(*O.STRUCTURE, select="select * from sections"))
def sections_query(spark, sf):
    return sections(spark, sf)


@query("toc", "book_id:long entry_no:long title:string level:long target:long", O.q(*O.STRUCTURE, select="select book_id, row_number() over (partition by book_id order by section_no) - 1 as entry_no, title, level, start as target from sections where level is not null"))
def toc(spark, sf):
    return structure.contents(sections(spark, sf))


_COVERAGE = f"""coverage as (select *, covered >= 0.9 and displayed >= 0.05 as structured from (select book_id, coalesce(c, 0) / length(text) as covered, coalesce(d, 0) / length(text) as displayed from books left join (select book_id, sum("end" - start) as c, sum(case when kind in {O.SHOWN} then "end" - start else 0 end) as d from blocks group by book_id) using (book_id)))"""




#: Of every fifth book only some blocks, which cover too little to be believed.
_SPARSE = "blocks as (select * from every where book_id % 5 <> 0 or block_no % 3 = 0)"


def sparse(spark, sf):
    return blocks(spark, sf).where("book_id % 5 <> 0 or block_no % 3 = 0")


@query("structure_guardrail", "book_id:long block_no:long kind:string level:long start:long end:long text:string", O.q(O.BOOKS, O.LINES, O.CLASSIFIED, O.BLOCKS.replace("blocks as", "every as", 1), _SPARSE, _COVERAGE, select="""select blocks.* from blocks join coverage using (book_id) where structured union all select book_id, 0, 'paragraph', 0, 0, length(text), text from books join coverage using (book_id) where not structured"""))
def structure_guardrail(spark, sf):
    return structure.guarded_blocks(books(spark, sf), sparse(spark, sf))


@query("covered_ratio", "book_id:long covered:double displayed:double structured:boolean", O.q(O.BOOKS, O.LINES, O.CLASSIFIED, O.BLOCKS.replace("blocks as", "every as", 1), _SPARSE, _COVERAGE, select="select * from coverage"))
def covered_ratio(spark, sf):
    return structure.coverage(books(spark, sf), sparse(spark, sf))


for _name, _column in (("contents_end", "contents_end"), ("body_opening", "body_opening"), ("reading_start", "reading_start")):
    query(_name, f"book_id:long {_column}:long", O.q(*O.WHOLE, select=f"select book_id, {_column} from bounds"))(lambda spark, sf, c=_column: bounds(spark, sf).select("book_id", c))


@query("render_plan", "book_id:long render_no:long kind:string level:long start:long end:long render_start:long render_end:long text:string", O.q(*O.WHOLE, O.RENDER, select="select * from render"))
def render_plan(spark, sf):
    return render(spark, sf)


@query("render_text", "book_id:long text:string", O.q(*O.WHOLE, O.RENDER, select="select book_id, string_agg(text, chr(10) order by render_no) as text from render group by book_id"))
def render_text(spark, sf):
    return structure.render_text(render(spark, sf))


def edges(r: DataFrame, at: str, whole: DataFrame) -> DataFrame:
    """Offsets at, before and after both ends of every block, and every so many characters."""
    near = r.select("book_id", F.explode(F.array(*[F.col(c) + k for c in (f"{at}start", f"{at}end") for k in (-1, 0, 1)])).alias("pos")).where("pos >= 0")
    return near.unionByName(structure.every(whole)).distinct()


def _at_edges(at: str, to: str) -> str:
    every = "select book_id, unnest(range(0, length(text) + 1, 997)) as pos from books"
    end = f'{at}"end"' if not at else f"{at}end"
    near = " union all ".join(f"select book_id, {c} + {k} as pos from render" for c in (f"{at}start", end) for k in (-1, 0, 1))
    return O.translated(at, to).replace(f"probes as ({every})", f"probes as (select distinct book_id, pos from ({every} union all {near}) where pos >= 0)")


@query("source_to_render", "book_id:long pos:long mapped:long", O.q(*O.WHOLE, O.RENDER, select="").rstrip() + ",\n" + _at_edges("", "render_"))
def source_to_render(spark, sf):
    r = render(spark, sf)
    return structure.to_render(edges(r, "", books(spark, sf)), r)


@query("render_to_source", "book_id:long pos:long mapped:long", O.q(*O.WHOLE, O.RENDER, select="").rstrip() + ",\n" + _at_edges("render_", ""))
def render_to_source(spark, sf):
    r = render(spark, sf)
    return structure.to_source(edges(r, "render_", books(spark, sf)), r)


_RUNS = f"""r1 as (select book_id, block_no, kind, greatest(start, coalesce(reading_start, 0)) as start, "end" from blocks join bounds using (book_id) where kind in {O.SPOKEN} and "end" > coalesce(reading_start, 0)),
r2 as (select r1.*, lag(kind) over w as before_kind, substr(text, (lag("end") over w + 1)::bigint, (start - lag("end") over w)::bigint) as gap from r1 join books using (book_id) window w as (partition by book_id order by start, block_no)),
r3 as (select *, sum((not coalesce(before_kind = kind and {P.is_blank(D, 'gap')}, false))::int) over (partition by book_id order by start, block_no) - 1 as run_no from r2)"""


@query("narration_runs", "book_id:long run_no:long kind:string start:long end:long", O.q(*O.WHOLE, _RUNS, select='select book_id, run_no, min(kind) as kind, min(start) as start, max("end") as "end" from r3 group by book_id, run_no'))
def narration_runs(spark, sf):
    b = outline(blocks(spark, sf))
    return structure.narration_runs(books(spark, sf), b, structure.boundary(b))


@query("chunk_span_invariant", "violations:long", "select 0 as violations")
def chunk_span_invariant(spark, sf):
    """Chunks whose span does not hold their text, white space aside."""
    t = chunks(spark, sf).join(books(spark, sf).withColumnRenamed("text", "whole"), "book_id")
    same = F.expr(f"{T.match_key(S, 'substr(whole, cast(start + 1 as int), cast(`end` - start as int))')} = {T.match_key(S, 'text')}")
    return t.agg(F.coalesce(F.count_if(~same), F.lit(0)).alias("violations"))


@query("essay_index_filter", "book_id:long span_no:long", O.q(*O.STRUCTURE, f"spans as (select book_id, row_number() over (partition by book_id order by block_no) - 1 as span_no, start, \"end\" from blocks where kind in {O.SPOKEN})",
       """cut as (select book_id, (length(text) // 4)::bigint as lo, case when book_id % 7 = 0 then length(text) else (length(text) // 2)::bigint end as hi from books where book_id % 3 <> 1),
t as (select spans.*, not coalesce(start >= (case when book_id % 7 = 0 then 0 else lo end) and "end" <= hi, false) as outside from spans left join cut using (book_id))""", select="select book_id, span_no from (select *, bool_or(outside) over (partition by book_id) as any_left from t) where outside or not any_left"))
def essay_index_filter(spark, sf):
    n = F.length("text")
    cut = books(spark, sf).where("book_id % 3 <> 1").select("book_id", F.expr("case when book_id % 7 = 0 then 0 else length(text) div 4 end").alias("lo"), F.when(F.col("book_id") % 7 == 0, n).otherwise(F.expr("length(text) div 2")).alias("hi"))
    return chunking.drop_inside(spans(spark, sf), cut)


# ---- navigation ------------------------------------------------------------------------------------------------


@query("chapter_regex_index", "book_id:long title:string char_offset:long", O.q(O.BOOKS, O.LINES, select=f"select book_id, title, start as char_offset from (select *, {T.strip(D, 'line')} as title from lines where {D.has('line', O.HEADING_LINES)}) where not {P.has_leader(D, 'title')}"))
def chapter_regex_index(spark, sf):
    return structure.chapter_lines(lines(spark, sf))


@query("chapter_section_index", "book_id:long chapter_no:long title:string level:long char_offset:long", O.q(*O.WHOLE, O.CHAPTERS, select="select * from chapters"))
def chapter_section_index(spark, sf):
    return chapters(spark, sf)


@query("major_levels", "book_id:long section_no:long is_major:boolean", O.q(*O.STRUCTURE, select="select book_id, section_no, level is null or dense_rank() over (partition by book_id order by level nulls last) <= 2 as is_major from sections"))
def major_levels(spark, sf):
    return structure.major(sections(spark, sf))


_PLACED = """sized as (select *, lag(title) over w as previous, lead(title) over w as next, coalesce(lead(char_offset) over w, (select length(text) from books where books.book_id = chapters.book_id)) as until from chapters window w as (partition by book_id order by chapter_no)),
placed as (select p.event_id, p.book_id, p.pos, c.title as current, c.previous, case when c.title is null then f.title else c.next end as next, case when c.title is null then null when c.until - c.char_offset <= 0 then c.title
 else concat(c.title, ' - ', cast(greatest(1, least(99, (least(greatest(p.pos - c.char_offset, 0), c.until - c.char_offset) * 100) // (c.until - c.char_offset))) as varchar), '%') end as label
 from (select event_id, book_id, char_offset as pos from playhead) p asof left join sized c on p.book_id = c.book_id and p.pos >= c.char_offset left join (select book_id, title from chapters where chapter_no = 0) f on p.book_id = f.book_id)"""


def placed(spark, sf):
    probes = playhead(spark, sf).select("event_id", "book_id", F.col("char_offset").alias("pos"))
    return structure.placed(probes, checkpoint(chapters(spark, sf)), books(spark, sf), asof.parts_of(probes, "book_id"))


for _name, _columns in (("current_chapter", "current"), ("prev_next_chapter", "previous next"), ("chapter_progress", "label")):
    query(_name, "event_id:long book_id:long pos:long " + " ".join(f"{c}:string" for c in _columns.split()), O.q(*O.WHOLE, O.CHAPTERS, O.PLAYHEAD, _PLACED, select="select * from placed"))(placed)


@query("seek_chunk", "event_id:long book_id:long pos:long span_no:long", O.q(*O.STRUCTURE, O.PLAYHEAD, f'spans as (select book_id, row_number() over (partition by book_id order by block_no) - 1 as span_no, start, "end" from blocks where kind in {O.SPOKEN})', select='select event_id, p.book_id, char_offset as pos, (select min(span_no) from spans s where s.book_id = p.book_id and s."end" > p.char_offset) as span_no from playhead p'))
def seek_chunk(spark, sf):
    probes = playhead(spark, sf).select("event_id", "book_id", F.col("char_offset").alias("pos"))
    return structure.indexed(probes, spans(spark, sf), asof.parts_of(probes, "book_id"))


@query("seek_chunk_ranged", *CATALOGUE["seek_chunk"][1:])
def seek_chunk_ranged(spark, sf):
    """The same chunks through ranges of places, as for a book that most readers have open."""
    probes = playhead(spark, sf).select("event_id", "book_id", F.col("char_offset").alias("pos"))
    return structure.indexed(probes, spans(spark, sf), parts=8)


@query("chapter_progress_ranged", *CATALOGUE["chapter_progress"][1:])
def chapter_progress_ranged(spark, sf):
    """The same labels through ranges of places."""
    probes = playhead(spark, sf).select("event_id", "book_id", F.col("char_offset").alias("pos"))
    return structure.placed(probes, checkpoint(chapters(spark, sf)), books(spark, sf), parts=8)


# ---- headings and landmarks ------------------------------------------------------------------------------------


@query("heading_clean", "label_id:long label:string clean:string", O.q(O.LABELS, select=f"select label_id, label, clean from {O.cleaned('labels0', 'label')}"))
def heading_clean(spark, sf):
    return landmarks.cleaned(labels(spark, sf))


@query("heading_classify", "label_id:long kind:string priority:long", O.q(O.LABELS, select=f"select label_id, kind, {H.priority('kind')} as priority from (select *, {H.kind(D, 'clean')} as kind from {O.cleaned('labels0', 'label')})"))
def heading_classify(spark, sf):
    return landmarks.cleaned(labels(spark, sf))


@query("heading_occurrences", "book_id:long char_offset:long match:string key:string label:string prev_blank:boolean next_blank:boolean probable_toc:boolean", O.q(O.BOOKS, O.LINES, O.OCCURRENCES, select="select * from occurrences"))
def heading_occurrences(spark, sf):
    return landmarks.occurrences(books(spark, sf))


@query("toc_copies", "book_id:long char_offset:long label:string", O.q(O.BOOKS, O.LINES, O.OCCURRENCES, select="select book_id, char_offset, label from occurrences where match = 'exact' and probable_toc"))
def toc_copies(spark, sf):
    return landmarks.occurrences(books(spark, sf)).where("match = 'exact' and probable_toc")


_RANKED = f"""d1 as (select *, {T.label_key(D, 'label')} as key, case when source = 'nav' then 30 when source = 'text_scan' then 10 else 20 end as rank from candidates),
d2 as (select *, sum((char_offset is null or coalesce(char_offset - before > 400, true))::int) over (partition by book_id, key order by char_offset nulls last, rank) as cluster from (select *, lag(char_offset) over (partition by book_id, key order by char_offset nulls last, rank) as before from d1 where key <> ''))"""


@query("dedupe_candidates", "book_id:long label:string char_offset:long chunk_index:long source:string", O.q(O.BOOKS, O.LINES, O.CLASSIFIED, O.CANDIDATES, _RANKED, select="select book_id, label, char_offset, chunk_index, source from (select *, row_number() over (partition by book_id, key, cluster order by rank desc, (chunk_index is not null) desc, char_offset) as best from d2) where best = 1"))
def dedupe_candidates(spark, sf):
    return landmarks.deduplicated(candidates(spark, sf))


_BEST = f"""hits as (select book_id, key, char_offset as pos0, prev_blank, next_blank, reading_start as cut from occurrences join bounds using (book_id) where match = 'exact' and not probable_toc and key <> ''),
tiers as (select *, case when pos0 < cut and pos0 >= greatest(0, cut - 250) then 0 when pos0 >= cut then 1 else 2 end as tier from hits)"""


@query("best_occurrence", "book_id:long key:string at:long", O.q(*O.WHOLE, O.OCCURRENCES, _BEST, select="select book_id, key, pos0 as \"at\" from (select *, row_number() over (partition by book_id, key order by tier, case when tier = 2 then -(prev_blank::int + next_blank::int) else 0 end, case when tier = 2 then -pos0 else pos0 end) as rn from tiers) where rn = 1"))
def best_occurrence(spark, sf):
    o = landmarks.occurrences(books(spark, sf), classes=("exact",)).where("not probable_toc and key <> ''")
    rows = o.join(bounds(spark, sf).select("book_id", F.col("reading_start").alias("cut")), "book_id").select("book_id", "key", F.col("char_offset").alias("at"), "prev_blank", "next_blank", "cut")
    return landmarks.best_occurrences(rows)


@query("landmarks", "book_id:long char_offset:long label:string kind:string")
def landmarks_query(spark, sf):
    scan = chunking.heading_scan(books(spark, sf)).select("book_id", "label", "char_offset", F.lit(None).cast("int").alias("chunk_index"), F.lit("text_scan").alias("source"))
    nav = chapters(spark, sf).select("book_id", F.col("title").alias("label"), "char_offset", F.col("chapter_no").cast("int").alias("chunk_index"), F.lit("nav").alias("source"))
    return landmarks.resolved(books(spark, sf), scan.unionByName(nav), bounds(spark, sf))


#: Chapters, and after every third one a section that lies between it and the next; every fourth chapter is a book's mark.
_MARKS = """marks as (select book_id, char_offset, title as label, case when chapter_no % 4 = 3 then 'book' else 'chapter' end as kind from chapters union all select book_id, char_offset + 40, concat('Interlude ', chapter_no), 'section' from chapters where chapter_no % 3 = 0)"""


def marks(spark, sf):
    c = checkpoint(chapters(spark, sf))
    own = c.select("book_id", "char_offset", F.col("title").alias("label"), F.when(F.col("chapter_no") % 4 == 3, "book").otherwise("chapter").alias("kind"))
    return own.unionByName(c.where("chapter_no % 3 = 0").select("book_id", (F.col("char_offset") + 40).alias("char_offset"), F.concat(F.lit("Interlude "), F.col("chapter_no").cast("string")).alias("label"), F.lit("section").alias("kind")))


_MARK_COLUMNS = "book_id:long char_offset:long label:string kind:string"


@query("landmark_suppress_between", _MARK_COLUMNS, O.q(*O.WHOLE, O.CHAPTERS, _MARKS, select="select book_id, char_offset, label, kind from (select *, count_if(kind = 'chapter') over (partition by book_id) >= 2 as many, kind = 'section' and coalesce(lag(kind) over w = 'chapter', false) and coalesce(lead(kind) over w = 'chapter', false) as between_two from marks window w as (partition by book_id order by char_offset, label)) where not (many and between_two)"))
def landmark_suppress_between(spark, sf):
    return landmarks.without_between(marks(spark, sf))


@query("title_suppression", _MARK_COLUMNS, O.q(*O.WHOLE, O.CHAPTERS, _MARKS, select=f"select * from marks where {T.marker_key(D, 'label')} <> {T.marker_key(D, '''concat('-- Chapter ', cast(book_id % 9 as varchar), ' (Notes)')''')}"))
def title_suppression(spark, sf):
    titles = books(spark, sf).select("book_id", F.expr("concat('-- Chapter ', cast(book_id % 9 as string), ' (Notes)')").alias("title"))
    return landmarks.without_title(marks(spark, sf), titles)


#: Books with a second prologue at their end, and marks of books at the beginning and in the middle.
_TWICE = "twice as (select book_id, concat(text, chr(10), chr(10), '  Prologue', chr(10), chr(10), 'End.') as text from books)"
_VOLUMES = "volumes as (select book_id, 0::bigint as char_offset, 'Book 1' as label, 'book' as kind from twice union all select book_id, (length(text) // 2)::bigint, 'Book 2', 'book' from twice)"


@query("inject_prologue", _MARK_COLUMNS, O.q(O.BOOKS, _TWICE, _VOLUMES, """found as (select book_id, length(text) - length('  Prologue' || chr(10) || chr(10) || 'End.') - 1 as pos0 from twice union all
 select book_id, strpos(text, chr(10) || chr(10) || 'Prologue' || chr(10)) from twice where strpos(text, chr(10) || chr(10) || 'Prologue' || chr(10)) > 0), spans as (select v.book_id, char_offset as lo, coalesce(lead(char_offset) over (partition by v.book_id order by char_offset), length(text) + 1) as hi from volumes v join twice using (book_id))""",
       select="select * from volumes union all select book_id, min(pos0), 'Prologue', 'prologue' from spans join found using (book_id) where pos0 > lo and pos0 < hi group by book_id, lo having min(pos0) - lo <= 40000"))
def inject_prologue(spark, sf):
    twice = books(spark, sf).select("book_id", F.expr("concat(text, chr(10), chr(10), '  Prologue', chr(10), chr(10), 'End.')").alias("text"))
    first = twice.select("book_id", F.lit(0).cast("long").alias("char_offset"), F.lit("Book 1").alias("label"), F.lit("book").alias("kind"))
    second = twice.select("book_id", F.expr("cast(length(text) div 2 as bigint)").alias("char_offset"), F.lit("Book 2").alias("label"), F.lit("book").alias("kind"))
    return landmarks.with_prologues(first.unionByName(second), twice)


# ---- concepts --------------------------------------------------------------------------------------------------


@query("top_concepts", "doc_id:long term:string label:string n:long char_offset:long", f"""with w as (select doc_id, lower(unnest({D.find_all('text', concepts.TOKEN)})) as term from documents), c as (select doc_id, term, count(*) as n from w where term not in {P.listed(P.STOPWORDS)} and length(term) >= 3 group by doc_id, term),
r as (select *, row_number() over (partition by doc_id order by n desc, term) as r from c) select doc_id, term, {T.title_case(D, "replace(term, '-', ' ')")} as label, n, instr(lower(text), term) - 1 as char_offset from r join documents using (doc_id) where r <= 5""")
def top_concepts(spark, sf):
    return concepts.top_concepts(documents(spark, sf), "doc_id")


@query("weak_labels", "label_id:long weak:boolean", O.q(O.LABELS, select=f"select label_id, {P.is_weak_label(D, 'label')} as weak from (select label_id, case when label_id % 3 = 0 then concat('Without ', substr(label, 1, 5)) else label end as label from labels0)"))
def weak_labels(spark, sf):
    t = labels(spark, sf).withColumn("label", F.expr("case when label_id % 3 = 0 then concat('Without ', substr(label, 1, 5)) else label end"))
    return t.select("label_id", F.expr(P.is_weak_label(S, "label")).alias("weak"))


_HEADS = rf"""g1 as (select *, {T.strip(D, 'line')} as label from lines), g2 as (select *, {D.has('label', '(?i)^(?:chapter|part)[ ' + chr(92) + 't]+(?:[0-9]+|[ivxlcdm]+)($|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])')} as mark, {P.words_of(D, 'label')} as w from g1 where {P.is_reasonable_heading(D, 'label')}),
g3 as (select *, not mark and len(w) <= 8 and len(list_filter(w, lambda x: substr(x, 1, 1) = upper(substr(x, 1, 1)) and substr(x, 1, 1) <> lower(substr(x, 1, 1)))) >= greatest(1, len(w) // 2) as weak from g2),
g4 as (select *, sum((mark or weak)::int) over (partition by book_id order by n) as so_far from g3), g5 as (select *, min(case when not mark and so_far >= 50 then n end) over (partition by book_id) as full_at from g4)"""


@query("index_headings", "book_id:long label:string char_offset:long", O.q(O.BOOKS, O.LINES, _HEADS, select="select book_id, label, start as char_offset from g5 where (mark or weak) and (full_at is null or n <= full_at)"))
def index_headings(spark, sf):
    return concepts.index_headings(lines(spark, sf))


# ---- layouts and markup ----------------------------------------------------------------------------------------

_LAYOUT = (O.BOOKS, O.LINES, O.LAYOUT, O.LAYOUT_KINDS)


@query("layout_body_size", "book_id:long body:double", O.q(*_LAYOUT, select="select * from sized"))
def layout_body_size(spark, sf):
    return layout.body_sizes(layout_lines(spark, sf))


@query("layout_running_heads", "book_id:long key:string n_pages:long", O.q(*_LAYOUT, select="select * from heads"))
def layout_running_heads(spark, sf):
    return layout.running_heads(layout_lines(spark, sf))


@query("layout_kinds", "book_id:long ord:long kind:string", O.q(*_LAYOUT, select="select book_id, ord, kind from kinds"))
def layout_kinds(spark, sf):
    return layout.classified(layout_lines(spark, sf))


@query("layout_levels", "book_id:long size:double level:long", O.q(*_LAYOUT, select="select book_id, size, least(dense_rank() over (partition by book_id order by size desc), 6) as level from (select distinct book_id, round_even(size, 1) as size from kinds where kind = 'heading')"))
def layout_levels(spark, sf):
    return layout.levels(layout.classified(layout_lines(spark, sf)))


@query("contents_folios", "book_id:long ord:long first_kind:string kind:string", O.q(O.BOOKS, O.LINES, "layout as (select * replace (case when ord % 2 = 0 then cast(ord % 90 + 1 as varchar) else concat(text, ' . . . . . ', ord) end as text, 400.0::double as top) from (" + O.LAYOUT.partition(" as (")[2][:-1] + "))", O.LAYOUT_KINDS, select="select book_id, ord, first_kind, kind from kinds"))
def contents_folios(spark, sf):
    t = layout_lines(spark, sf).withColumn("text", F.expr("case when ord % 2 = 0 then cast(ord % 90 + 1 as string) else concat(text, ' . . . . . ', ord) end")).withColumn("top", F.lit(400.0))
    return layout.classified(t)


@query("furniture_strip", "book_id:long ord:long text:string", O.q(*_LAYOUT, "gone as (select book_id, page_index, t, count(*) as n from kinds where kind = 'running_head' or (kind = 'page_number' and margin) group by book_id, page_index, t)", select="select book_id, ord, text from (select p1.*, row_number() over (partition by book_id, page_index, t order by ord) as rank from p1) left join gone using (book_id, page_index, t) where n is null or rank > n"))
def furniture_strip(spark, sf):
    return layout.cleared(layout_lines(spark, sf))


#: Heading drafts in which some are only numbers.
_NUMBERED = "drafts as (select book_id, n as ord, 'heading' as kind, case when n % 3 = 0 then 1 else 2 end as level, case when n % 3 = 0 then concat(n % 7, '.', n % 5) else t end as text from classified where kind = 'heading')"


@query("split_numbering", "book_id:long ord:long kind:string level:long text:string", O.q(O.BOOKS, O.LINES, O.CLASSIFIED, _NUMBERED, r"""n1 as (select *, regexp_matches(text, '^[0-9]+(?:\.[0-9]+)*\.?$') as number from drafts), n2 as (select *, coalesce(lag(number) over w, false) as after_number, lag(text) over w as pt, lag(level) over w as pl from n1 window w as (partition by book_id order by ord)),
n3 as (select *, not number and after_number as takes from n2), n4 as (select *, number and coalesce(lead(takes) over (partition by book_id order by ord), false) as taken from n3)""", select="select book_id, ord, kind, case when takes then least(pl, level) else level end as level, case when takes then concat(pt, ' ', text) else text end as text from n4 where not taken"))
def split_numbering(spark, sf):
    d = structure.classified(lines(spark, sf)).where("kind = 'heading'").select("book_id", F.col("n").alias("ord"), "kind", F.expr("case when n % 3 = 0 then 1 else 2 end").alias("level"), F.expr("case when n % 3 = 0 then concat(n % 7, '.', n % 5) else t end").alias("text"))
    return layout.rejoined(d)


@query("anchored_drafts", "book_id:long block_no:long kind:string level:long start:long end:long text:string")
def anchored_drafts(spark, sf):
    return chunking.anchored(books(spark, sf), layout.drafts(layout.classified(layout_lines(spark, sf))))


def _kind_of_tag(x: str) -> str:
    return "case " + x + " " + " ".join(f"when '{t}' then '{k}'" for t, k in M.BLOCK_TAGS.items()) + " end"


_FLAT = f"""select page_id, {_kind_of_tag(M.element_tag(D, 'x'))} as kind, case when {M.element_tag(D, 'x')} like 'h%' then cast(substr({M.element_tag(D, 'x')}, 2) as int) when {M.element_tag(D, 'x')} = 'li' then 1 else 0 end as level, {M.element_text(D, 'x')} as text from (select page_id, unnest({M.flat_parts(D, 'html')}) as x from pages) where {M.element_text(D, 'x')} <> ''"""


@query("html_blocks", "page_id:long kind:string level:long text:string", _FLAT)
def html_blocks(spark, sf):
    t = B.table(spark, sf, "pages").select("page_id", F.explode(F.expr(M.flat_parts(S, "html"))).alias("x")).withColumn("tag", F.expr(M.element_tag(S, "x"))).withColumn("text", F.expr(M.element_text(S, "x")))
    level = F.when(F.col("tag").startswith("h"), F.expr("cast(substr(tag, 2) as int)")).when(F.col("tag") == "li", 1).otherwise(0)
    return t.where("text <> ''").select("page_id", F.expr(_kind_of_tag("tag")).alias("kind"), level.alias("level"), "text")


@query("html_blocks_nested", "page_id:long ord:long kind:string level:long text:string")
def html_blocks_nested(spark, sf):
    return M.markup_blocks(B.table(spark, sf, "pages"))


@query("html_text_tier3", "page_id:long text:string", f"select page_id, {M.crude_text(D, 'html')} as text from pages")
def html_text_tier3(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", F.expr(M.crude_text(S, "html")).alias("text"))


@query("format_dispatch", "page_id:long format:string", "select page_id, case page_id % 5 when 0 then 'text' when 1 then 'markdown' when 2 then 'layout' when 3 then 'markup' else 'convert' end as format from pages")
def format_dispatch(spark, sf):
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("txt", "MD", "pdf", "epub", "azw3")]), (F.col("page_id") % 5 + 1).cast("int"))
    return B.table(spark, sf, "pages").select("page_id", B.format_of(F.concat(F.lit("/b/x."), suffix)).alias("format"))


# ---- ids, caches, voices ---------------------------------------------------------------------------------------


@query("book_ids", "book_id:long id:string", O.q(O.BOOKS, select=f"select book_id, {T.book_id(D, '''concat('Book ', cast(book_id as varchar))''', 'text')} as id from books"))
def book_ids(spark, sf):
    return books(spark, sf).select("book_id", F.expr(T.book_id(S, "concat('Book ', cast(book_id as string))", "text")).alias("id"))


@query("cache_ids", "book_id:long id:string", O.q(*O.WHOLE, select=f"select book_id, {T.cache_id(D, 'text', 'coalesce(reading_start, 0)', ''' Kokoro ''' .join([chr(39)] * 2))} as id from books join bounds using (book_id)"))
def cache_ids(spark, sf):
    t = books(spark, sf).join(bounds(spark, sf), "book_id")
    return t.select("book_id", F.expr(T.cache_id(S, "text", "coalesce(reading_start, 0)", "' Kokoro '")).alias("id"))


@query("fingerprints", "book_id:long fingerprint:string", O.q(O.BOOKS, select="select book_id, sha256(text) as fingerprint from books"))
def fingerprints(spark, sf):
    return books(spark, sf).select("book_id", F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint"))


@query("stale_indexes", "book_id:long", O.q(O.BOOKS, select="select book_id from books where sha256(text) <> sha256(replace(text, 'the', 'The'))"))
def stale_indexes(spark, sf):
    """Stored indexes whose text has changed since: of books in which a word was written otherwise."""
    now = fingerprints(spark, sf)
    stored = books(spark, sf).select("book_id", F.sha2(F.regexp_replace("text", "the", "The").cast("binary"), 256).alias("fingerprint"))
    return stored.join(now, ["book_id", "fingerprint"], "left_anti").select("book_id")



_VOICES = "(select unnest([" + ", ".join(f"'{v}'" for v in stores.VOICES) + "]) as voice)"


@query("voice_labels", "voice:string label:string place:long", f"select voice, label, row_number() over (order by lower(label)) as place from (select voice, concat(upper(substr(voice, 4, 1)), substr(voice, 5), ' (', case when voice[1] = 'b' then 'British' else 'American' end, ' ', case when voice[2] = 'f' then 'Female' else 'Male' end, ')') as label from {_VOICES})")
def voice_labels(spark, sf):
    return stores.voices(spark).withColumn("label", stores.voice_label(F.col("voice"))).withColumn("place", F.row_number().over(W.Window.orderBy(F.lower("label"))))


@query("voice_filter", "voice:string", f"select voice from {_VOICES} where voice like 'bf%'")
def voice_filter(spark, sf):
    return stores.voices(spark).where(F.expr(P.voice_matches(S, "voice", "'b'", "'f'")))


# ---- positions, logs, signals ----------------------------------------------------------------------------------

_LOG = "mark_log as (select event_id, book_id, ts, case event_type when 'purchase' then 'add' when 'error' then 'delete' end as op, char_offset from playhead)"


def mark_log(spark, sf):
    return playhead(spark, sf).withColumn("op", F.expr("case event_type when 'purchase' then 'add' when 'error' then 'delete' end"))


@query("resume_positions", "book_id:long char_offset:long", O.q(O.BOOKS, O.PLAYHEAD, select="select book_id, arg_max(char_offset, (ts, event_id)) as char_offset from playhead where event_type = 'view' group by book_id"))
def resume_positions(spark, sf):
    return positions.resume(playhead(spark, sf).where("event_type = 'view'"))


_QUEUE = """k1 as (select *, count_if(op = 'add') over w as adds, count_if(op = 'delete') over w as deletes from mark_log where op is not null window w as (partition by book_id order by ts, event_id rows unbounded preceding)),
k2 as (select book_id, max(deletes) - greatest(0, max(deletes - adds)) as gone from k1 group by book_id), live as (select book_id, adds as bookmark_id, concat('Bookmark ', cast(adds as varchar)) as name, char_offset from k1 join k2 using (book_id) where op = 'add' and adds > gone)"""


@query("bookmark_log", "book_id:long bookmark_id:long name:string char_offset:long", O.q(O.BOOKS, O.PLAYHEAD, _LOG, _QUEUE, select="select * from live"))
def bookmark_log(spark, sf):
    return positions.bookmarks(mark_log(spark, sf))


@query("bookmark_dedupe", "book_id:long bookmark_id:long span_no:long", O.q(O.BOOKS, O.PLAYHEAD, _LOG, _QUEUE, select="select book_id, bookmark_id, span_no from (select *, char_offset // 500 as span_no, row_number() over (partition by book_id, char_offset // 500 order by bookmark_id) as r from live) where r = 1"))
def bookmark_dedupe(spark, sf):
    return positions.once_per_span(positions.bookmarks(mark_log(spark, sf)).withColumn("span_no", F.expr("char_offset div 500")))


_STATE = "case event_type when 'signup' then 'running' when 'purchase' then 'completed' when 'error' then 'error' when 'click' then 'cancelled' end"


@query("index_job_state", "book_id:long state:string progress:long", O.q(O.BOOKS, O.PLAYHEAD, select=f"select book_id, arg_max({_STATE}, (ts, event_id)) as state, least(100, greatest(0, arg_max(char_offset - 50, (ts, event_id)))) as progress from playhead where {_STATE} is not null group by book_id"))
def index_job_state(spark, sf):
    return positions.jobs(playhead(spark, sf).withColumn("state", F.expr(_STATE)).where("state is not null").withColumn("progress", F.col("char_offset") - 50))


@query("start_choice", "book_id:long start:long", O.q(*O.WHOLE, O.CHAPTERS, O.PLAYHEAD, select="""select book_id, coalesce(asked, saved, first, reading_start, 0) as start from books left join (select book_id, arg_max(char_offset, (ts, event_id)) as saved from playhead where event_type = 'view' and value > 45 group by book_id) using (book_id)
 left join (select book_id, arg_max(char_offset, (ts, event_id)) as asked from playhead where event_type = 'signup' and value < 3 group by book_id) using (book_id)
 left join (select book_id, min(char_offset) as first from chapters group by book_id) using (book_id) left join bounds using (book_id)"""))
def start_choice(spark, sf):
    b = books(spark, sf)
    p = playhead(spark, sf)
    asked, saved = positions.resume(p.where("event_type = 'signup' and value < 3")), positions.resume(p.where("event_type = 'view' and value > 45"))
    return positions.start_choice(b, asked, saved, chapters(spark, sf), bounds(spark, sf))


_PROGRESS = """case when n < 20000 then 5 when n < 80000 then 8 when n < 200000 then 12 else 20 end"""


@query("progress_ticks", "book_id:long i:long percent:long", O.q(O.BOOKS, select=f"select book_id, i, round_even(i / steps::double * 90, 0) as percent from (select book_id, steps, unnest(range(1, steps + 1)) as i from (select book_id, {_PROGRESS} as steps from (select book_id, length(text) as n from books)))"))
def progress_ticks(spark, sf):
    t = books(spark, sf).select("book_id", F.length("text").alias("n")).withColumn("steps", F.expr(_PROGRESS)).withColumn("i", F.explode(F.expr("sequence(1, steps)")))
    return t.select("book_id", "i", F.expr("bround(i / cast(steps as double) * 90, 0)").alias("percent"))


@query("token_timing", "item_id:long k:long start_char:long end_char:long start_ms:long end_ms:long", r"""with p as (select item_id, 60 * length(text) as duration_ms, unnest(range(0, len(x))) as k, unnest(x) as piece from (select item_id, text, regexp_extract_all(text, '\s*\S+') as x from benchmark)),
t as (select *, regexp_replace(piece, '^\s+', '') as token, sum(length(piece)) over (partition by item_id order by k) as till from p),
w as (select *, greatest(length(token) + case when right(token, 1) in ('.', '!', '?') then 6.0::double when right(token, 1) in (',', ';') then 2.5::double when right(token, 1) in (':', '—', '-') then 3.5::double else 0.0::double end, 1.0::double) as weight from t),
m as (select *, greatest(1, round_even(weight / sum(weight) over (partition by item_id) * duration_ms, 0)::bigint) as ms from w), r as (select *, sum(ms) over (partition by item_id order by k) as run, max(k) over (partition by item_id) as last from m)
select item_id, k, till - length(token) as start_char, till as end_char, least(run - ms, duration_ms) as start_ms, case when k = last then duration_ms else least(run, duration_ms) end as end_ms from r""")
def token_timing(spark, sf):
    return speech.timed(timed_texts(spark, sf), "item_id")


def timed_texts(spark, sf):
    return B.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("speak_text"), (F.length("text") * 60).cast("long").alias("duration_ms"))


@query("audible_span", "item_id:long ms:long start_char:long end_char:long", "with timing as (" + CATALOGUE["token_timing"][2] + """), probes as (select distinct item_id, ms from (select item_id, unnest(range(0, 60 * length(text) + 500, 700)) as ms from benchmark union all select item_id, start_ms from timing union all select item_id, end_ms from timing union all select item_id, end_ms - 1 from timing)),
ends as (select item_id, arg_min(struct_pack(a := start_char, b := end_char), k) as f, arg_max(struct_pack(a := start_char, b := end_char), k) as l, arg_max(end_ms, k) as until from timing group by item_id),
hit as (select p.item_id, p.ms, arg_min(struct_pack(a := start_char, b := end_char), k) as h from probes p join timing t on p.item_id = t.item_id and p.ms >= t.start_ms and p.ms < t.end_ms group by p.item_id, p.ms)
select item_id, ms, s.a as start_char, s.b as end_char from (select item_id, ms, coalesce(h, case when ms >= until then l else f end) as s from probes join ends using (item_id) left join hit using (item_id, ms))""")
def audible_span(spark, sf):
    t = timed_texts(spark, sf)
    spans = speech.timed(t, "item_id")
    probes = t.select("item_id", F.explode(F.expr("sequence(0, duration_ms + 499, 700)")).alias("ms"))
    edges = spans.select("item_id", F.explode(F.array("start_ms", "end_ms", F.col("end_ms") - 1)).alias("ms"))
    return speech.heard(spans, probes.unionByName(edges).distinct(), "item_id")


_AUDIO = {"signal_scale": lambda d: A.scaled(d, "embedding", 0.5), "signal_resample": lambda d: A.resampled(d, "embedding", 1.25)}
for _name, _f in _AUDIO.items():
    query(_name, "vec_id:long i:long value:double", f"select vec_id, unnest(range(0, len(a))) as i, unnest(a) as value from (select vec_id, {_f(D)} as a from embeddings)")(
        lambda spark, sf, f=_f: B.table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.expr(f(S))).alias("i", "value"))
    )


@query("signal_trim", "vec_id:long n:long total:double", f"select vec_id, len(a) as n, list_sum(list_transform(a, lambda x: cast(x as double))) as total from (select vec_id, {A.trimmed(D, 'embedding', 'f', 2)} as a from (select vec_id, embedding, {A.loud(D, 'embedding', 0.15)} as f from embeddings))")
def signal_trim(spark, sf):
    t = B.table(spark, sf, "embeddings").select("vec_id", "embedding", F.expr(A.loud(S, "embedding", 0.15)).alias("f")).select("vec_id", F.expr(A.trimmed(S, "embedding", "f", 2)).alias("a"))
    return t.select("vec_id", F.size("a").alias("n"), F.expr("aggregate(a, cast(0 as double), (s, x) -> s + x)").alias("total"))


@query("signal_clock", "event_id:long rate:double volume:double played:long", f"select event_id, rate, {A.volume_clamped('volume')} as volume, {A.played_ms(D, 'frames', '24000', 'rate')} as played from (select event_id, 0.75 + (event_id % 6) * 0.25 as rate, value / 50 - 0.5 as volume, event_id * 37 as frames from events)")
def signal_clock(spark, sf):
    t = B.table(spark, sf, "events").selectExpr("event_id", "0.75 + (event_id % 6) * 0.25 as rate", "value / 50 - 0.5 as volume", "event_id * 37 as frames")
    return t.selectExpr("event_id", f"{A.rate_valid('cast(rate as double)')} as rate", f"{A.volume_clamped('volume')} as volume", f"{A.played_ms(S, 'frames', '24000', 'cast(rate as double)')} as played")


_EMOJI = "array_to_string(list_transform(regexp_extract_all(text, '(?s).{1,50}'), lambda x: concat(x, '😀')), '')"


@query("utf16_positions", "doc_id:long pos:long utf16:long", f"""with e as (select doc_id, {_EMOJI} as text from documents), p as (select doc_id, text, unnest(list_distinct(list_concat(range(0, length(text) + 1, 211), list_filter([49, 50, 51, 52, 102, length(text)], lambda x: x <= length(text))))) as pos from e where text is not null) select doc_id, pos, pos + length(substr(text, 1, pos)) - length(replace(substr(text, 1, pos), '😀', '')) as utf16 from p""")
def utf16_positions(spark, sf):
    e = documents(spark, sf).select("doc_id", F.expr("array_join(transform(regexp_extract_all(text, r'(?s).{1,50}', 0), x -> concat(x, '😀')), '')").alias("text"))
    probes = e.where("text is not null").select("doc_id", F.explode(F.expr("array_distinct(concat(sequence(0, length(text), 211), filter(array(49, 50, 51, 52, 102, length(text)), x -> x <= length(text))))")).alias("pos"))
    return positions.to_utf16(e, probes, "doc_id")
