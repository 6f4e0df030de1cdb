"""More queries of the catalogue: stores, selections, dimensions and compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import predicates as P
from spanloom.functions import text as T
from spanloom.functions.dialect import DUCK as D
from spanloom.functions.dialect import SPARK as S
from spanloom.operators import positions, selection, speech, structure
from spanloom.plans import oracle as O
from spanloom.plans.catalogue import _LOG, _QUEUE, CATALOGUE, blocks, books, bounds, chapters, documents, mark_log, playhead, query, timed_texts
from spanloom.sources import archives, stores
from spanloom.sources import books as B

#: Spoken blocks in order, as given chunks.
_CHUNKS = f'chunks as (select book_id, row_number() over (partition by book_id order by block_no) - 1 as span_no, start, "end", text from blocks where kind in {O.SPOKEN})'
_SPOKEN = f"spoken as (select *, row_number() over (partition by book_id order by span_no) - 1 as play_no from (select *, {T.sanitize(D, 'text')} as say from chunks) where say <> '')"
_STARTS = "starts as (select book_id, arg_max(char_offset, (ts, event_id)) as start_at from playhead where event_type = 'view' group by book_id)"


def given(spark, sf):
    b = blocks(spark, sf).where(F.col("kind").isin(structure.kinds(2)))
    return b.select("book_id", (F.row_number().over(structure.of_book("block_no")) - 1).alias("span_no"), "start", "end", "text")


def starts(spark, sf):
    return positions.resume(playhead(spark, sf).where("event_type = 'view'")).select("book_id", F.col("char_offset").alias("start_at"))


@query("spoken_chunks", "book_id:long span_no:long play_no:long say:string", O.q(*O.STRUCTURE, _CHUNKS, _SPOKEN, select="select * from spoken"))
def spoken_chunks(spark, sf):
    return selection.spoken(given(spark, sf))


_GATE = "case when playing < 0 then (case when paused then 0 else 6 end) else playing end + case when paused then 0 else 6 end"


@query("lookahead_gate", "book_id:long play_no:long allowed:boolean", O.q(*O.STRUCTURE, _CHUNKS, _SPOKEN, select=f"select book_id, play_no, play_no <= {_GATE} as allowed from (select *, book_id % 9 - 1 as playing, book_id % 4 = 0 as paused from spoken)"))
def lookahead_gate(spark, sf):
    t = selection.spoken(given(spark, sf)).select("book_id", "play_no", (F.col("book_id") % 9 - 1).alias("playing"), (F.col("book_id") % 4 == 0).alias("paused"))
    return selection.within_reach(t)


@query("presynthesis", "book_id:long span_no:long", O.q(*O.STRUCTURE, _CHUNKS, _SPOKEN, O.PLAYHEAD, _STARTS, select='select book_id, span_no from (select spoken.*, row_number() over (partition by book_id order by span_no) as r from spoken join starts using (book_id) where "end" > start_at) where r <= 2 and span_no % 3 <> 0'))
def presynthesis(spark, sf):
    s = selection.spoken(given(spark, sf))
    return selection.first_missing(s, starts(spark, sf), s.where("span_no % 3 = 0").select("book_id", "span_no"))


@query("trim_forced_start", "book_id:long span_no:long start:long end:long text:string", O.q(*O.STRUCTURE, _CHUNKS, O.PLAYHEAD, _STARTS, select='select book_id, span_no, case when start <= start_at and start_at < "end" then start_at else start end as start, "end", case when start <= start_at and start_at < "end" then substr(text, start_at - start + 1) else text end as text from chunks left join starts using (book_id)'))
def trim_forced_start(spark, sf):
    return selection.trimmed(given(spark, sf), starts(spark, sf))


@query("chunk_offsets", "event_id:long book_id:long span_no:long start:long", O.q(*O.STRUCTURE, _CHUNKS, O.PLAYHEAD, select="select event_id, book_id, p.char_offset // 7 as span_no, start from playhead p left join chunks c using (book_id) where false union all select event_id, p.book_id, p.char_offset // 7, c.start from playhead p left join chunks c on c.book_id = p.book_id and c.span_no = p.char_offset // 7"))
def chunk_offsets(spark, sf):
    rows = playhead(spark, sf).select("event_id", "book_id", F.expr("char_offset div 7").alias("span_no"))
    return selection.offsets_of(rows, given(spark, sf))


#: Index documents as JSON: a node for each chapter, every fifth of which has no anchor, and one without a label.
def chapter_index(spark, sf):
    n = F.col("chapter_no").cast("string")
    node = F.struct(F.concat(F.lit("n"), n).alias("node_id"), F.when(F.col("chapter_no") == 3, " ").otherwise(F.col("title")).alias("label"), F.concat(F.lit("a"), n).alias("primary_anchor_id"))
    anchor = F.when(F.col("chapter_no") % 5 != 0, F.struct(F.concat(F.lit("a"), n).alias("anchor_id"), F.col("chapter_no").cast("int").alias("chunk_index"), "char_offset"))
    return chapters(spark, sf).groupBy("book_id").agg(F.to_json(F.struct(F.collect_list(node).alias("nodes"), F.collect_list(anchor).alias("anchors"))).alias("doc"))


@query("node_targets", "book_id:long node_id:string label:string chunk_index:long char_offset:long", O.q(*O.WHOLE, O.CHAPTERS, select="select book_id, concat('n', chapter_no) as node_id, trim(title) as label, case when chapter_no % 5 <> 0 then chapter_no end as chunk_index, case when chapter_no % 5 <> 0 then char_offset end as char_offset from chapters where chapter_no <> 3"))
def node_targets(spark, sf):
    return selection.node_targets(chapter_index(spark, sf))


@query("alignment_spans", "item_id:long k:long start_char:long end_char:long start_ms:long confidence:double", "select item_id, k, k * 3 as start_char, k * 3 + 2 as end_char, k * 40 as start_ms, case when k = 1 then 0.25 else 0.5 end as confidence from (select item_id, unnest(range(0, least(4, length(text)))) as k from benchmark)")
def alignment_spans(spark, sf):
    t = B.table(spark, sf, "benchmark").select("item_id", F.expr("""concat('{"chunk_id": 1, "duration_ms": 160, "spans": [', array_join(transform(sequence(0, least(4, length(text)) - 1), k -> concat('{"start_char": ', k * 3, ', "end_char": ', k * 3 + 2, ', "audio_start_ms": ', k * 40, ', "audio_end_ms": ', k * 40 + 40, case when k = 1 then ', "confidence": 0.25' else '' end, '}')), ','), ']}')""").alias("doc"))
    out = selection.alignments(t.withColumnRenamed("item_id", "book_id"))
    return out.select(F.col("book_id").alias("item_id"), "k", "start_char", "end_char", F.col("audio_start_ms").alias("start_ms"), "confidence")


@query("candidate_union", "book_id:long label:string char_offset:long source:string", O.q(*O.WHOLE, O.CHAPTERS, select="select book_id, title as label, char_offset, 'chapter_parser' as source from chapters union all select book_id, text, start, 'text_scan' from blocks where kind = 'heading'"))
def candidate_union(spark, sf):
    parsed = chapters(spark, sf).select("book_id", F.col("title").alias("label"), "char_offset", F.lit("chapter_parser").alias("source"))
    scanned = blocks(spark, sf).where("kind = 'heading'").select("book_id", F.col("text").alias("label"), F.col("start").alias("char_offset"), F.lit("text_scan").alias("source"))
    return parsed.unionByName(scanned)


@query("kind_policy", "kind:string is_displayed:boolean is_spoken:boolean n:long", O.q(O.BOOKS, O.LINES, O.CLASSIFIED, O.BLOCKS, select=f"select kind, kind in {O.SHOWN} as is_displayed, kind in {O.SPOKEN} as is_spoken, count(*) as n from blocks group by kind"))
def kind_policy(spark, sf):
    known = spark.createDataFrame(list(P.BLOCK_KINDS), "kind string, is_displayed boolean, is_spoken boolean")
    return blocks(spark, sf).join(F.broadcast(known), "kind").groupBy("kind", "is_displayed", "is_spoken").agg(F.count("*").alias("n"))


@query("preferences", "user_id:long volume:double", "select user_id, least(greatest(arg_max(value / 40, (ts, event_id)), 0.0), 1.0) as volume from events group by user_id")
def preferences(spark, sf):
    log = B.table(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("value") / 40).alias("volume"))
    return stores.latest(log, ["user_id"], "ts", "event_id").select("user_id", F.least(F.greatest("volume", F.lit(0.0)), F.lit(1.0)).alias("volume"))


@query("forget_books", "book_id:long char_offset:long", O.q(O.BOOKS, O.PLAYHEAD, select="select book_id, char_offset from playhead where event_type = 'view' and book_id not in (select book_id from playhead where event_type = 'error' and value > 250)"))
def forget_books(spark, sf):
    p = playhead(spark, sf)
    return stores.without(p.where("event_type = 'view'"), p.where("event_type = 'error' and value > 250"), ["book_id"]).select("book_id", "char_offset")


@query("scalar_forms", "event_id:long iso:string back:boolean number:long language:string pin:string", f"""select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' as iso, true as back, coalesce(try_cast(event_type as int), case when event_id % 3 = 0 then event_id else -1 end) as number,
 {T.language_code(D, "case event_id % 3 when 0 then ' EN_gb' when 1 then 'en-US' else 'fr' end")} as language, {T.pinned(D, "case event_id % 3 when 0 then '' when 1 then concat('📌 ', event_type) else event_type end")} as pin from (select event_id, date_trunc('second', ts) as ts, event_type from events)""")
def scalar_forms(spark, sf):
    e = B.table(spark, sf, "events").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return e.select(
        "event_id", iso.alias("iso"), (F.to_timestamp(iso) == F.col("ts")).alias("back"), F.expr("coalesce(try_cast(event_type as int), case when event_id % 3 = 0 then event_id else -1 end)").alias("number"),
        F.expr(T.language_code(S, "case event_id % 3 when 0 then ' EN_gb' when 1 then 'en-US' else 'fr' end")).alias("language"), F.expr(T.pinned(S, "case event_id % 3 when 0 then '' when 1 then concat('📌 ', event_type) else event_type end")).alias("pin"),
    )


_FILES = "array('front.gif', 'My Cover.PNG', 'cover.webp', 'covers.jpg', 'folder-1.bmp', 'notes.txt', 'cover.txt')"


@query("cover_choice", "folder:long name:string", f"""with f as (select doc_id // 3 as folder, ['front.gif', 'My Cover.PNG', 'cover.webp', 'covers.jpg', 'folder-1.bmp', 'notes.txt', 'cover.txt'][doc_id % 7 + 1] as name, length(text) as length from documents), r as (select *, {archives.cover_rank('name')} as rank from f where length between 1 and 60000)
select folder, arg_min(name, (rank, lower(name), name)) as name from r where rank is not null group by folder""")
def cover_choice(spark, sf):
    f = documents(spark, sf).select(F.expr("doc_id div 3").alias("folder"), F.expr(f"element_at({_FILES}, cast(doc_id % 7 + 1 as int))").alias("name"), F.length("text").alias("length"))
    return archives.covers(f, 60_000)


@query("book_progress", "book_id:long percent:long", O.q(*O.WHOLE, O.PLAYHEAD, select="select book_id, max(least(100, greatest(0, ((char_offset - coalesce(reading_start, 0)) * 100) // greatest(length(text) - coalesce(reading_start, 0), 1)))) as percent from playhead join books using (book_id) join bounds using (book_id) where char_offset >= coalesce(reading_start, 0) group by book_id"))
def book_progress(spark, sf):
    t = playhead(spark, sf).join(books(spark, sf), "book_id").join(bounds(spark, sf), "book_id").withColumn("s", F.coalesce("reading_start", F.lit(0))).where("char_offset >= s")
    return t.groupBy("book_id").agg(F.max(F.expr("least(100, greatest(0, ((char_offset - s) * 100) div greatest(length(text) - s, 1)))")).alias("percent"))


@query("audible_offsets", "item_id:long k:long start_char:long end_char:long", "select item_id, k, start_char + item_id * 1000 as start_char, end_char + item_id * 1000 as end_char from (" + CATALOGUE["token_timing"][2] + ")")
def audible_offsets(spark, sf):
    """Spans of a chunk's tokens as offsets into its book, of which each chunk has a place."""
    at = F.col("item_id") * 1000
    return speech.timed(timed_texts(spark, sf), "item_id").select("item_id", "k", (F.col("start_char") + at).alias("start_char"), (F.col("end_char") + at).alias("end_char"))


_STORE = O.q(O.BOOKS, O.PLAYHEAD, _LOG, _QUEUE, select="select book_id, bookmark_id, name, char_offset, max(bookmark_id) over (partition by book_id) + 1 as next_id from live")


@query("bookmark_store", "book_id:long bookmark_id:long name:string char_offset:long next_id:long", _STORE)
def bookmark_store(spark, sf):
    """Live bookmarks written as one JSON document a book and read again, with the next number of each book."""
    row = F.struct(F.col("bookmark_id").cast("int").alias("bookmark_id"), "name", "char_offset")
    docs = positions.bookmarks(mark_log(spark, sf)).groupBy("book_id").agg(F.to_json(F.struct(F.lit(1).alias("next_id"), F.collect_list(row).alias("bookmarks"))).alias("json"))
    return stores.bookmarks_from_json(docs).join(stores.next_ids(docs), "book_id")
