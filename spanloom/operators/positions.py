"""Where readers are: positions, bookmarks, jobs and caches from logs of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from spanloom.functions import text as T
from spanloom.functions.dialect import SPARK
from spanloom.operators import asof
from spanloom.operators.folds import folded
from spanloom.operators.structure import of_book


def playhead(events: DataFrame, n_books: int) -> DataFrame:
    """(event_id, book_id, ts, char_offset): events read as positions in books."""
    return events.select("event_id", (F.col("user_id") % n_books).alias("book_id"), "ts", "event_type", "value", F.expr("cast(value * 10 as bigint)").alias("char_offset"))


def resume(log: DataFrame) -> DataFrame:
    """(book_id, char_offset, ts): the last position saved of each book."""
    best = log.groupBy("book_id").agg(F.max_by(F.struct("char_offset", "ts"), F.struct("ts", "event_id")).alias("r"))
    return best.select("book_id", "r.char_offset", "r.ts")


def bookmarks(log: DataFrame) -> DataFrame:
    """Live bookmarks (book_id, bookmark_id, name, char_offset) of a log with op add or delete; a delete takes the oldest live one.

    Numbers count the adds of a book and are never used again. The deletes that met no live bookmark are the largest
    excess of deletes over adds so far; the others took as many of the oldest.
    """
    w = W.Window.partitionBy("book_id").orderBy("ts", "event_id").rowsBetween(W.Window.unboundedPreceding, 0)
    t = log.where("op in ('add', 'delete')").withColumn("adds", F.count_if(F.col("op") == "add").over(w)).withColumn("deletes", F.count_if(F.col("op") == "delete").over(w))
    gone = t.groupBy("book_id").agg((F.max("deletes") - F.greatest(F.lit(0), F.max(F.col("deletes") - F.col("adds")))).alias("gone"))
    live = t.where("op = 'add'").join(gone, "book_id").where("adds > gone")
    return live.select("book_id", F.col("adds").alias("bookmark_id"), F.concat(F.lit("Bookmark "), F.col("adds").cast("string")).alias("name"), "char_offset")


def once_per_span(marks: DataFrame) -> DataFrame:
    """Bookmarks (book_id, bookmark_id, span_no): one that lies in a span with an earlier one is not added."""
    w = W.Window.partitionBy("book_id", "span_no").orderBy("bookmark_id")
    return marks.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def jobs(log: DataFrame) -> DataFrame:
    """(book_id, state, progress): the last state of each book's indexing job, progress from 0 to 100."""
    best = log.groupBy("book_id").agg(F.max_by(F.struct("state", "progress"), F.struct("ts", "event_id")).alias("r"))
    return best.select("book_id", "r.state", F.least(F.lit(100), F.greatest(F.lit(0), F.col("r.progress"))).alias("progress"))


def start_choice(books: DataFrame, explicit: DataFrame, saved: DataFrame, marks: DataFrame, bounds: DataFrame) -> DataFrame:
    """(book_id, start): the offset asked for, else the one saved, else the first landmark, else where reading starts."""
    first = marks.groupBy("book_id").agg(F.min("char_offset").alias("first"))
    t = books.select("book_id").join(explicit.select("book_id", F.col("char_offset").alias("asked")), "book_id", "left").join(saved.select("book_id", F.col("char_offset").alias("saved")), "book_id", "left")
    t = t.join(first, "book_id", "left").join(bounds.select("book_id", "reading_start"), "book_id", "left")
    return t.select("book_id", F.coalesce("asked", "saved", "first", "reading_start", F.lit(0)).alias("start"))


def wide_characters(texts: DataFrame, key: str) -> DataFrame:
    """(key, rank, at): the characters of a text that take two 16-bit units, numbered from 0, with their offset; one row for each, none for others."""
    parts = texts.select(key, F.posexplode(F.split("text", r"[\x{10000}-\x{10FFFF}]", -1)).alias("rank", "part"))
    w = W.Window.partitionBy(key).orderBy("rank")
    parts = parts.select(key, "rank", (F.sum(F.length("part")).over(w.rowsBetween(W.Window.unboundedPreceding, 0)) + F.col("rank")).alias("at"), F.lead("rank").over(w).alias("more"))
    return parts.where("more is not null").select(key, "rank", "at")


def to_utf16(texts: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """Probes (key, pos, ...) with ``utf16``: the offset in 16-bit units, one more for each wide character before it."""
    wide = wide_characters(texts, key).select(key, "rank", (F.col("at") + 1).alias("past"))
    hit = asof.backward(probes, "pos", wide, "past", key)
    return hit.select(*probes.columns, (F.col("pos") + F.coalesce(F.col("hit.rank") + 1, F.lit(0))).alias("utf16"))


def from_utf16(texts: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """Probes (key, utf16, ...) with ``pos``: the offset in characters; the second unit of a wide character is at its first."""
    wide = wide_characters(texts, key).select(key, "rank", (F.col("at") + F.col("rank") + 1).alias("past"))
    hit = asof.backward(probes, "utf16", wide, "past", key)
    return hit.select(*probes.columns, (F.col("utf16") - F.coalesce(F.col("hit.rank") + 1, F.lit(0))).alias("pos"))


#: Milliseconds between two reports at least (fixed value).
REPORT = 25


def throttled(times: list[int], spans: list[int], gap: int = REPORT, last: int | None = None, span: int | None = None) -> tuple[list[bool], int | None, int | None]:
    """Which reports are sent, and the state after them: the time of the last that was let through, and its span.

    A report is let through ``gap`` after the last one that was; it is sent if its span is another one.
    """
    out = []
    for t, s in zip(times, spans, strict=True):
        through = last is None or t - last >= gap
        out.append(through and s != span)
        if through:
            last, span = t, s
    return out, last, span


def reports(rows: DataFrame, gap: int = REPORT) -> DataFrame:
    """(book_id, chunk, ms, span) of the reports that are sent, of all (book_id, chunk, ms, span); each chunk begins anew."""

    def step(state: tuple | None, columns: list[list]) -> tuple[list[bool], list[list], tuple]:
        send, last, span = throttled(*columns, gap, *(state or (None, None)))
        return send, [], (last, span)

    return folded(rows.select("book_id", "chunk", "ms", "span"), ["book_id", "chunk"], ["ms", "span"], ["ms", "span"], step)


def narration_states(log: DataFrame) -> DataFrame:
    """Events (event_id, book_id, ts, op, chunk) with ``status`` and ``playing``: what listeners are told after each.

    Ops are start, begin (of a chunk), pause, resume, request (to stop after the chunk), end (of a chunk) and stop. An
    end stops when a request came since the last start, stop or end; so of several the last one wins.
    """
    w = of_book("ts", "event_id")
    bound = F.last(F.when(F.col("op").isin("start", "stop", "end", "request"), F.col("op")), True).over(w.rowsBetween(W.Window.unboundedPreceding, -1))
    t = log.withColumn("stops", (F.col("op") == "stop") | ((F.col("op") == "end") & F.coalesce(bound == "request", F.lit(False))))
    upto = w.rowsBetween(W.Window.unboundedPreceding, 0)
    status = F.when(F.col("stops"), "STOPPED").when(F.col("op").isin("begin", "resume"), "PLAYING").when(F.col("op") == "pause", "PAUSED")
    playing = F.when(F.col("stops"), F.struct(F.lit(None).cast("long").alias("c"))).when(F.col("op") == "begin", F.struct(F.col("chunk").cast("long").alias("c")))
    t = t.withColumn("status", F.coalesce(F.last(status, True).over(upto), F.lit("IDLE"))).withColumn("playing", F.last(playing, True).over(upto)["c"])
    return t.select(*log.columns, "status", "playing")


def saved_positions(states: DataFrame, chunks: DataFrame) -> DataFrame:
    """(book_id, char_offset) of the last state (book_id, ts, event_id, playing, audible, shown) of each book that played: what is heard, else what is shown, else where the chunk starts."""
    t = states.where("playing is not null or audible is not null or shown is not null")
    last = t.groupBy("book_id").agg(F.max_by(F.struct("playing", "audible", "shown"), F.struct("ts", "event_id")).alias("s")).select("book_id", "s.*")
    at = chunks.select("book_id", F.col("span_no").alias("playing"), F.col("start").alias("begins"))
    return last.join(at, ["book_id", "playing"], "left").select("book_id", F.coalesce("audible", "shown", "begins").alias("char_offset")).where("char_offset is not null")


def admitted(log: DataFrame) -> DataFrame:
    """Events (book_id, ts, event_id, state, ...) of indexing jobs without the starts of a book whose job is running: one job of a book at a time."""
    before = F.lag("state").over(of_book("ts", "event_id"))
    return log.withColumn("_before", before).where("not (state = 'running' and coalesce(_before = 'running', false))").drop("_before")


def status_label(chapter: str, current: str, total: str) -> str:
    """SQL text for the status line: the chapter's label, else which fragment of how many is read, else null."""
    return f"coalesce({chapter}, case when {total} > 0 then concat(cast(coalesce({current}, 0) + 1 as string), '/', cast({total} as string)) end)"


def line_at(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes (book_id, pos, ...) with ``label``: the stripped line that holds the offset; what lies outside the text goes to its ends."""
    hit = asof.backward(probes, "pos", rows.select("book_id", "start", "line"), "start", "book_id", clamp=True)
    return hit.select(*probes.columns, F.expr(T.strip(SPARK, "hit.line")).alias("label"))
