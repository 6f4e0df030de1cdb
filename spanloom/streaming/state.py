"""Positions, bookmarks, job states and throttled reports as streams; a replay of a log ends where the batch form does."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.operators.positions import REPORT, throttled
from spanloom.operators.selection import AHEAD

#: The store that states with several variables and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def started(df: DataFrame, writer: DataStreamWriter) -> StreamingQuery:
    """The query of a stateful stream ``df``, started with the store that it needs; the session's setting is as before."""
    conf = df.sparkSession.conf
    before = conf.get(STORE[0], None)
    conf.set(*STORE)
    try:
        return writer.start()
    finally:
        conf.unset(STORE[0]) if before is None else conf.set(STORE[0], before)


def upserted(stream: DataFrame, key: str, by: str, write: Callable[[DataFrame], None], checkpoint: str):
    """A started query that hands each micro-batch's last row per key to ``write``."""
    def each(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c != key]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(by, *[c for c in rest if c != by])).alias("r"))
        write(last.select(key, "r.*"))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bookmark_events(stream: DataFrame) -> DataFrame:
    """(book_id, bookmark_id, live) for each change: adds count on and are never numbered again, a delete takes the oldest live one."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        added, gone = state.get if state.exists else (0, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for op in rows["op"]:
            if op == "add":
                added += 1
                out.append((key[0], added, True))
            elif op == "delete" and gone < added:
                gone += 1
                out.append((key[0], gone, False))
        state.update((added, gone))
        yield pd.DataFrame(out, columns=["book_id", "bookmark_id", "live"])

    return stream.groupBy("book_id").applyInPandasWithState(step, "book_id long, bookmark_id long, live boolean", "added long, gone long", "append", GroupStateTimeout.NoTimeout)


def throttled_events(stream: DataFrame, gap: int = REPORT) -> DataFrame:
    """(book_id, chunk, ms, span) of the reports that are sent; the state is the last one that was let through. Each chunk begins anew."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ms", "span"])
        last, span = state.get if state.exists else (None, None)
        send, last, span = throttled(rows["ms"].tolist(), rows["span"].tolist(), gap, last, span)
        state.update((int(last), int(span)))
        yield rows[send][["book_id", "chunk", "ms", "span"]]

    return stream.groupBy("book_id", "chunk").applyInPandasWithState(step, "book_id long, chunk long, ms long, span long", "ms long, span long", "append", GroupStateTimeout.NoTimeout)


#: A book's state, and its events that wait.
NOW = "status string, playing long, forced_at long, requested boolean, waiting array<struct<us: long, event_id: long, op: string, chunk: long>>"


class Playback(StatefulProcessor):
    """What a book's listeners are told after each event, in the order of event time.

    Events wait until the watermark has passed them, so that micro-batches may bring them in any order; one that comes
    later still is taken when it comes. A request to stop after the chunk is forced ``deadline`` milliseconds later, if
    no end of a chunk came. A book's state is one value with what waits in it, and events are rows: lists of their own and a
    frame for each book took nearly all of the time.
    """

    def __init__(self, deadline: int | None = None):
        self.deadline = deadline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", NOW)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        r = initialState
        self.now.update((r.status, r.playing, None, bool(r.requested), []))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        return self.release(key, [(r.us, r.event_id, r.op, r.chunk) for r in rows], timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self.release(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def release(self, key: tuple, came: list[tuple], upto: int) -> Iterator[Row]:
        """What the watermark has passed, in order; the rest waits, with a timer for the first of it."""
        status, playing, forced_at, requested, waiting = self.now.get() or ("IDLE", None, None, False, [])
        held = sorted([*map(tuple, waiting), *came], key=lambda r: r[:3])
        ready, rest = [r for r in held if r[0] < upto], [r for r in held if r[0] >= upto]
        out = []
        for us, event_id, op, chunk in [*ready, (upto, None, "", None)]:
            if forced_at is not None and forced_at <= us:
                status, playing, requested = "STOPPED", None, False
                out.append((None, key[0], forced_at, "forced", status, playing))
                forced_at = None
            if event_id is None:
                break
            stops = op == "stop" or op == "end" and requested
            if op in ("start", "stop", "end"):
                requested, forced_at = False, None
            elif op == "request":
                requested, forced_at = True, None if self.deadline is None else us + 1000 * self.deadline
            if stops:
                status, playing = "STOPPED", None
            elif op in ("begin", "resume"):
                status, playing = "PLAYING", chunk if op == "begin" else playing
            elif op == "pause":
                status = "PAUSED"
            out.append((event_id, key[0], us, op, status, playing))
        self.now.update((status, playing, forced_at, requested, rest))
        for us in [r[0] for r in rest[:1]] + [forced_at] * (forced_at is not None):
            self.handle.registerTimer(us // 1000 + 1)
        yield from (Row(event_id=e, book_id=b, us=us, op=op, status=s, playing=p) for e, b, us, op, s, p in out)

    def close(self) -> None:
        pass


def playback_events(stream: DataFrame, delay: str, deadline: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """(event_id, book_id, us, op, status, playing) of a stream of events (event_id, book_id, ts, op, chunk), ``delay`` after one another at most.

    ``initial`` has the state that books begin with (book_id, status, playing, requested). Events ``forced`` have no id.
    """
    rows = stream.withWatermark("ts", delay).select("event_id", "book_id", "ts", "op", "chunk", F.unix_micros("ts").alias("us"))
    out = "event_id long, book_id long, us long, op string, status string, playing long"
    return rows.groupBy("book_id").transformWithState(Playback(deadline), out, "append", "EventTime", None if initial is None else initial.groupBy("book_id"))


class Publisher(StatefulProcessor):
    """Results in order: what is ready waits by its number until all before it are out, and each goes out once.

    What waits is read and written as a whole for each micro-batch: a call to the store for each result takes far longer.
    """

    def __init__(self, ahead: int = AHEAD):
        self.ahead = ahead

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "span_no long")
        self.waiting = handle.getListState("waiting", "span_no long, result string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0] if self.next.exists() else 0
        held = {int(n): result for n, result in self.waiting.get()}
        for p in rows:
            for span_no, result in zip(p["span_no"], p["result"], strict=True):
                if int(span_no) >= at:  # else it is out
                    held[int(span_no)] = result
        out = []
        while at in held:
            out.append((key[0], at, held.pop(at), at + self.ahead))
            at += 1
        self.next.update((at,))
        if held:
            self.waiting.put(sorted(held.items()))
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["book_id", "span_no", "result", "may_start"]).astype({"book_id": "int64", "span_no": "int64", "may_start": "int64"})

    def close(self) -> None:
        pass


def published_events(stream: DataFrame, ahead: int = AHEAD) -> DataFrame:
    """(book_id, span_no, result, may_start): results (book_id, span_no, result) in the order of their numbers from 0, whatever the order in which they come.

    One that comes again goes out once. ``may_start`` is the last number that workers may begin with now, so that no
    more than ``ahead`` wait: what feeds the stream holds back by it, and nothing that came is dropped.
    """
    out = "book_id long, span_no long, result string, may_start long"
    return stream.select("book_id", "span_no", "result").groupBy("book_id").transformWithStateInPandas(Publisher(ahead), out, "append", "None")
