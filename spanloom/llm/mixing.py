"""Mixing sources to target weights along a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from spanloom.llm.common import BROADCAST_ROWS, WORD, checkpoint, map_arrow, running_sum, schema, word_count

WEIGHTS = (1, 2, 3)
#: Times that a document is taken, at most.
REPEATS = 3
#: Words of a block, at most; a source of few words has blocks of fewer, BLOCKS in all where it has so many words.
BLOCK = 4096
BLOCKS = 256
#: Sources whose names and sums the driver holds, at most.
SOURCES = 1_000_000
#: 2^64 over the golden ratio: multiples of it, modulo 2^64, are the points of the schedule.
GOLDEN = 0x9E3779B97F4A7C15
SLOTS = 1 << 16


@dataclass
class Source:
    name: str | None
    size: int
    weight: float
    target: float = 0.0
    blocks: int = 0
    slots: int = 0


def targets(sources: list[Source], repeats: float = REPEATS) -> None:
    """Share the sum of all sizes by weight. A target stops at ``repeats`` times its source's size; its excess is shared again.

    A source stops when a unit of weight is worth more than ``repeats`` times its size over its weight, and each that
    stops makes the unit worth more to the others: so they stop in the order of that quotient.
    """
    left, weight = float(sum(s.size for s in sources)), float(sum(s.weight for s in sources))
    for s in sorted(sources, key=lambda s: s.size / s.weight):
        s.target = min(left * s.weight / weight, float(repeats * s.size))
        left, weight = left - s.target, weight - s.weight


def plan(sizes: list[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS, block: int = BLOCK, blocks: int = BLOCKS) -> list[Source]:
    """Sources by code point, null last, with targets, numbers of blocks and numbers of slots."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    found = [Source(n, int(k or 0), float(weights[i % len(weights)])) for i, (n, k) in enumerate(order)]
    targets(found)
    for s in found:
        s.blocks = min(s.size, max(blocks, -(-s.size // block)))
        s.slots = min(REPEATS * s.blocks, round(s.target * s.blocks / s.size)) if s.size else 0
    return found


@dataclass
class Mix:
    """rows: row, doc_id, source, h, size, source_size, target. pieces: slot, row, doc_id, h, pass, first, length: words of a document in mixing order."""

    rows: DataFrame
    pieces: DataFrame


def per_source(df: DataFrame, sources: list[Source]) -> DataFrame:
    """``df``, which has a row for each source; broadcast where that is few enough, as one source may have most rows."""
    return F.broadcast(df) if len(sources) <= BROADCAST_ROWS else df


def schedule(spark, sources: list[Source]) -> DataFrame:
    """(slot, ix, rank): which source each slot takes from, and how many slots it had before.

    Slot i lies at the fractional part of i over the golden ratio, and takes from the source whose share of the unit
    interval holds that point. Slots beyond a source's number are left out; the few that a source lacks come last.
    """
    n = sum(s.slots for s in sources)
    ends = np.array([(k << 64) // n - 1 for k in accumulate(s.slots for s in sources)], np.uint64) if n else np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in b.column(0).to_pylist():
                slot = np.arange(chunk * SLOTS, min(n, (chunk + 1) * SLOTS), dtype=np.int64)
                ix = np.searchsorted(ends, (slot + 1).astype(np.uint64) * np.uint64(GOLDEN))
                by = np.argsort(ix, kind="stable")
                names, at = np.unique(ix[by], return_index=True)
                parts = np.split(slot[by], at[1:])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), chunk)), pa.array(names.astype(np.int32)), pa.array([len(p) for p in parts], pa.int64()), pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())], names=["chunk", "ix", "n", "slots"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ix, before, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                slot = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.full(len(slot), ix, np.int32)), pa.array(np.arange(before, before + len(slot)))], names=["slot", "ix", "rank"])

    chunks = -(-n // SLOTS)
    dealt = checkpoint(map_arrow(spark.range(0, chunks, 1, max(1, min(chunks, 1000))), run, schema(("chunk", "long"), ("ix", "int"), ("n", "long"), ("slots", "binary"))))
    # one number per source and SLOTS slots; the slots themselves are joined to it
    had_before = F.coalesce(F.sum("n").over(W.Window.partitionBy("ix").orderBy("chunk").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    before = dealt.select("chunk", "ix", had_before.alias("before"))
    out = map_arrow(dealt.join(before, ["chunk", "ix"]).select("ix", "before", "slots"), unpack, schema(("slot", "long"), ("ix", "int"), ("rank", "long")))
    had = {r[0]: r[1] for r in dealt.groupBy("ix").agg(F.sum("n")).collect()}  # one row per source
    wanted = spark.createDataFrame([(i, s.slots) for i, s in enumerate(sources)] or [(-1, 0)], "ix int, wanted long")
    lacks, at = [], n
    for i, s in enumerate(sources):
        if had.get(i, 0) < s.slots:
            lacks.append((i, had.get(i, 0), s.slots - 1, at))
            at += s.slots - had.get(i, 0)
    kept = out.join(per_source(wanted, sources), "ix").where("rank < wanted").select("slot", "ix", "rank")
    if not lacks:
        return kept
    more = spark.createDataFrame(lacks, "ix int, low long, high long, at long").select("ix", "low", "at", F.explode(F.sequence("low", "high")).alias("rank"))
    return kept.unionByName(more.select((F.col("at") + F.col("rank") - F.col("low")).alias("slot"), "ix", "rank"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, size: Column | None = None) -> Mix:
    """Mix all documents so that each source's share of the words nears its target.

    A document's size is its number of words (null text: 0), or ``size``. Each source's documents, in the order of a
    hash, are one stream of words, cut into blocks of equal size; a slot of the schedule takes its source's next block,
    and after the last block the first again. So a source's documents are taken equally often, but for the one at
    which its last pass ends. Null is a source of its own. Rows alike in everything are documents of their own.
    Documents without words, and sources of only such, take no part; an empty table gives empty relations.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", (word_count(F.col("text")) if size is None else size.cast("long")).alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    sums = rows.groupBy("source").agg(F.sum("size")).limit(SOURCES + 1).collect()
    if len(sums) > SOURCES:
        raise ValueError(f"mix: over {SOURCES} sources")
    sources = plan([(r[0], r[1]) for r in sums], weights)
    known = spark.createDataFrame([(i, s.name, s.size, s.target, s.blocks) for i, s in enumerate(sources)] or [(-1, None, 0, 0.0, 0)], "ix int, _source string, source_size long, target double, blocks long")
    placed = running_sum(rows, ["source"], ["h", "doc_id", "size", "row"], "size", "start")
    placed = checkpoint(placed.join(per_source(known, sources), placed["source"].eqNullSafe(known["_source"])).drop("_source"))
    words, extra = F.expr("source_size div blocks"), F.expr("source_size % blocks")  # `extra` blocks have a word more

    def block(word: Column) -> Column:
        return F.when(word < extra * (words + 1), F.floor(word / (words + 1))).otherwise(extra + F.floor((word - extra * (words + 1)) / words)).cast("long")

    def begin(b: Column) -> Column:
        return b * words + F.least(b, extra)

    last = F.col("start") + F.col("size") - 1
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(block(F.col("start")), block(last))))
    b = F.col("block")
    cut = cut.select("ix", "block", "blocks", "row", "doc_id", "h", F.greatest(begin(b) - F.col("start"), F.lit(0)).alias("first"), (F.least(begin(b + 1), last + 1) - F.greatest(begin(b), F.col("start"))).alias("length"))
    slots = schedule(spark, sources).join(per_source(known.select("ix", "blocks"), sources), "ix").select("slot", "ix", F.expr("rank div blocks").alias("pass"), F.expr("rank % blocks").alias("block"))
    pieces = cut.drop("blocks").join(slots, ["ix", "block"]).select("slot", "row", "doc_id", "h", "pass", "first", "length")
    return Mix(placed.select("row", "doc_id", "source", "h", "size", "source_size", "target"), pieces)


def taken(m: Mix) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sums = m.pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    return m.rows.join(sums, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def draw(docs: DataFrame) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: one row for each time that a document is taken.

    A document that its source's last pass takes in part has its first words only, joined by spaces, and their n_chars.
    """
    m = mix(docs)
    times = m.pieces.groupBy("row", "doc_id", "h", "pass").agg(F.sum("length").alias("_words"))
    sized = times.join(m.rows.select("row", F.col("size").alias("_size")), "row")
    lists = sized.groupBy("doc_id", "h").agg(F.collect_list(F.struct("_words", "_size")).alias("_takes"))  # at most REPEATS entries for each row of these keys
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.col("text").alias("_text"), F.xxhash64("doc_id", "text").alias("_h"))
    if not m.rows.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        keyed = keyed.dropDuplicates(["_doc", "_h"])
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("h").alias("_of"), "_takes")
    out = keyed.join(lists, keyed["_doc"].eqNullSafe(lists["_id"]) & (keyed["_h"] == lists["_of"])).select("_row", "_text", F.explode("_takes").alias("_take"))
    part = F.col("_take._words") < F.col("_take._size")
    first = F.array_join(F.slice(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("_take._words").cast("int")), " ")
    out = out.withColumn("_cut", F.when(part, first))
    columns = [F.col("_row").getField(c).alias(c) for c in docs.columns]
    for k, c in enumerate(docs.columns):
        if c == "text":
            columns[k] = F.when(part, F.col("_cut")).otherwise(F.col("_text")).alias(c)
        elif c == "n_chars":
            columns[k] = F.when(part, F.length("_cut").cast(docs.schema[c].dataType)).otherwise(F.col("_row").getField(c)).alias(c)
    return out.select(*columns)
