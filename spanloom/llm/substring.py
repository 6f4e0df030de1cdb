"""Removing passages that repeat across documents: a count-min sketch first, then exact grouping of what it leaves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import map_arrow, narrow_arrow, schema, texts

#: Words of a window, and of the grams by which windows are counted.
WINDOW, GRAM = 50, 16
#: An anchor in more documents than this has its windows dealt out one by one.
HOT = 200
#: Bits of each of the two bitmaps that the merged sketch leaves, at most; both are broadcast.
SKETCH_BITS = 1 << 29
#: Blocks of a row of the sketch: a task hands on so many pieces of it, however large it is.
BLOCKS = 512
#: Anchors, and bytes of window hashes, that a task holds before it hands them on.
ANCHORS_AT_ONCE, BYTES_AT_ONCE = 1 << 20, 32 << 20

BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
ROWS = (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def mixed(x: np.ndarray, k: int = 0) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(MIX[k])
    return x ^ x >> np.uint64(29)


def windows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the words, its anchor and its hash; equal windows have equal ones.

    The anchor is the least of the hashes of the grams in the window. A gram starts at each word, and neighbouring
    windows mostly share their anchor. Hashes of 2, 4, 8, 16 and 32 words are made from two of half the length.
    """
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    of = {1: np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))}
    for k in (1, 2, 4, 8, 16):
        of[2 * k] = of[k][:-k] * power(k) + of[k][k:]
    n = len(words) - WINDOW + 1
    least = mixed(of[GRAM])
    span = WINDOW - GRAM + 1
    for k in (1, 2, 4, 8, 16):
        least = np.minimum(least[:-k], least[k:])
    anchors = np.minimum(least[:n], least[span - 32 : span - 32 + n])
    return anchors, mixed(of[32][:n] * power(18) + of[16][32 : 32 + n] * power(2) + of[2][48 : 48 + n], 1)


def runs_of(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of windows that share their anchor."""
    edge = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
    return np.concatenate([[0], edge]), np.concatenate([edge, [len(anchors)]])


@dataclass
class Sketch:
    """Whether an anchor's estimated number of documents is 2 or more, and over HOT: a bit per cell, a row per hash."""

    bits: int
    rows: int
    repeated: np.ndarray
    hot: np.ndarray

    def cells(self, anchors: np.ndarray, row: int) -> np.ndarray:
        return ((mixed(anchors ^ np.uint64(ROWS[row])) * np.uint64(BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def test(self, bitmap: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        out = np.ones(len(anchors), bool)
        for r in range(self.rows):
            c = self.cells(anchors, r)
            out &= (bitmap[r][c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
        return out


def sketch(docs: DataFrame) -> Sketch:
    """The merged count-min sketch of the anchors of all documents.

    A window's number of documents is at most its anchor's, and a cell's sum at least that: the estimate is never too
    low, and what it calls single is. A task counts the anchors of its documents, adds them up by cell and hands on
    the cells in blocks; a block's sums end at 255 and leave two bits a cell. The sketch has three rows of four cells
    an anchor; where SKETCH_BITS allows no such size, one row of that many cells, and it filters less.
    """
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    wanted = max(1 << 16, 4 * chars // (5 * (WINDOW - GRAM) // 2))
    bits = (wanted - 1).bit_length()
    rows = 3 if 3 << bits <= SKETCH_BITS else 1
    bits = min(bits, SKETCH_BITS.bit_length() - 1)
    shape = Sketch(bits, rows, np.zeros(0), np.zeros(0))
    blocks, block_cells = BLOCKS, (1 << bits) // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            anchors, times = np.unique(np.concatenate(held), return_counts=True)
            for r in range(rows):
                c = shape.cells(anchors, r)
                by = np.argsort(c, kind="stable")
                c, at = np.unique(c[by], return_index=True)
                sums = np.minimum(np.add.reduceat(times[by], at), 255).astype(np.uint8)
                block, at = np.unique(c // block_cells, return_index=True)
                offsets, ends = (c % block_cells).astype("<u4"), [*at[1:], len(c)]
                cols = [pa.array(block + r * blocks), *(pa.array([x[i:j].tobytes() for i, j in zip(at, ends, strict=True)], pa.binary()) for x in (offsets, sums))]
                yield pa.RecordBatch.from_arrays(cols, names=["block", "offsets", "sums"])

        for b in batches:
            for t in texts(b.column(0)):
                anchors, _ = windows(t.split())
                if len(anchors):
                    held.append(np.unique(anchors[runs_of(anchors)[0]]))
                    n += len(held[-1])
            if n >= ANCHORS_AT_ONCE:
                yield from hand_on()
                held, n = [], 0
        if held:
            yield from hand_on()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums = None, np.zeros(block_cells, np.int64)

        def row() -> pa.RecordBatch:
            packed = [np.packbits(x, bitorder="little").tobytes() for x in (sums >= 2, sums > HOT)]
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)], names=["block", "repeated", "hot"])

        for b in batches:
            for block, offsets, add in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block != last:
                    if last is not None and (sums >= 2).any():
                        yield row()
                    last, sums = block, np.zeros(block_cells, np.int64)
                sums[np.frombuffer(offsets, "<u4")] += np.frombuffer(add, np.uint8)
        if last is not None and (sums >= 2).any():
            yield row()

    parts = map_arrow(docs.where("text is not null and doc_id is not null").select("text"), count, schema(("block", "long"), ("offsets", "binary"), ("sums", "binary")))
    merged = map_arrow(parts.repartition("block").sortWithinPartitions("block"), merge, schema(("block", "long"), ("repeated", "binary"), ("hot", "binary")))
    shape.repeated = np.zeros((rows, (1 << bits) // 8), np.uint8)
    shape.hot = np.zeros_like(shape.repeated)
    for r in merged.toLocalIterator():  # SKETCH_BITS / 4 bytes in all, at most
        at = slice(r[0] % blocks * block_cells // 8, (r[0] % blocks + 1) * block_cells // 8)
        shape.repeated[r[0] // blocks, at] = np.frombuffer(r[1], np.uint8)
        shape.hot[r[0] // blocks, at] = np.frombuffer(r[2], np.uint8)
    return shape


RUNS = schema(("doc_id", "long"), ("crc", "long"), ("start", "long"), ("n", "long"))
PARTS = schema(("key", "long"), ("doc_id", "long"), ("crc", "long"), ("start", "long"), ("n", "long"), ("hashes", "binary"))


def repeats(docs: DataFrame) -> DataFrame:
    """Runs of windows that also start in a document with a smaller id: doc_id, crc of the text, start, n."""
    spark = docs.sparkSession
    held_sketch = spark.sparkContext.broadcast(sketch(docs))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of windows whose anchor is estimated repeated, with their hashes.

        Of equal runs in what the task holds, those of the smallest document go on; the others are repeats, and go on
        without hashes. So a passage that very many documents have is few rows.
        """
        sk = held_sketch.value
        held: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        known: list[tuple[int, int, int, int]] = []
        size = 0

        def take(key: int, doc: int, crc: int, start: int, raw: bytes) -> None:
            nonlocal size
            best = held.get((key, raw))
            if best is None:
                held[key, raw] = [(doc, crc, start)]
                size += len(raw) + 200
            elif doc == best[0][0]:
                best.append((doc, crc, start))
                size += 100
            elif doc > best[0][0]:
                known.append((doc, crc, start, len(raw) // 8))
            else:
                known.extend((*x, len(raw) // 8) for x in best)
                held[key, raw] = [(doc, crc, start)]

        def hand_on() -> Iterator[pa.RecordBatch]:
            nonlocal held, known, size
            rows = [(k, *x, len(raw) // 8, raw) for (k, raw), same in held.items() for x in same]
            rows += [(d * BASE & (1 << 63) - 1, d, c, s, n, None) for d, c, s, n in known]
            held, known, size = {}, [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.binary()], strict=True)], names=PARTS.names)

        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                anchors, hashes = windows(t.split())
                if not len(anchors):
                    continue
                begin, end = runs_of(anchors)
                of = anchors[begin]
                some = np.flatnonzero(sk.test(sk.repeated, of))
                if not len(some):
                    continue
                crc, hot = zlib.crc32(t), sk.test(sk.hot, of[some])
                for i, is_hot in zip(some, hot, strict=True):
                    s, e = int(begin[i]), int(end[i])
                    if is_hot:
                        for p, key in zip(range(s, e), mixed(hashes[s:e] ^ of[i]).view(np.int64).tolist(), strict=True):
                            take(key, doc, crc, p, hashes[p : p + 1].tobytes())
                    else:
                        take(int(of[i : i + 1].view(np.int64)[0]), doc, crc, s, hashes[s:e].tobytes())
                if size + 100 * len(known) > BYTES_AT_ONCE:
                    yield from hand_on()
        yield from hand_on()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Among the rows of each key, windows whose hash a smaller document has too, in runs."""

        def judged(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key, doc, crc, start, n = (t.column(i).to_numpy() for i in range(5))
            raw = t.column(5).to_pylist()
            told = np.array([r is None for r in raw], bool)
            out = [np.stack([doc[told], crc[told], start[told], n[told]], axis=1)]
            left = np.flatnonzero(~told)
            if len(left):
                h = np.frombuffer(b"".join(raw[i] for i in left), np.uint64)
                row = np.repeat(left, n[left])
                ends = np.cumsum(n[left])
                pos = np.arange(len(h)) - np.repeat(ends - n[left], n[left]) + start[row]
                by = np.lexsort((doc[row], h, key[row]))
                new = np.ones(len(by), bool)
                new[1:] = (h[by][1:] != h[by][:-1]) | (key[row][by][1:] != key[row][by][:-1])
                least = doc[row][by][np.flatnonzero(new)][np.cumsum(new) - 1]
                again = np.zeros(len(h), bool)
                again[by] = doc[row][by] > least
                at = np.flatnonzero(again)
                if len(at):
                    cut = np.ones(len(at), bool)
                    cut[1:] = (at[1:] != at[:-1] + 1) | (row[at][1:] != row[at][:-1])
                    first = np.flatnonzero(cut)
                    length = np.diff(np.append(first, len(at)))
                    r = row[at][first]
                    out.append(np.stack([doc[r], crc[r], pos[at][first], length], axis=1))
            found = np.concatenate(out)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in range(4)], names=RUNS.names)

        held: list[pa.Table] = []
        for b in batches:
            t = pa.Table.from_batches([b])
            key = t.column(0).to_numpy()
            if not len(key):
                continue
            tail = int(np.searchsorted((key == key[-1]).astype(np.int8), 1))  # where the last key's rows begin
            if held and held[-1].column(0)[0].as_py() != key[0]:
                yield from judged(pa.concat_tables(held))
                held = []
            if tail:
                yield from judged(pa.concat_tables([*held, t.slice(0, tail)]))
                held = []
            held.append(t.slice(tail))
        if held:
            yield from judged(pa.concat_tables(held))

    whole = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = map_arrow(whole, candidates, PARTS)
    return map_arrow(parts.repartition("key").sortWithinPartitions("key"), resolve, RUNS)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (its other words, joined by one space).

    A word is removed when a window of WINDOW words that covers it also starts in a document with a smaller id.
    Windows are judged on the input. Null texts have no words; documents of fewer than WINDOW words keep all. Rows with
    a null id neither remove nor lose words. Rows of the same id never remove from each other; where their texts
    differ, each is judged on its own. Ids are whole numbers; others are an error. An empty table gives an empty result;
    other columns are not read.
    """
    narrow_arrow(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"remove_repeats: doc_id must be a whole number, not {kind.simpleString()}")
    per = repeats(docs).groupBy("doc_id", "crc").agg(F.collect_list(F.struct("start", "n")).alias("runs")).withColumnRenamed("doc_id", "_id").withColumnRenamed("crc", "_crc")
    rows = docs.select("doc_id", "text").withColumn("crc", F.crc32(F.col("text")))
    rows = rows.join(per, (rows["doc_id"] == per["_id"]) & (rows["crc"] == per["_crc"]), "left").select("doc_id", "text", "runs.start", "runs.n")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for t, start, n in zip(texts(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = t.split() if t else []
                n_words.append(len(words))
                if start:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, np.array(start), 1)
                    np.add.at(edge, np.array(start) + np.array(n) + WINDOW - 1, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return map_arrow(rows, cut, schema(("doc_id", kind), ("n_words", "long"), ("n_removed", "long"), ("kept", "string")))
