"""Vectors as short codes: each part of a vector by the nearest entry of its position's codebook."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import checkpoint, join_group, map_arrow, narrow_arrow, schema, whole_vectors

#: Parts of a vector, entries of a codebook at most, rounds of refinement, and steps of a unit.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a tree's leaf, and rows that are searched at once.
LEAF, AT_ONCE = 4, 8192
#: What rounding may take from a distance or add to a radius, as a share of it.
ROOM = 1e-9


class BallTree:
    """Nearest entries by branch and bound: a ball is visited unless all of it is farther than the best so far.

    Radii are rounded up and distances to centres down, and a ball that may hold an equal distance is visited; the
    distances that decide are of whole numbers. Ties go to the lower index, so results are those of a full comparison.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        self.root = self._node(np.arange(len(entries)))

    def _node(self, at: np.ndarray) -> tuple:
        x = self.entries[at]
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()) * (1 + ROOM) + ROOM
        width = x.max(axis=0) - x.min(axis=0)
        if len(at) <= LEAF or not width.any():
            return centre, radius, np.sort(at), None
        order = np.argsort(x[:, int(width.argmax())], kind="stable")
        half = len(at) // 2
        return centre, radius, None, (self._node(at[order[:half]]), self._node(at[order[half:]]))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row."""
        x = x.astype(np.int64)
        best, index = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)

        def near_edge(node: tuple, rows: np.ndarray) -> np.ndarray:
            """Least distance that an entry of the ball can have."""
            return np.maximum(np.sqrt(((x[rows] - node[0]) ** 2).sum(axis=1)) * (1 - ROOM) - node[1], 0)

        def visit(node: tuple, rows: np.ndarray) -> None:
            if node[2] is not None:
                d = ((x[rows, None, :] - self.entries[node[2]]) ** 2).sum(axis=2)
                k = d.argmin(axis=1)  # the lowest index of those alike
                d, i = d[np.arange(len(rows)), k], node[2][k]
                better = (d < best[rows]) | ((d == best[rows]) & (i < index[rows]))
                best[rows[better]], index[rows[better]] = d[better], i[better]
                return
            edges = [near_edge(child, rows) for child in node[3]]
            first = edges[1] < edges[0]
            for turn in (0, 1):  # each row's nearer ball, then its other one
                for side in (0, 1):
                    mine = (first == side) if turn == 0 else (first != side)
                    open_ = mine & (edges[side] ** 2 * (1 - ROOM) <= best[rows])
                    if open_.any():
                        visit(node[3][side], rows[open_])

        if len(x):
            visit(self.root, np.arange(len(x)))
        return index, best


def assign(books: np.ndarray, trees: list[BallTree], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) indices of the nearest entries and their squared distances, of vectors (rows, dimensions)."""
    parts = x.reshape(len(x), len(books), -1)
    found = [tree.nearest(parts[:, p]) for p, tree in enumerate(trees)]
    return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = AT_ONCE) -> Iterator[pa.Table]:
    """The batches in tables of about so many rows."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def vectors_in(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), -1).astype(np.int64)


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry as the floor of the mean of the parts nearest to it; unused entries stay. Tasks hand on sums, at most one for each number of the codebooks."""
    parts, size, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(b) for b in books]
        sums, counts = np.zeros((parts * size, width), np.int64), np.zeros(parts * size, np.int64)
        for t in gathered(batches):
            x = vectors_in(t["whole"])
            index, _ = assign(books, trees, x)
            at = (index + np.arange(parts) * size).ravel()
            np.add.at(sums, at, x.reshape(-1, width))
            counts += np.bincount(at, minlength=parts * size)
        used = np.flatnonzero(counts)
        cols = [np.repeat(used, width), np.tile(np.arange(width), len(used)), sums[used].ravel(), np.repeat(counts[used], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["slot", "place", "total", "n"])

    sums = map_arrow(rows.select("whole"), run, schema(*[(c, "long") for c in ("slot", "place", "total", "n")]))
    found = sums.groupBy("slot", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()  # a row for each number of the codebooks
    out = books.reshape(parts * size, width).copy()
    slot, place, total, n = (found[c].to_numpy() for c in ("slot", "place", "total", "n"))
    out[slot, place] = total // n  # rounds down
    return out.reshape(books.shape)


def whole_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """``vectors`` with ``whole`` in place of ``embedding``: floor(scale * x) of each component, as 32-bit numbers. Rows without a usable vector are left out."""
    narrow_arrow(vectors.sparkSession)
    names = [c for c in vectors.columns if c != "embedding"]
    kinds = [(c, vectors.schema[c].dataType) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], whole_vectors(b.columns[-1], scale)], names=[*names, "whole"])

    return map_arrow(vectors.select(*names, "embedding"), run, schema(*kinds, ("whole", "binary"))).where("whole is not null")


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(parts, entries, numbers of a part) codebooks of rows (vec_id, whole): the parts of the smallest ids, refined ``rounds`` times.

    Fewer rows than ``entries`` give as many entries. Null ids come last, rows of one id in the order of their numbers.
    """
    first = rows.select("vec_id", "whole").orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).toArrow()
    start = vectors_in(first["whole"])
    books = start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = refined(rows, books)
    return books


def named(books: np.ndarray) -> str:
    """SHA-256 of all numbers of the codebooks, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each usable row of (vec_id, embedding, label), and the codebooks.

    Components become floor(scale * x). ``code`` has a byte for each part: the index of the entry nearest to it, found
    in a ball tree over the position's entries; ``error`` is the sum of the squared distances. The codebooks, of bounded
    size, are all that the driver holds; rows are read once for each round and once for their codes.

    Rows whose vector is null or has a null or non-finite component are left out, as are vectors without components.
    Rows alike, or of the same or no id, are rows of their own; labels may be null. Vectors of several lengths, of a
    length that the parts don't divide, or with numbers beyond common.LARGEST are an error. An empty table gives an empty result.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index takes a byte")
    rows = checkpoint(whole_rows(vectors.select("vec_id", "label", "embedding"), scale).where("length(whole) > 0"))
    least, most = rows.agg(F.min(F.length("whole")), F.max(F.length("whole"))).first()
    if least != most or (most or 0) % (4 * parts):
        raise ValueError(f"vectors must have one length, a multiple of {parts}: found {(least or 0) // 4} to {(most or 0) // 4}")
    kinds = [vectors.schema[c].dataType for c in ("vec_id", "label")]
    out = schema(("vec_id", kinds[0]), ("label", kinds[1]), ("code", "binary"), ("error", "long"))
    books = codebooks(rows, parts, entries, rounds) if most else np.zeros((parts, 0, 0), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(b) for b in books] if most else []
        for t in gathered(batches):
            index, error = assign(books, trees, vectors_in(t["whole"]))
            codes = [c.tobytes() for c in index.astype(np.uint8)]
            done = pa.table([t["vec_id"], t["label"], pa.array(codes, pa.binary()), pa.array(error.sum(axis=1))], names=["vec_id", "label", "code", "error"])
            yield from done.combine_chunks().to_batches()

    return map_arrow(rows, run, out), books


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(vec_id, embedding) that rows (vec_id, code) stand for: the middle of each step of their entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, len(books)) if b.num_rows else np.zeros((0, len(books)), np.uint8)
            x = (books[np.arange(len(books)), index].reshape(b.num_rows, -1) + 0.5) / scale
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["vec_id", "embedding"])

    kind = codes.schema["vec_id"].dataType.simpleString()
    return codes.select("vec_id", "code").mapInArrow(run, f"vec_id {kind}, embedding array<double>")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` and label_error: the error summed over the rows of the same label, nulls together. A label may hold any share of the rows."""
    rows = checkpoint(codes.withColumn("_none", F.col("label").isNull()).withColumn("_label", F.coalesce(F.col("label").cast("string"), F.lit(""))))
    sums = checkpoint(rows.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")))
    spread = rows.withColumn("_at", F.monotonically_increasing_id())
    return join_group(spread, sums, ["_none", "_label"], "_n", "_at", "inner").drop("_none", "_label", "_at")
