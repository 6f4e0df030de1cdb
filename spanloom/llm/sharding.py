"""Shards of bounded size by extendible hashing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import checkpoint, map_arrow, running_sum, schema

#: Bytes of text in a shard, at most.
LIMIT = 64 << 20
#: Bits of the hash, and bits by which the buckets that are too large are counted anew at each step.
BITS, STEP = 60, 8
#: Buckets that the directory may have; the driver and every worker hold 21 bytes for each.
DIRECTORY = 1 << 22


@dataclass
class Directory:
    """Buckets in the order of their prefixes: the hash at which each begins, its depth, and whether it is chained."""

    begins: np.ndarray
    depths: np.ndarray
    chained: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, h, side="right") - 1


def settled(prefix: np.ndarray, sums: tuple[np.ndarray, ...], top: int, depth: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which depth each part of the finest counts comes to rest at, if any: the least at which its bucket fits, or can't be split.

    ``sums`` are bytes, rows, least and largest hash of the parts, by prefixes of ``depth`` bits in order. Returned are
    the depths (-1: over the limit still), whether the bucket is over the limit and of one hash, and the first part of each bucket.
    """
    b, n, lo, hi = sums
    at, chained, first = np.full(len(prefix), -1, np.int8), np.zeros(len(prefix), bool), np.zeros(len(prefix), bool)
    for d in range(top, depth + 1):
        p = prefix >> (depth - d)
        begin = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, int)
        size, rows = np.add.reduceat(b, begin), np.add.reduceat(n, begin)
        one = (rows == 1) | (np.minimum.reduceat(lo, begin) == np.maximum.reduceat(hi, begin))
        rests = (size <= limit) | one
        of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(p))))
        new = rests[of] & (at < 0)
        at[new], chained[new] = d, ((size > limit) & (rows > 1))[of][new]
        first[begin] |= new[begin]
    return at, chained, first


def directory(rows: DataFrame, limit: int) -> Directory:
    """The buckets that hold rows.

    All documents are one bucket of depth 0. A bucket over ``limit`` is split on its next bit, and only such a one. One
    document, or documents of one hash, can't be split: the bucket stays, and is chained if it is over the limit.
    """
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    top, depth = 0, min(20, (max(1, total // limit) - 1).bit_length() + 2)
    left, held = rows, 0
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        # sums of the open buckets' parts: no more than 2^STEP for each bucket over the limit
        parts = left.groupBy(F.shiftright("h", BITS - depth).alias("p")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).limit(DIRECTORY + 1).toArrow()
        if len(parts) + held > DIRECTORY:
            raise ValueError(f"directory: over {DIRECTORY} buckets; raise the limit of {limit} bytes")
        by = np.argsort(parts["p"].to_numpy(), kind="stable")
        prefix, *sums = (parts[c].to_numpy()[by] for c in ("p", "b", "n", "lo", "hi"))
        at, chained, first = settled(prefix, tuple(sums), top, depth, limit)
        d = at[first].astype(np.int64)
        found.append((prefix[first] >> (depth - d) << (BITS - d), d.astype(np.int32), chained[first]))
        held += int(first.sum())
        still = prefix[at < 0]
        if not len(still):
            break
        few = rows.sparkSession.createDataFrame(pa.table({"p": still}))  # DIRECTORY rows, at most
        left = left.withColumn("p", F.shiftright("h", BITS - depth)).join(F.broadcast(few), "p", "left_semi").drop("p")
        top, depth = depth, min(BITS, depth + STEP)
    begins, depths, chained = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.argsort(begins, kind="stable")
    return Directory(begins[by], depths[by], chained[by])


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, depth, bucket, chain: the shard is the last three together.

    ``bucket`` is the prefix of ``depth`` bits of a hash of the id. ``chain`` counts on where documents of one hash
    (repeated ids, or null ones) pass the limit together; else it is 0. Only a document that is larger than the limit
    makes a larger shard, alone in its chain. Null texts have no bytes. Other columns are not read; an empty table
    gives an empty result.
    """
    return placed(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), limit).drop("row")


def placed(docs: DataFrame, limit: int) -> DataFrame:
    """``shards`` of documents (doc_id, text, row), with the number ``row`` that tells each row from all others."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = checkpoint(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long").alias("h"), F.xxhash64("text").alias("t"), "row"))
    leaves = directory(rows, limit)
    held = docs.sparkSession.sparkContext.broadcast(leaves)  # DIRECTORY buckets, at most

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value
        for b in batches:
            h = b.column(2).to_numpy(zero_copy_only=False)
            at = of.find(h)
            columns = (of.depths[at], h >> (BITS - of.depths[at].astype(np.int64)), of.chained[at])
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, columns)], names=[*b.schema.names, "depth", "bucket", "chained"])

    kind = docs.schema["doc_id"].dataType
    found = map_arrow(rows, find, schema(("doc_id", kind), ("n_bytes", "long"), ("h", "long"), ("t", "long"), ("row", "long"), ("depth", "int"), ("bucket", "long"), ("chained", "boolean")))
    plain = found.where("not chained").select("doc_id", "n_bytes", "depth", "bucket", F.lit(0).cast("long").alias("chain"), "row")
    if not leaves.chained.any():
        return plain
    one = checkpoint(found.where("chained").drop("chained"))
    # documents of one hash lie one after another, spread by row; each half limit begins a new link, and so does each large document
    one = one.withColumn("load", F.greatest("n_bytes", F.lit(1))).withColumn("order", F.xxhash64("t", "row"))
    laid = running_sum(one, ["depth", "bucket"], ["order", "row"], "load", "before")
    half = max(1, limit // 2)
    large = F.col("n_bytes") > half
    chain = F.expr(f"before div {half}") * 2 + large.cast("long")
    own = F.when(large, F.xxhash64("row", "t")).otherwise(F.lit(0))
    return plain.unionByName(laid.select("doc_id", "n_bytes", "depth", "bucket", F.when(large, -1 - F.abs(own % (1 << 40))).otherwise(chain).cast("long").alias("chain"), "row"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write ``docs`` as Parquet, a folder for each shard and one file in each. Each row goes to its own shard, whatever its id.

    The rows are numbered and checkpointed first, so that each finds its shard by its number.
    """
    whole = checkpoint(docs.select(F.struct("*").alias("_all"), F.monotonically_increasing_id().alias("_at")))
    of = placed(whole.select("_all.doc_id", "_all.text", F.col("_at").alias("row")), limit).select("row", F.concat_ws("-", "depth", "bucket", "chain").alias("shard"))
    whole.join(of, F.col("_at") == F.col("row")).select("_all.*", "shard").repartition("shard").write.partitionBy("shard").parquet(path)
