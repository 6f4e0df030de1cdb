"""SimHash fingerprints, and near-duplicate links found by fuzzy hashing with the binary Golay code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import checkpoint, join_group, map_arrow, narrow_arrow, schema, texts, unique_ids, without_ids
from spanloom.llm.golay import codewords, golay  # noqa: F401
from spanloom.llm.graph import components
from spanloom.llm.shingles import near_copies

#: Bits of the three segments that a fingerprint is cut into, from the top.
SEGMENTS = (22, 21, 21)
#: Bits that fingerprints of a link may differ in. The keys below are made for this number.
NEAR = 3
#: A bucket of more fingerprints than this is cut into blocks, and its pairs of blocks are dealt out as buckets.
BUCKET = 8192
SHINGLES_AT_ONCE = 1 << 15


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of the lower-cased words' ``width``-shingles; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = words[at : min(n, at + SHINGLES_AT_ONCE) + width - 1]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*(part[k:] for k in range(width)), strict=False)], np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, text_hash) for each row; ``fp`` holds the 64 bits as a signed long. Null and blank texts have 0."""
    narrow_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in texts(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], names=["doc_id", "fp", "text_hash"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return map_arrow(rows, run, schema(("doc_id", docs.schema["doc_id"].dataType), ("fp", "long"), ("text_hash", "long")))


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints, as (position, key): two fingerprints at distance NEAR or less share a key.

    Of at most three differing bits, either each segment has one at most: they share codewords of all three segments.
    Or one segment has two or more, and of the others one has none and the other at most one: they share that segment
    itself and a codeword of the other.
    """
    fp = fp.view(np.uint64)
    parts, shift = [], 64
    for bits in SEGMENTS:
        shift -= bits
        parts.append((fp >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64))
    near = [codewords(p) for p in parts]
    (a, ka), (b, kb), (c, kc) = near
    held = ka[:, :, None, None] & kb[:, None, :, None] & kc[:, None, None, :]
    at = np.nonzero(held)
    out = [(at[0], a[at[0], at[1]] << 24 | b[at[0], at[2]] << 12 | c[at[0], at[3]])]
    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                kind += 1
                row, k = np.nonzero(near[j][1])
                out.append((row, np.int64(kind) << 40 | parts[i][row] << 12 | near[j][0][row, k]))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def forest(members: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of the links among fingerprints; each is compared with those not yet reached."""
    left, ends, others = np.unique(members.view(np.uint64)), [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            p = front.pop()
            near = np.bitwise_count(left ^ p) <= NEAR
            if near.any():
                new, left = left[near], left[~near]
                ends.append(np.full(len(new), p))
                others.append(new)
                front.extend(new)
    return ends, others


LINKS = schema(("key", "long"), ("block", "int"), ("a", "long"), ("b", "long"))


def linked(batches: Iterator[pa.RecordBatch], cut: bool = True) -> Iterator[pa.RecordBatch]:
    """Links within each bucket of rows (key, fp) sorted by key. With ``cut``, rows (key, block, a) of what is too large."""

    def batch(key: np.ndarray, block: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        other = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(block.astype(np.int32)), pa.array(a.view(np.int64)), other], names=LINKS.names)

    held_key, held, blocks = None, [], 0

    def emit(groups: list[np.ndarray], pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y = [pairs[:, 0].view(np.uint64)], [pairs[:, 1].view(np.uint64)]  # signed and unsigned together would be floats
        for g in groups:
            ends, others = forest(g)
            x += ends
            y += others
        a, b = np.concatenate(x), np.concatenate(y)
        if len(a):
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            zero = np.zeros(len(both), np.int64)
            yield batch(zero, zero - 1, np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]))

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal held, blocks
        if not held:
            return
        g = np.concatenate(held)
        if blocks:
            yield batch(np.full(len(g), held_key, np.int64), np.full(len(g), blocks), g, None)
        elif len(g) > 1:
            yield from emit([g], np.zeros((0, 2), np.int64))
        held, blocks = [], 0

    for b in batches:
        key, fp = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        edge = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
        if key[0] != held_key:
            yield from close()
        first, last = 0, len(starts) - 1
        if key[0] == held_key:
            held.append(fp[: ends[0]])
            first = 1
            if last:
                yield from close()
        if last >= first:
            s, e = starts[first:last], ends[first:last]
            two = np.flatnonzero(e - s == 2)
            pairs = np.stack([fp[s[two]], fp[s[two] + 1]], axis=1)
            pairs = pairs[np.bitwise_count((pairs[:, 0] ^ pairs[:, 1]).view(np.uint64)) <= NEAR]
            yield from emit([fp[s[i] : e[i]] for i in np.flatnonzero(e - s > 2)], pairs)
            held_key, held, blocks = key[-1], [fp[starts[last] :]], 0
        while cut and sum(map(len, held)) > BUCKET:
            g = np.concatenate(held)
            yield batch(np.full(BUCKET, held_key, np.int64), np.full(BUCKET, blocks), g[:BUCKET], None)
            held, blocks = [g[BUCKET:]], blocks + 1
    yield from close()


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that join the same sets as all links of up to NEAR bits."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 2048):
                row, key = keys(fp[at : at + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at : at + 2048][row])], names=["key", "fp"])

    keyed = map_arrow(distinct.select("fp"), expand, schema(("key", "long"), ("fp", "long")))
    found = checkpoint(map_arrow(keyed.repartition("key").sortWithinPartitions("key"), linked, LINKS))
    edges = found.where("block < 0").select("a", "b").distinct()
    large = found.where("block >= 0")
    if large.isEmpty():
        return edges
    count = large.groupBy("key").agg(F.max("block").alias("last"))
    dealt = large.join(count, "key").select("key", "a", "block", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    dealt = dealt.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("pair"), F.col("a").alias("fp"))
    more = map_arrow(dealt.repartition("pair").sortWithinPartitions("pair"), lambda x: linked(x, cut=False), LINKS)
    return edges.unionByName(more.select("a", "b")).distinct()


def near_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row per input row: doc_id, fp, text_hash, root, component_id (smallest doc_id reachable by links, itself included).

    ``root`` is the component's least fingerprint.

    Rows of equal fingerprints are one node. Null, blank and repeated texts are linked like any other. A null doc_id is
    passed over as a component's name, unless its members have no other. An empty table gives an empty result; other
    columns are not read.
    """
    rows = checkpoint(fingerprints(docs, width))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n_rows")))
    root = components(links(nodes))
    known = nodes.join(root, nodes["fp"] == root["node"], "left").select("fp", "least_id", "n_rows", F.coalesce("root", "fp").alias("root"))
    known = checkpoint(known)
    names = known.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n_nodes"))
    named = checkpoint(join_group(known.select("root", "fp", "n_rows"), checkpoint(names), ["root"], "n_nodes", "fp").select("fp", "n_rows", "root", "component_id"))
    return join_group(rows, named, ["fp"], "n_rows", "doc_id").select("doc_id", "fp", "text_hash", "root", "component_id")


def drop_near(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest doc_id. Columns unchanged, whatever their names.

    Components are those of ``near_copies``: found by longer fingerprints than op1's, as those within NEAR bits miss most
    texts that are alike by 0.8.
    Of rows with that id in one component, one stays; rows of one id in different components stay each.
    """
    groups = near_copies(docs)
    if unique_ids(docs):
        return without_ids(docs, groups.where("doc_id <> component_id"))
    named = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    twice = not named.groupBy("doc_id").count().where("count > 1").isEmpty()
    if twice:
        named = named.groupBy("doc_id", "root").agg(F.min("text_hash").alias("text_hash"))
    stays = named.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_of"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"))
    out = rows.join(stays, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of")), "left_semi")
    return (out.dropDuplicates(["_doc", "_hash"]) if twice else out).select("_row.*")
