"""Near copies by the Jaccard similarity of word shingles: SimHash and Golay codewords find candidates, the whole sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import checkpoint, join_group, map_arrow, narrow_arrow, schema, small, texts
from spanloom.llm.golay import LENGTH, decoded
from spanloom.llm.graph import components

#: Words of a shingle, and similarity from which two sets are linked.
WIDTH, SIMILAR = 5, 0.8
#: 64-bit fingerprints of a set, and the segments of LENGTH bits that they are cut into, each with a key.
PRINTS = 23
SEGMENTS = PRINTS * 64 // LENGTH
#: Bits that near sets may differ in: of the first FIRST fingerprints, and of the first HELD. Sets at SIMILAR differ in about
#: 15 of 100 bits, small ones in up to 19, which leaves over five standard deviations; others differ in 50.
FIRST, HELD, NEAR_FIRST, NEAR = 2, 4, 48, 84
#: The least set that another can be SIMILAR to.
LEAST = 4
#: Segments whose buckets are searched first. What they join is not told again by the buckets of all.
EARLY = 8
#: In a bucket of more sets than this, each is held against those not yet reached, in a smaller one against all that follow.
FEW = 256
#: A bucket of more sets than this is cut into blocks, and its pairs of blocks are dealt out as buckets; rows and links that are held at once.
BUCKET, ROWS_AT_ONCE, LINKS_AT_ONCE = 8192, 1 << 14, 1 << 20
#: A cluster of candidates with more sets or more shingles than this is cut into blocks, and each two blocks are compared.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 21
AT_ONCE, TEXTS_AT_ONCE = 1 << 10, 32

_draw = np.random.default_rng(42)
PLACES = _draw.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SEEDS = _draw.integers(0, 1 << 63, PRINTS, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> np.uint64(33)) * np.uint64(by)
    return x ^ x >> np.uint64(33)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct WIDTH-shingles of the lower-cased words; a shorter text is one shingle, none without words."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 43)], np.uint64)
    known = {w: xxhash.xxh64_intdigest(w, 42) for w in set(words)}
    h = np.array([known[w] for w in words], np.uint64)
    n = len(words) - WIDTH + 1
    x = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        x += h[k : k + n] * PLACES[k]
    return np.unique(mixed(x))


def votes(found: np.ndarray) -> np.ndarray:
    """For each bit of the fingerprints of a set: members whose hash has it less those whose hash has not. A bit is 1 above 0."""
    ones = np.zeros(PRINTS * 64, np.int64)
    for at in range(0, len(found), AT_ONCE):
        hashes = mixed(found[at : at + AT_ONCE, None] ^ SEEDS)
        ones += np.add.reduce(np.unpackbits(hashes.view(np.uint8), axis=1), axis=0, dtype=np.uint16)
    return 2 * ones - len(found)


def simhashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first HELD fingerprints of each set, and the codewords that its segments decode to."""
    held, words = [np.zeros((0, HELD), np.int64)], [np.zeros((0, SEGMENTS), np.uint16)]
    for at in range(0, len(sets), TEXTS_AT_ONCE):
        of = np.array([votes(s) for s in sets[at : at + TEXTS_AT_ONCE]])
        held.append(np.packbits(of[:, : HELD * 64] > 0, axis=1).view(np.int64))
        words.append(decoded(of.reshape(-1, LENGTH)).reshape(-1, SEGMENTS).astype(np.uint16))
    return np.concatenate(held), np.concatenate(words)


def forest(nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among sets; each is compared with those not yet reached."""
    nodes, first = np.unique(nodes, return_index=True)
    sets = [sets[i] for i in first]
    size = np.array([len(s) for s in sets])
    _, member = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(member.max() + 1, bool)
    left, edges = np.arange(len(nodes)), []
    held, begins = member, starts[:-1]
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        stale = True
        while front and len(left):
            if stale:  # the members of those not yet reached, one set after another
                held = np.concatenate([member[starts[i] : starts[i + 1]] for i in left])
                begins = np.concatenate([[0], np.cumsum(size[left])[:-1]])
            p = front.pop()
            mine = member[starts[p] : starts[p + 1]]
            mark[mine] = True
            both = np.add.reduceat(mark[held], begins, dtype=np.int64)
            mark[mine] = False
            near = 5 * both >= 4 * (size[p] + size[left] - both)  # SIMILAR, in whole numbers
            stale = bool(near.any())
            if stale:
                new, left = left[near], left[~near]
                edges += [(nodes[p], nodes[i]) for i in new]
                front.extend(new)
    return edges


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each pair of blocks, from rows (pair, node, members) sorted by pair."""
    at, nodes, sets = None, [], []

    def close() -> Iterator[pa.RecordBatch]:
        if len(nodes) > 1:
            edges = np.array(forest(np.array(nodes, np.int64), sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    for b in batches:
        for pair, node, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if pair != at:
                yield from close()
                at, nodes, sets = pair, [], []
            nodes.append(node)
            sets.append(np.frombuffer(members.as_buffer(), np.uint64).copy())
    yield from close()


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, size, prints, words) for each row: ``node`` is a hash of the set, one for all sets that are equal.

    ``prints`` and ``words`` are those of ``simhashes``, null for sets of fewer than LEAST members.
    """
    narrow_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t) for t in texts(b.column(1))]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), 44) if len(s) else 0 for s in found], np.uint64).view(np.int64)
            prints, words = (iter(x) for x in simhashes([s for s in found if len(s) >= LEAST]))
            packed = [pa.array([next(x).tobytes() if len(s) >= LEAST else None for s in found], pa.binary()) for x in (prints, words)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(nodes), pa.array([len(s) for s in found], pa.int64()), *packed], names=["doc_id", "text_hash", "node", "size", "prints", "words"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return map_arrow(rows, run, schema(("doc_id", docs.schema["doc_id"].dataType), ("text_hash", "long"), ("node", "long"), ("size", "long"), ("prints", "binary"), ("words", "binary")))


HELD_NAMES = [f"p{k}" for k in range(HELD)]
MEMBERS = schema(("key", "long"), ("node", "long"), *((n, "long") for n in HELD_NAMES))
CANDIDATES = schema(("key", "long"), ("block", "int"), ("node", "long"), ("other", "long"), *((n, "long") for n in HELD_NAMES))


def unpack(batches: Iterator[pa.RecordBatch], segments: int) -> Iterator[pa.RecordBatch]:
    """Rows of MEMBERS, ``segments`` for each set (node, prints, words): a key is a segment and the codeword that it decodes to."""
    for b in batches:
        rows = [r for r in zip(*(c.to_pylist() for c in b.columns), strict=True) if r[1]]
        if rows:
            words = np.array([np.frombuffer(w, np.uint16, segments) for _, _, w in rows], np.int64)
            members = np.array([[n, *np.frombuffer(p, np.int64)] for n, p, _ in rows], np.int64)
            members = np.repeat(members, segments, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array((words | np.arange(segments) << 12).ravel()), *(pa.array(np.ascontiguousarray(c)) for c in members.T)], names=MEMBERS.names)


def stars(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same of ``n`` rows as the links (a, b): each row that has any, with the first that it is joined to."""
    first = np.arange(n)
    while True:
        x, y = first[a], first[b]
        if (x == y).all():
            break
        np.minimum.at(first, np.maximum(x, y), np.minimum(x, y))
        while (first[first] != first).any():
            first = first[first]
    at = np.flatnonzero(first != np.arange(n))
    return at, first[at]


def differing(prints: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits rows ``a`` and ``b`` differ, from fingerprints one after another."""
    n = np.zeros(len(a), np.uint16)
    for p in prints:
        n += np.bitwise_count(p[a] ^ p[b])
    return n


def reached(node: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as all near pairs of rows; each row is held against those not yet reached, so that near copies take one round."""
    at, rest, a, b = np.arange(len(node)), prints, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(at) > 1:
        front, at, rest = [at[0]], at[1:], rest[:, 1:]
        while front and len(at):
            p = front.pop()
            near = np.bitwise_count(rest[:FIRST] ^ prints[:FIRST, p, None]).sum(axis=0, dtype=np.uint16) <= NEAR_FIRST
            near[near] = np.bitwise_count(rest[:, near] ^ prints[:, p, None]).sum(axis=0, dtype=np.uint16) <= NEAR
            new = at[near]
            a.append(np.full(len(new), p))
            b.append(new)
            near |= node[at] == node[p]
            if near.any():
                front.extend(at[near].tolist())
                at, rest = at[~near], rest[:, ~near]
    return np.concatenate(a), np.concatenate(b)


def alike(key: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as all pairs of one key whose fingerprints differ in NEAR bits at most, NEAR_FIRST in the first few.

    Rows are sorted by key and node. Each is held against the first row of another node that follows, then against the
    second, and so on; in buckets of more than FEW rows, against those not yet reached.
    """
    prints = np.ascontiguousarray(members[:, 1:].T).view(np.uint64)
    _, starts, counts = np.unique(key, return_index=True, return_counts=True)
    ends = np.repeat(starts + counts, counts)
    node = members[:, 0]
    last = np.flatnonzero(np.append((key[1:] != key[:-1]) | (node[1:] != node[:-1]), True)) if len(key) else starts
    other = np.repeat(last + 1, np.diff(last, prepend=-1))
    at, a, b, held = np.flatnonzero(np.repeat(counts <= FEW, counts)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while len(at):
        at = at[other[at] < ends[at]]
        near = at[differing(prints[:FIRST], at, other[at]) <= NEAR_FIRST]
        near = near[differing(prints, near, other[near]) <= NEAR]
        a.append(near)
        b.append(other[near])
        other[at] += 1
        held += len(near)
        if held > LINKS_AT_ONCE:
            a, b = ([x] for x in stars(len(key), np.concatenate(a), np.concatenate(b)))
            held = 0
    many = np.flatnonzero(counts > FEW)
    for start, count in zip(starts[many].tolist(), counts[many].tolist(), strict=True):
        if node[start] != node[start + count - 1]:
            x, y = reached(node[start : start + count], prints[:, start : start + count])
            a.append(start + x)
            b.append(start + y)
    return stars(len(key), np.concatenate(a), np.concatenate(b))


def candidates(batches: Iterator[pa.RecordBatch], bucket: int | None, rows: int, hand_on: bool = True) -> Iterator[pa.RecordBatch]:
    """Links (node, other) that join the same nodes as those within the buckets, from MEMBERS sorted by key and node.

    A task's links are told as stars around the least nodes, which in other tasks are mostly the same. Buckets of more
    than ``bucket`` rows, if it is given, are handed on as rows (key, block, node, prints), or else searched block by
    block. About ``rows`` are held at once.
    """

    def batch(key: np.ndarray, block: int, members: np.ndarray, other: np.ndarray | None = None) -> pa.RecordBatch:
        columns = [pa.array(key), pa.array(np.full(len(key), block, np.int32)), pa.array(np.ascontiguousarray(members[:, 0]))]
        columns.append(pa.nulls(len(key), pa.int64()) if other is None else pa.array(other))
        columns += [pa.nulls(len(key), pa.int64()) if other is not None else pa.array(np.ascontiguousarray(members[:, k])) for k in range(1, 1 + HELD)]
        return pa.RecordBatch.from_arrays(columns, names=CANDIDATES.names)

    links = [np.zeros((0, 2), np.int64)]

    def told() -> Iterator[pa.RecordBatch]:
        nodes, at = np.unique(np.concatenate(links), return_inverse=True)
        a, b = (nodes[x] for x in stars(len(nodes), *at.reshape(-1, 2).T))
        del links[1:]
        if len(a):
            yield batch(np.zeros(len(a), np.int64), -1, a[:, None], b)

    def emit(key: np.ndarray, members: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = alike(key, members)
        links.append(np.stack([members[a, 0], members[b, 0]], axis=1))
        if sum(map(len, links)) > LINKS_AT_ONCE:
            yield from told()

    def cut(key: np.ndarray, block: int, members: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from [batch(key, block, members)] if hand_on else emit(key, members)

    held, n, large, blocks = [], 0, None, 0

    def settle(last: bool) -> Iterator[pa.RecordBatch]:
        """Deals with what is held but the rows of its last key, which may go on, and with these too if they are the last."""
        nonlocal held, n, large, blocks
        key, members = np.concatenate([k for k, _ in held]), np.concatenate([m for _, m in held])
        if large is not None:
            end = int(np.searchsorted(key, large, "right"))
            if end == len(key) and not last:
                for at in range(0, end - bucket + 1, bucket):
                    yield from cut(key[at : at + bucket], blocks, members[at : at + bucket])
                    blocks += 1
                rest = end % bucket
                held, n = [(key[end - rest :], members[end - rest :])], rest
                return
            for at in range(0, end, bucket):
                to = min(at + bucket, end)
                yield from cut(key[at:to], blocks, members[at:to])
                blocks += 1
            key, members, large, blocks = key[end:], members[end:], None, 0
        tail = len(key) if last else int(np.searchsorted(key, key[-1])) if len(key) else 0
        if bucket:  # buckets of more rows than ``bucket``, of which the last may be one
            _, starts, counts = np.unique(key[:tail], return_index=True, return_counts=True)
            for start, count in zip(starts[counts > bucket].tolist(), counts[counts > bucket].tolist(), strict=True):
                for block, at in enumerate(range(start, start + count, bucket)):
                    to = min(at + bucket, start + count)
                    yield from cut(key[at:to], block, members[at:to])
            few = np.repeat(counts <= bucket, counts)
        else:
            few = np.ones(tail, bool)
        yield from emit(key[:tail][few], members[:tail][few])
        held, n = [(key[tail:], members[tail:])], len(key) - tail
        if bucket and n > bucket:
            large = key[-1]

    for b in batches:
        if b.num_rows:
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held.append((columns[0], np.stack(columns[1:], axis=1)))
            n += b.num_rows
            if n >= 2 * max(rows, bucket or 0):
                yield from settle(last=False)
    if held:
        yield from settle(last=True)
    yield from told()


def near_fingerprints(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join the same nodes (node, prints, words) as all pairs with a codeword in one segment in common and near fingerprints.

    The nodes of a large group meet in most segments, and each bucket would tell of them all again. So the first EARLY
    segments are searched alone, within blocks; in the search of all, nodes go by the least that they are joined to, rows of
    one such node are not compared, and pairs of blocks that hold but one are left out.
    """
    bucket, rows = BUCKET, ROWS_AT_ONCE

    def search(members: DataFrame, most: int | None, hand_on: bool) -> DataFrame:
        return map_arrow(members.repartition("key").sortWithinPartitions("key", "node"), lambda x: candidates(x, most, rows, hand_on), CANDIDATES)

    def members(nodes: DataFrame, segments: int) -> DataFrame:
        return map_arrow(nodes.select("node", "prints", "words"), lambda x: unpack(x, segments), MEMBERS)

    def edges(found: DataFrame) -> DataFrame:
        return found.where("block < 0").select(F.col("node").alias("a"), F.col("other").alias("b"))

    root = checkpoint(components(edges(search(members(nodes, EARLY), bucket, False))).where("node <> root"))
    known = nodes.join(F.broadcast(root) if small(root) else root, "node", "left").select(F.coalesce("root", "node").alias("node"), "prints", "words")
    found = checkpoint(search(members(known, SEGMENTS), bucket, True))
    joined = root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(edges(found))
    large = found.where("block >= 0").drop("other")
    if large.isEmpty():
        return joined
    blocks = checkpoint(large.groupBy("key", "block").agg(F.min("node").alias("least"), F.max("node").alias("most")))
    x, y = blocks.alias("x"), blocks.alias("y")
    two = x.join(y, F.expr("x.key = y.key and x.block <= y.block and (least(x.least, y.least) < greatest(x.most, y.most))"))
    sides = two.select("x.key", F.explode(F.array_distinct(F.array("x.block", "y.block"))).alias("block"), F.xxhash64("x.key", "x.block", "y.block").alias("pair"))
    dealt = large.join(sides, ["key", "block"]).select(F.col("pair").alias("key"), "node", *HELD_NAMES)
    return joined.unionByName(edges(search(dealt, None, True)))


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that join the same sets as all links between nodes (node, size, prints, words, first), where first is (doc_id, text_hash) of a row."""
    root = components(near_fingerprints(nodes))
    held = checkpoint(nodes.join(root, "node").select("node", "size", "root", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_of")))
    parts = held.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("m"))
    parts = parts.select("root", "n", F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("m") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    asked = checkpoint(join_group(held, checkpoint(parts), ["root"], "n", "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([shingles(t).tobytes() for t in texts(b.column(3))], pa.binary())], names=["node", "root", "blocks", "members"])

    rows = docs.select(F.col("doc_id").alias("_doc"), "text", F.xxhash64("text").alias("_hash"))
    near = F.broadcast(asked) if small(asked) else asked
    rows = rows.join(near, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of"))).select("node", "root", "blocks", "text")
    sets = map_arrow(rows, run, schema(("node", "long"), ("root", "long"), ("blocks", "int"), ("members", "binary")))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (x != F.col("block")) | (F.col("blocks") == 1)))
    dealt = sets.withColumn("block", block).withColumn("other", other).select(F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("pair"), "node", "members")
    return map_arrow(dealt.repartition("pair").sortWithinPartitions("pair"), linked, schema(("a", "long"), ("b", "long")))


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, text_hash, root, component_id (smallest doc_id reachable by links, itself included).

    Two texts are linked when the Jaccard similarity of their sets of shingles is SIMILAR or more, decided on the whole
    sets, as 64-bit hashes, of those that SimHash finds near. Rows of equal sets are one node; texts without words are alike. A null doc_id is passed over
    as a component's name, unless its members have no other. An empty table gives an empty result.
    """
    rows = checkpoint(keyed(docs))
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    nodes = checkpoint(rows.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n_rows"), F.first("size").alias("size"), F.first("prints").alias("prints"), F.first("words").alias("words"), first))
    root = components(links(docs, nodes))
    known = checkpoint(nodes.join(root, "node", "left").select("node", "least_id", "n_rows", F.coalesce("root", "node").alias("root")))
    names = known.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n_nodes"))
    named = checkpoint(join_group(known.select("root", "node", "n_rows"), checkpoint(names), ["root"], "n_nodes", "node").select("node", "n_rows", "root", "component_id"))
    return join_group(rows.drop("size", "prints", "words"), named, ["node"], "n_rows", "doc_id").select("doc_id", "text_hash", "root", "component_id")
