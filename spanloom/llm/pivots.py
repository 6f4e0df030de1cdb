"""Near-duplicate vectors through an index of pivot permutations."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import checkpoint, join_group, map_arrow, narrow_arrow, schema
from spanloom.llm.graph import components

#: Least cosine of a link.
NEAR = 0.98
#: Nearest pivots that describe a vector. Two vectors must share two of them to be compared.
NEAREST = 6
#: Pivots, at most (what a billion nodes take; beyond, lists only grow); vectors in a block of a list.
PIVOTS, BLOCK = 1 << 16, 4096
#: Pivots lie farther apart than this cosine; candidates that are looked at together.
APART, AT_ONCE = 0.9, 1024


def unit(raw) -> np.ndarray | None:
    """The vector at length 1, in double precision; None if null, zero, or with a null or non-finite component."""
    if raw is None or any(x is None for x in raw):
        return None
    v = np.array(raw, np.float64)
    top = np.abs(v).max() if len(v) else 0.0
    if not np.isfinite(top) or top == 0:
        return None
    v = v / top
    return v / np.sqrt(v @ v)


def units(raw: list[bytes], numbers: str) -> np.ndarray:
    """The rows at length 1, from vectors of one length as they are shuffled; the same as ``unit`` of each."""
    v = np.frombuffer(b"".join(raw), numbers).reshape(len(raw), -1).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return np.stack([x / np.sqrt(x @ x) for x in v])


def choose_pivots(sample: list[np.ndarray], n: int) -> dict[int, np.ndarray]:
    """Up to ``n`` pivots for each number of dimensions: vectors of the sample, apart from one another."""
    out = {}
    for dim in {len(v) for v in sample}:
        of = np.array([v for v in sample if len(v) == dim])
        taken, k = np.zeros((min(n, len(of)), dim)), 0
        for at in range(0, len(of), AT_ONCE):
            some = of[at : at + AT_ONCE]
            free = (some @ taken[:k].T).max(axis=1, initial=-1.0) < APART
            for v in some[free]:
                if k < len(taken) and (taken[:k][-AT_ONCE:] @ v).max(initial=-1.0) < APART:
                    taken[k] = v
                    k += 1
        out[dim] = taken[:k].copy()
    return out


def nearest(pivots: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The NEAREST pivots of each row of ``v``, nearest first."""
    along = v @ pivots.T
    n = min(NEAREST, len(pivots))
    some = np.argpartition(-along, n - 1, axis=1)[:, :n]
    order = np.argsort(-np.take_along_axis(along, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1).astype("<i4")


def pivots_of(chosen: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """The pivots; of a number of dimensions that the sample lacks, directions that a seed draws."""
    return chosen[dim] if dim in chosen else np.random.default_rng(dim).standard_normal((64, dim))


def compare(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, second: int) -> np.ndarray:
    """Which pairs are linked, of those that share both pivots of a list, the larger being ``second``: their cosine is NEAR or more.

    A pair that shares more pivots meets in several lists, and counts in the one of its two smallest.
    """
    near = x @ y.T >= NEAR
    i, j = np.nonzero(near)
    if sx.shape[1] > 1 and len(i):
        smaller = ((sx[i][:, :, None] == sy[j][:, None, :]) & (sx[i][:, :, None] < second)).sum(axis=(1, 2))
        near[i, j] = smaller == 1
    return near


def links_in(second: int, node: np.ndarray, weight: np.ndarray, side: np.ndarray, v: np.ndarray, sig: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Of one block, or of two against one another: (node, other rows that it is linked to), and edges that join what is linked."""
    first, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(other):
        hit = compare(v, v, sig, sig, second)
        np.fill_diagonal(hit, False)
    else:
        hit = np.zeros((len(node), len(node)), bool)
        cross = compare(v[first], v[other], sig[first], sig[other], second)
        hit[np.ix_(first, other)] = cross
        hit[np.ix_(other, first)] = cross.T
    n = hit @ weight
    degrees = [(int(node[i]), int(n[i])) for i in np.flatnonzero(n)]
    edges, left = [], hit.any(axis=1)
    for i in np.flatnonzero(left):
        if left[i]:
            front = [i]
            left[i] = False
            while front:
                k = front.pop()
                new = np.flatnonzero(hit[k] & left)
                left[new] = False
                edges += [(int(node[k]), int(node[j])) for j in new]
                front.extend(new)
    return degrees, edges


def near_vectors(vectors: DataFrame) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Only vectors of one label and one length are compared. Rows alike in label and vector are one node with so many
    rows, and are linked to one another. A node is described by its NEAREST pivots in order; those are sampled from
    the nodes by a hash, about twice the root of their number. Inverted lists are kept for each two pivots, label by
    label: a node is in the lists of all twos of its pivots, so nodes that share two or more pivots meet, and lists
    grow shorter as pivots grow in number. Lists hold no vectors until it is known which nodes meet others; then a vector
    is copied once for each such list. Only a list of over BLOCK nodes is dealt in blocks, every one against every other,
    so that none is cut short and none falls to one task. Cosines are in double precision, and only the number of links
    and a spanning forest leave the block. The index can miss pairs; it never makes a false one.

    Rows with a null label, and null, zero or non-finite vectors, link with nothing and are components of their own. A
    null vec_id names a component only if it is alone in it. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    narrow_arrow(spark)
    kind = vectors.schema["vec_id"].dataType
    numbers = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [None if unit(r) is None else np.array(r, numbers).tobytes() for r in b.column(2).to_pylist()]
            names = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "label", "key", "raw"])

    label = vectors.schema["label"].dataType
    keyed = map_arrow(vectors.select("vec_id", "label", "embedding"), key, schema(("vec_id", kind), ("label", label), ("key", "binary"), ("raw", "binary")))
    rows = checkpoint(keyed.withColumn("row", F.monotonically_increasing_id()))
    nodes = checkpoint(rows.where("label is not null and key is not null").groupBy("label", "key").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n_rows"), F.first("raw").alias("raw")).withColumn("node", F.monotonically_increasing_id()))
    n = nodes.count()
    wanted = min(PIVOTS, max(NEAREST, math.ceil(2 * math.sqrt(n))))
    drawn = nodes.select("key", "raw").orderBy(F.xxhash64("key"), "key").limit(2 * wanted).toArrow()
    chosen = choose_pivots([units([r], numbers)[0] for r in drawn["raw"].to_pylist()], wanted)
    held = spark.sparkContext.broadcast(chosen)  # PIVOTS vectors of each length, at most

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.array([len(r) for r in b.column(2).to_pylist()], np.int64) // np.dtype(numbers).itemsize
            for dim in np.unique(dims).tolist():
                mine = b.take(pa.array(np.flatnonzero(dims == dim)))
                sigs = nearest(pivots_of(held.value, dim), units(mine.column(2).to_pylist(), numbers))
                low = np.sort(sigs, axis=1)
                twos = list(combinations(range(sigs.shape[1]), 2)) or [(0, 0)]
                at = pa.array(np.repeat(np.arange(len(sigs)), len(twos)))
                table = pa.table([*mine.columns[:2], pa.array([s.tobytes() for s in sigs], pa.binary())], names=["node", "label", "sig"]).take(at)
                for name, values in (("dim", np.full(len(at), dim)), ("pivot", low[:, [i for i, _ in twos]].ravel()), ("second", low[:, [j for _, j in twos]].ravel())):
                    table = table.append_column(name, pa.array(values.astype(np.int32)))
                yield from table.combine_chunks().to_batches()

    fields = schema(("node", "long"), ("label", label), ("sig", "binary"), ("dim", "int"), ("pivot", "int"), ("second", "int"))
    lists = ["label", "dim", "pivot", "second"]
    listed = checkpoint(map_arrow(nodes.select("node", "label", "raw"), describe, fields))
    lengths = listed.groupBy(*lists).agg(F.count("*").alias("n_list")).where("n_list > 1")
    lengths = checkpoint(lengths.withColumn("blocks", F.ceil(F.col("n_list") / BLOCK).cast("int")))
    placed = join_group(listed, lengths, lists, "n_list", "node", "inner").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(F.xxhash64(*lists, F.least("block", "other"), F.greatest("block", "other")).alias("pair"), (F.col("block") > F.col("other")).cast("int").alias("side"), *lists, "node", "sig")
    met = met.join(nodes.select("node", "n_rows", "raw"), "node")  # only now, and only of nodes that meet others

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def close() -> Iterator[pa.RecordBatch]:
            degrees, edges = [], []
            if held:
                t = pa.concat_tables(held)
                columns = [t[c].to_numpy() for c in ("second", "pivot", "dim", "label", "pair")]
                order = np.lexsort(columns)
                columns = [x[order] for x in columns]
                second = columns[0]
                edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
                node, rows, side = (t[c].to_numpy()[order] for c in ("node", "n_rows", "side"))
                raw, sigs = t["raw"].to_pylist(), t["sig"].to_pylist()
                for g in np.split(np.arange(len(order)), edge):
                    if len(g) > 1:
                        v = units([raw[order[i]] for i in g], numbers)
                        sig = np.stack([np.frombuffer(sigs[order[i]], "<i4") for i in g])
                        d, e = links_in(int(second[g[0]]), node[g], rows[g], side[g], v, sig)
                        degrees += d
                        edges += e
            held.clear()
            if degrees or edges:
                cols = [pa.array([0] * len(degrees) + [1] * len(edges), pa.int32()), pa.array([x[0] for x in degrees + edges], pa.int64()), pa.array([x[1] for x in degrees + edges], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["is_edge", "a", "b"])

        for b in batches:
            t = pa.Table.from_batches([b])
            pair = t["pair"].to_numpy()
            if not len(pair):
                continue
            if held and held[-1]["pair"][-1].as_py() != pair[0]:
                yield from close()
            tail = int(np.searchsorted((pair == pair[-1]).astype(np.int8), 1))
            if tail:
                held.append(t.slice(0, tail))
                yield from close()
            held.append(t.slice(tail))
        yield from close()

    found = checkpoint(map_arrow(met.repartition("pair").sortWithinPartitions("pair"), meet, schema(("is_edge", "int"), ("a", "long"), ("b", "long"))))
    degrees = found.where("is_edge = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n_other"))
    roots = components(found.where("is_edge = 1").select("a", "b"))
    known = nodes.select("label", "key", "node", "least_id", "n_rows").join(roots, "node", "left").join(degrees, "node", "left").select("label", "key", "least_id", "n_rows", F.coalesce("root", "node").alias("root"), (F.coalesce("n_other", F.lit(0)) + F.col("n_rows") - 1).alias("n_links"))
    known = checkpoint(known)
    names = checkpoint(known.groupBy("root").agg(F.min("least_id").alias("component"), F.count("*").alias("n_nodes")))
    named = checkpoint(join_group(known, names, ["root"], "n_nodes", "key").select("label", "key", "n_rows", "n_links", "component"))
    out = join_group(rows.drop("raw"), named, ["label", "key"], "n_rows", "row")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
