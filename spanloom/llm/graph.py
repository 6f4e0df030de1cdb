"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import checkpoint, join_group

#: Edges of a node, 16 bytes each, that one task may join; edges of a partition, at least, of what a round hands on.
EDGES, PARTITION = 1 << 20, 1 << 16


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b), where root is the smallest node reachable.

    Alternates the two star operations: each node hands its larger neighbours, then its smaller ones, to the smallest
    node it knows. Every round leaves at most as many edges as nodes; the rounds grow with the logarithm of the
    longest path. Each round is checkpointed, in as many partitions as its edges ask for. After a few rounds the root of a large component has all its members for
    neighbours: while there are so many edges that a node can be hot, rows meet their node salted. Edges with a null end
    and loops are ignored.
    """
    e = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v and a is not null and b is not null").distinct())
    seen = None
    for _ in range(rounds):
        mark = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        few = max(1, 2 * mark[0] // PARTITION)  # each round has no more edges than the one before, but for one for each node
        e = e.coalesce(few)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        many = 2 * mark[0] > EDGES  # else no node has so many neighbours
        met = join_group(both, checkpoint(least), ["u"], "n", "v", "inner", EDGES) if many else both.join(least.drop("n"), "u")
        large = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        known = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        if many:
            large, known = checkpoint(large), checkpoint(known)
        met = join_group(large, known, ["u"], "n", "v", "inner", EDGES) if many else large.join(known.drop("n"), "u")
        down = met.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(down.unionByName(known.select("u", F.col("m").alias("v"))).distinct().coalesce(few))
    else:
        raise RuntimeError(f"components: no end after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
