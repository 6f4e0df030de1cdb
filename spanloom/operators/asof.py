"""As-of joins by one union and one window; no row meets another but its neighbours in the order.

``parts`` over 1 is for keys of very many probes or rows, such as a book that most readers have open: probes and rows
are cut into so many ranges of (key, place), every range finds its hits by itself, and a second pass over one row for each
key and range carries the last and first rows over the ranges' ends. No row is copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from spanloom.shared import checkpoint

#: Probes of a key, or of a range, that one task takes.
PROBES = 1_000_000


def parts_of(probes: DataFrame, key: str) -> int:
    """Ranges that probes are cut into: one where every key's fit a task, else as many as they fill; counts the probes."""
    most, total = probes.groupBy(key).count().agg(F.max("count"), F.sum("count")).first()
    return 1 if (most or 0) <= PROBES else -(-total // PROBES)


def _both(probes: DataFrame, at: str, rows: DataFrame, by: str, key: str) -> DataFrame:
    probe, row = F.struct(*probes.columns), F.struct(*rows.columns)
    types = probes.select(probe.alias("p")).schema["p"].dataType, rows.select(row.alias("r")).schema["r"].dataType
    p = probes.select(F.col(key).alias("_k"), F.col(at).cast("long").alias("_t"), F.lit(1).alias("_side"), probe.alias("_probe"), F.lit(None).cast(types[1]).alias("_row"))
    r = rows.select(F.col(key).alias("_k"), F.col(by).cast("long").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(types[0]).alias("_probe"), row.alias("_row"))
    return p.unionByName(r)


def _ranged(both: DataFrame, parts: int) -> DataFrame:
    """``both`` with its range ``_part``, and the nearest rows of the ranges before and after it, ``_before`` and ``_after``. Probes of one place may be in several ranges."""
    tied = both.withColumn("_h", F.xxhash64("_probe", "_row"))
    t = checkpoint(tied.repartitionByRange(parts, "_k", "_t", "_side", "_h").withColumn("_part", F.spark_partition_id()))
    place = F.when(F.col("_side") == 0, F.struct("_t", "_h"))
    ends = t.groupBy("_k", "_part").agg(F.max_by("_row", place).alias("last"), F.min_by("_row", place).alias("first"))
    w = W.Window.partitionBy("_k").orderBy("_part")  # no more rows than ranges
    before = F.last("last", True).over(w.rowsBetween(W.Window.unboundedPreceding, -1))
    after = F.first("first", True).over(w.rowsBetween(1, W.Window.unboundedFollowing))
    carried = ends.select(F.col("_k").alias("_k2"), F.col("_part").alias("_part2"), before.alias("_before"), after.alias("_after"))
    return t.join(carried, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_part") == F.col("_part2")))


def _hits(probes: DataFrame, at: str, rows: DataFrame, by: str, key: str, parts: int, ways: list[str]) -> DataFrame:
    """Probes with ``hit``: the nearest row by the first of the ways, ``back`` or ``ahead``, that finds one."""
    both, keys, order = _both(probes, at, rows, by, key), ["_k"], ["_t", "_side"]
    if parts > 1:
        both, keys, order = _ranged(both, parts), ["_k", "_part"], [*order, "_h"]
    w = W.Window.partitionBy(*keys).orderBy(*order)
    near: dict[str, list[Column]] = {
        "back": [F.last("_row", True).over(w.rowsBetween(W.Window.unboundedPreceding, 0))] + [F.col("_before")] * (parts > 1),
        "ahead": [F.first("_row", True).over(w.rowsBetween(1, W.Window.unboundedFollowing))] + [F.col("_after")] * (parts > 1),
    }
    return both.withColumn("hit", F.coalesce(*[c for way in ways for c in near[way]])).where("_side = 1").select("_probe.*", "hit")


def backward(probes: DataFrame, at: str, rows: DataFrame, by: str, key: str, clamp: bool = False, parts: int = 1) -> DataFrame:
    """Probes with the last row whose ``by`` is at or below ``at``, as struct ``hit``; with ``clamp`` the first row serves those before it."""
    return _hits(probes, at, rows, by, key, parts, ["back", "ahead"] if clamp else ["back"])


def forward(probes: DataFrame, at: str, rows: DataFrame, end: str, key: str, parts: int = 1) -> DataFrame:
    """Probes with the first row whose ``end`` is above ``at``: of ordered spans the one that holds the offset or starts after it."""
    return _hits(probes, at, rows, end, key, parts, ["ahead"])
