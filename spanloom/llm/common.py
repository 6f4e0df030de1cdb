"""What several operators share: checkpoints, skew-safe joins, running sums, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from spanloom.shared import checkpoint  # noqa: F401

#: A word: a run of anything but the space and the five control characters TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters between words.
BLANKS = " \t\n\x0b\x0c\r"
#: Groups of more rows than this are salted when rows are joined to their group; at most so many groups are.
HOT_ROWS, HOT_GROUPS = 10_000, 50_000
#: Most rows that a side may have to be broadcast; each caller's rows are under 200 bytes.
BROADCAST_ROWS = 100_000
#: Whole numbers of a vector beyond this are an error: their products must fit 64 bits.
LARGEST = 1 << 24


def narrow_arrow(spark: SparkSession, rows: int = 256) -> None:
    """Texts cross to Python in batches of few rows, so that long ones do not add up in a worker's memory.

    The setting is the session's, and is read when a plan runs. Every operator asks for the same, so that the order in
    which plans are built changes nothing, and a smaller number that the user has set stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(c: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def schema(*fields: tuple[str, T.DataType | str]) -> T.StructType:
    """A schema of (name, type); usable on executors, where no session parses type names."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType()}
    return T.StructType([T.StructField(n, kinds[t] if isinstance(t, str) else t) for n, t in fields])


def texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def whole_vectors(column: pa.Array, scale: int) -> pa.Array:
    """Arrays of numbers as the 32-bit floors of ``scale`` times each, in double precision; null where an array is null or has a null or non-finite component."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
    fit = np.isfinite(flat)
    ends = np.cumsum(sizes)
    flawed = np.concatenate([[0], np.cumsum(~fit)])
    usable = (flawed[ends] == flawed[ends - sizes]) & column.is_valid().to_numpy(zero_copy_only=False)
    q = np.floor(scale * np.where(fit & np.repeat(usable, sizes), flat, 0))
    if len(q) and np.abs(q).max() > LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}")
    raw = q.astype("<i4")
    return pa.array([raw[e - n : e].tobytes() if ok else None for e, n, ok in zip(ends.tolist(), sizes.tolist(), usable.tolist(), strict=True)], pa.binary())


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most so many rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def hot_rows(total: int, least: int | None = None) -> int:
    """Rows above which a group counts as hot, of ``total`` rows: no more than HOT_GROUPS groups can have so many."""
    return max(HOT_ROWS if least is None else least, -(-total // HOT_GROUPS))


def join_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: str, how: str = "left", least: int | None = None) -> DataFrame:
    """Join each row to its group, where one group may hold any share of the rows.

    ``groups`` has one row per key, and its rows' number in column ``size``; pass it checkpointed, as it is read three
    times. Hot groups, of over HOT_ROWS rows or ``least``, are dealt to salts of about so many; their keys are broadcast,
    HOT_GROUPS at most. Column ``spread`` of ``rows`` picks the salt. The group's columns but ``keys`` and ``size`` follow those of
    the row.
    """
    largest, total = groups.agg(F.max(size), F.sum(size)).first()
    each = hot_rows(total or 0, least)
    if (largest or 0) <= each:
        return rows.join(groups.drop(size), keys, how)
    salts = F.ceil(F.col(size) / each).cast("int")
    hot = groups.where(F.col(size) > each).select(*keys, salts.alias("_salts"))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int"))
    dealt = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop(size)
    return salted.drop("_salts").join(dealt, [*keys, "_salt"], how).drop("_salt")


def unique_ids(docs: DataFrame) -> bool:
    """Whether no doc_id is null or comes twice."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty()


def without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in ``gone`` (doc_id), columns unchanged. Few ids are broadcast, and then no text moves."""
    gone = checkpoint(gone.select(F.col("doc_id").alias("_gone")))
    if small(gone):
        gone = F.broadcast(gone)
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"))
    return rows.join(gone, F.col("_doc") == F.col("_gone"), "left_anti").select("_row.*")


def running_sum(df: DataFrame, part: list[str], order: list[str], value: str, out: str, rows: int = 1_000) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one in its part, in the order of ``order``.

    ``order[0]`` is a 64-bit hash. Rows are bucketed by its leading bits, so many that a bucket holds about ``rows``
    rows, or a millionth of all, whatever the size of its part; only bucket sums are added up part by part, a million at
    most in each. Pass a checkpointed ``df``: it is read three times. Equal hashes fall in one bucket.
    """
    total = df.count()
    bits = min(20, max(0, (max(1, total // rows) - 1).bit_length()))
    bucket = (F.shiftrightunsigned(F.col(order[0]), 64 - bits) if bits else F.lit(0)).cast("long")
    keyed = df.withColumn("_bucket", bucket)
    sums = keyed.groupBy(*part, "_bucket").agg(F.sum(value).alias("_sum"))
    # one row per bucket and part
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(W.Window.partitionBy(*part).orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inner = W.Window.partitionBy(*part, "_bucket").orderBy(F.shiftrightunsigned(F.col(order[0]), 1), *order).rowsBetween(W.Window.unboundedPreceding, -1)
    local = keyed.withColumn("_local", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    on = [local[c].eqNullSafe(before[c]) for c in [*part, "_bucket"]]
    hit = on[0]
    for c in on[1:]:
        hit = hit & c
    return local.join(before, hit).select(*[local[c] for c in df.columns], (F.col("_before") + F.col("_local")).cast("long").alias(out))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], out: T.StructType) -> DataFrame:
    return df.mapInArrow(run, out)
