"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import BLANKS, checkpoint, join_group, unique_ids, without_ids

#: Bits of the filter for each group of equal length and prefix hash, and bits at most, which are broadcast: 256 MiB.
BITS_A_KEY, BITS = 32, 1 << 31
#: Bits of a row of the filter, as the engine's bitmaps have them.
ROW = 1 << 15


def normalised(text: Column) -> Column:
    """The text without blanks; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def place(n: Column, head: Column, bits: int) -> Column:
    """The bit of the filter that stands for a length and a prefix hash."""
    return F.pmod(F.xxhash64(n, head), F.lit(bits))


def filter_of(keys: DataFrame) -> tuple[DataFrame, int]:
    """Keys (n, head) as a bitmap in rows (_bucket, _bits), and its number of bits: no key is missed, another one is taken for a key about once in BITS_A_KEY times.

    From BITS / BITS_A_KEY keys (67 million) on it has BITS bits, and takes more for keys, by and by.
    """
    bits = max(ROW, min(BITS, 1 << (BITS_A_KEY * keys.count() - 1).bit_length()))
    at = place(F.col("n"), F.col("head"), bits)
    rows = keys.select(F.floor(at / ROW).alias("_bucket"), (at % ROW).alias("at")).groupBy("_bucket").agg(F.bitmap_construct_agg("at").alias("_bits"))
    return checkpoint(rows), bits


def with_survivors(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows (n, head, ...) with ``_left``: whether the filter holds their key. The filter is broadcast, and no row moves."""
    held, bits = filter_of(keys)
    at = place(F.col("n"), F.col("head"), bits)
    met = rows.withColumn("_at", at).withColumn("_bucket", F.floor(F.col("_at") / ROW)).join(F.broadcast(held), "_bucket", "left")
    byte = F.expr(f"cast(conv(hex(substring(_bits, cast(_at % {ROW} div 8 as int) + 1, 1)), 16, 10) as int)")
    set_ = F.col("_bits").isNotNull() & (byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0)
    return met.withColumn("_left", set_).drop("_at", "_bucket", "_bits")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, digests: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, n_chars, digest.

    Texts are equal when identical without blanks. A first scan takes each row's length and a hash of its first
    ``prefix`` characters, and no more: rows are grouped by length, and those of a length that occurs again by the
    prefix's hash. A second scan hashes the whole texts of the groups that are left. The text stays where it is scanned:
    it meets the keys of these groups as a broadcast filter of bounded size (``filter_of``), which lets through all of
    their rows and few others; those cost a hash and change nothing. ``digests``: the caller wants every row's digest, so
    the second scan makes a column of them, which the groups don't use; else ``digest`` is null for rows that length or
    prefix told apart.

    Of a group the row with the most code points stays, then the one with the smallest id, a null id last; of rows
    alike in both, one. Null texts count as empty, empty texts are equal to one another. Other columns of ``docs`` are
    not read. An empty table gives an empty result.
    """
    text = F.col(text_col)
    length, head = F.length(normalised(text)).alias("n"), F.xxhash64(F.substring(normalised(text), 1, prefix)).alias("head")
    first = checkpoint(docs.select(length, head, F.monotonically_increasing_id().alias("row")))
    lengths = checkpoint(first.groupBy("n").agg(F.count("*").alias("n_same")).where("n_same > 1"))
    heads = join_group(first, lengths, ["n"], "n_same", "row", "left_semi").groupBy("n", "head").agg(F.count("*").alias("n_same")).where("n_same > 1")
    heads = checkpoint(heads)
    again = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(text, F.lit(""))).alias("n_chars"), text.alias("_text"), length, head)
    again = with_survivors(again, heads)
    full = F.when(F.col("_left"), digest(F.col("_text")))
    rows = checkpoint(again.select("doc_id", "n_chars", full.alias("full"), (digest(F.col("_text")) if digests else full).alias("digest")).withColumn("row", F.monotonically_increasing_id()))
    kept = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    groups = rows.where("full is not null").groupBy("full").agg(F.count("*").alias("group_size"), F.min_by(F.struct("doc_id", "row"), kept).alias("keep"))
    groups = checkpoint(groups.where("group_size > 1").withColumn("n_rows", F.col("group_size")))
    # rows without a full hash join nothing: spread them, as nulls of one key would meet in one task
    keyed = rows.withColumn("full", F.coalesce("full", F.col("row").cast("string").cast("binary")))
    out = join_group(keyed, groups, ["full"], "n_rows", "row")
    alone = F.col("keep").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep.row") == F.col("row"))).alias("kept"), F.col("n_chars").cast("long").alias("n_chars"), "digest",
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, its columns unchanged, whatever their names.

    Where ids are unique the dropped ids alone decide. Rows that share an id or have none are told apart by their text.
    """
    if unique_ids(docs):
        return without_ids(docs, exact_groups(docs).where("not kept"))
    stays = exact_groups(docs, digests=True).where("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_of"), F.col("n_chars").alias("_n"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), digest(F.col("text")).alias("_digest"), F.length(F.coalesce("text", F.lit(""))).alias("_chars"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_of")) & (F.col("_chars") == F.col("_n"))
    # rows alike in all three: one of them stays
    return rows.join(stays, same, "left_semi").dropDuplicates(["_doc", "_digest"]).select("_row.*")
