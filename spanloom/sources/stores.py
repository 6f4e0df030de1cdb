"""Stored state: bookmarks, indexes, preferences, the audio cache and the voices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Voices by language, sex and name (fixed values).
VOICES = (
    "bf_alice", "bf_emma", "bf_isabella", "bf_lily", "bm_daniel", "bm_fable", "bm_george", "bm_lewis", "af_alloy", "af_aoede", "af_bella", "af_heart",
    "af_jessica", "af_kore", "af_nicole", "af_nova", "af_river", "af_sarah", "af_sky", "am_adam", "am_echo", "am_eric", "am_fenrir", "am_liam",
    "am_michael", "am_onyx", "am_puck", "am_santa",
)
BOOKMARK_STORE = "struct<next_id:int,bookmarks:array<struct<bookmark_id:int,name:string,char_offset:long,chunk_index:int,created_at:string>>>"


def voices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v,) for v in VOICES], "voice string")


def voice_label(v: Column) -> Column:
    """``Emma (British Female)``; a name that is not made so is its own label."""
    parsed = v.rlike("^[ab][fm]_.+")
    region = F.when(v.startswith("b"), "British").otherwise("American")
    sex = F.when(F.substring(v, 2, 1) == "f", "Female").otherwise("Male")
    name = F.substring(v, 4, 100)
    return F.when(parsed, F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 100), F.lit(" ("), region, F.lit(" "), sex, F.lit(")"))).otherwise(v)


def bookmarks_from_json(stores: DataFrame) -> DataFrame:
    """Bookmarks of (book_id, json). A store that is no document has none, and a row without a number or place is dropped."""
    doc = F.from_json("json", BOOKMARK_STORE, {"mode": "PERMISSIVE"})
    rows = stores.select("book_id", F.explode_outer(doc["bookmarks"]).alias("b")).select("book_id", "b.*")
    return rows.where("bookmark_id is not null and char_offset is not null")


def bookmarks_to_json(rows: DataFrame) -> DataFrame:
    """(book_id, json): live bookmarks (book_id, bookmark_id, name, char_offset, chunk_index, created_at) as one document a book, with the next number."""
    row = F.struct(F.col("bookmark_id").cast("int").alias("bookmark_id"), "name", F.col("char_offset").cast("long").alias("char_offset"), F.col("chunk_index").cast("int").alias("chunk_index"), "created_at")
    each = rows.groupBy("book_id").agg((F.max("bookmark_id") + 1).cast("int").alias("next_id"), F.array_sort(F.collect_list(row)).alias("bookmarks"))
    return each.select("book_id", F.to_json(F.struct("next_id", "bookmarks")).alias("json"))


def next_ids(stores: DataFrame) -> DataFrame:
    """(book_id, next_id): above the stored counter's and every number in use."""
    doc = F.from_json("json", BOOKMARK_STORE, {"mode": "PERMISSIVE"})
    used = F.array_max(F.transform(doc["bookmarks"], lambda b: b["bookmark_id"]))
    return stores.select("book_id", F.greatest(F.coalesce(doc["next_id"], F.lit(1)), F.coalesce(used, F.lit(0)) + 1).alias("next_id"))


def latest(log: DataFrame, key: Sequence[str], by: str, tie: str) -> DataFrame:
    """The last row of each key; preferences, positions and job states are kept so."""
    rest = [c for c in log.columns if c not in key]
    best = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(by, tie)).alias("r"))
    return best.select(*key, "r.*")


def without(rows: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``gone``: forgotten books, cached chunks, stale indexes."""
    return rows.join(gone.select(*key).distinct(), list(key), "left_anti")


def audio_path(book: Column, voice: Column, chunk: Column, suffix: str = "wav") -> Column:
    return F.format_string(f"%s/%s/%06d.{suffix}", book.cast("string"), voice, chunk)


def addressed(paths: DataFrame) -> DataFrame:
    """(book, voice, chunk, suffix) of the files of the audio cache (path); other files are none."""
    p = r"^([^/]+)/([^/]+)/([0-9]{6,})\.(wav|align\.json)$"
    part = lambda k: F.regexp_extract("path", p, k)
    return paths.where(F.col("path").rlike(p)).select(part(1).alias("book"), part(2).alias("voice"), part(3).cast("long").alias("chunk"), part(4).alias("suffix"))


def last_paths(log: DataFrame, files: DataFrame) -> DataFrame:
    """(user_id, path): the last book of each user, of saves and clears (user_id, ts, event_id, path; null clears); one whose file (path) is gone is none."""
    last = latest(log, ["user_id"], "ts", "event_id").where("path is not null")
    return last.join(files.select("path").distinct(), "path", "left_semi").select("user_id", "path")


def forgotten(stores: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every store without the books that are forgotten (book_id): audio, bookmarks, positions, the last book's preference."""
    return {name: without(rows, gone, ["book_id"]) for name, rows in stores.items()}
