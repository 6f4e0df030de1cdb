"""Spoken text against time: tokens with their spans, and which of them is heard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from spanloom.operators import asof

#: What a token weighs beside its length, by its last character (fixed values).
PAUSES = (((".", "!", "?"), 6.0), ((",", ";"), 2.5), ((":", "—", "-"), 3.5))


def tokens(texts: DataFrame, key: str, text: str = "speak_text") -> DataFrame:
    """(key, k, token, at, weight): runs of non-blanks with their offsets."""
    pieces = texts.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0))).alias("k", "piece"))
    w = W.Window.partitionBy(key).orderBy("k")
    end = F.sum(F.length("piece")).over(w.rowsBetween(W.Window.unboundedPreceding, 0))
    t = pieces.withColumn("token", F.regexp_replace("piece", r"^\s+", "")).withColumn("at", end - F.length("token"))
    tail = F.expr("substr(token, -1)")
    pause = F.lit(0.0)
    for marks, p in PAUSES:
        pause = F.when(tail.isin(list(marks)), p).otherwise(pause)
    return t.select(key, "k", "token", "at", F.greatest(F.length("token") + pause, F.lit(1.0)).alias("weight"))


def timed(texts: DataFrame, key: str) -> DataFrame:
    """(key, k, start_char, end_char, start_ms, end_ms) for texts (key, speak_text, duration_ms).

    Each token has its share of the duration by weight, rounded half to even and at least a millisecond; what runs over the
    end is cut, and the last token lasts to the end.
    """
    w = W.Window.partitionBy(key)
    t = tokens(texts, key).join(texts.select(key, "duration_ms"), key).where("duration_ms > 0")
    share = F.greatest(F.lit(1), F.bround(F.col("weight") / F.sum("weight").over(w) * F.col("duration_ms"), 0).cast("long"))
    t = t.withColumn("ms", share)
    run = F.sum("ms").over(w.orderBy("k").rowsBetween(W.Window.unboundedPreceding, 0))
    t = t.withColumn("end_ms", F.least(run, F.col("duration_ms"))).withColumn("start_ms", F.least(run - F.col("ms"), F.col("duration_ms")))
    t = t.withColumn("last", F.max("k").over(w)).withColumn("end_ms", F.when(F.col("k") == F.col("last"), F.col("duration_ms")).otherwise(F.col("end_ms")))
    return t.select(key, "k", F.col("at").alias("start_char"), (F.col("at") + F.length("token")).alias("end_char"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"))


def heard(spans: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """Probes (key, ms) with the span that is heard: the one that holds the moment, past the end the last, else the first."""
    ends = spans.groupBy(key).agg(F.min_by(F.struct("start_char", "end_char"), "k").alias("first"), F.max_by(F.struct("start_char", "end_char"), "k").alias("last"), F.max_by("end_ms", "k").alias("until"))
    some = spans.where("end_ms > start_ms").select(key, "start_ms", "end_ms", F.struct("start_char", "end_char").alias("span"))
    t = asof.backward(probes, "ms", some, "start_ms", key).join(ends, key)
    inside = F.when(F.col("ms") < F.col("hit.end_ms"), F.col("hit.span"))
    found = F.coalesce(inside, F.when(F.col("ms") >= F.col("until"), F.col("last")).otherwise(F.col("first")))
    return t.withColumn("f", found).select(key, "ms", F.col("f.start_char").alias("start_char"), F.col("f.end_char").alias("end_char"))


def with_duration(texts: DataFrame, played: str = "played_ms") -> DataFrame:
    """Texts whose duration_ms is that of their audio (frames, sample_rate), to a millisecond; without audio what has played, one at least."""
    audio = F.bround(F.col("frames") / F.col("sample_rate") * 1000.0, 0)
    return texts.withColumn("duration_ms", F.coalesce(F.when(F.col("sample_rate") > 0, audio), F.greatest(F.col(played), F.lit(1))).cast("long"))
