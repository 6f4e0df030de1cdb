"""Queries that run as streams: their input comes in several runs, each continued from the checkpoint of the one before."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import selection
from spanloom.plans.catalogue import CATALOGUE, query
from spanloom.plans.further import cache, steps
from spanloom.shared import checkpoint, remove, shared_folder
from spanloom.streaming import state

#: Runs that the input is dealt to, and by how much events are late at most.
RUNS, LATE = 3, 12 * 3600


def replayed(rows: DataFrame, over: Callable[[DataFrame], DataFrame], run: str, last: DataFrame | None = None) -> DataFrame:
    """What ``over`` makes of a stream of ``rows``, which come run by run as column ``run`` says, and then of ``last``."""
    spark = rows.sparkSession
    home = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = checkpoint(rows)
    parts = [rows.where(F.col(run) == k).drop(run) for k in range(RUNS)] + ([] if last is None else [last])
    for part in parts:
        part.write.mode("append").parquet(f"{home}/in")
        out = over(spark.readStream.schema(part.schema).parquet(f"{home}/in"))
        writer = out.writeStream.outputMode("append").format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True)
        state.started(out, writer).awaitTermination()
    done = checkpoint(spark.read.schema(out.schema).parquet(f"{home}/out"))
    remove(spark, home)
    return done


@query("narration_stream", "event_id:long book_id:long op:string status:string playing:long", CATALOGUE["narration_states"][2])
def narration_stream(spark, sf):
    """The states of ``narration_states`` from a stream in which events are up to twelve hours late."""
    t = steps(spark, sf).select("event_id", "book_id", F.col("ts").cast("timestamp").alias("ts"), "op", "chunk")
    begin, end = t.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    seen = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(LATE))
    run = F.least(F.lit(RUNS - 1), F.floor((seen - begin) * RUNS / ((end or 0) - (begin or 0) + LATE + 1))).cast("int")
    past = t.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("book_id"), F.timestamp_seconds(F.lit((end or 0) + 10 * LATE)).alias("ts"), F.lit("").alias("op"), F.lit(None).cast(t.schema["chunk"].dataType).alias("chunk"))
    return replayed(t.withColumn("run", run), lambda stream: state.playback_events(stream, f"{2 * LATE} seconds"), "run", past)


@query("published_stream", "book_id:long span_no:long", CATALOGUE["published_results"][2])
def published_stream(spark, sf):
    """The results of ``published_results`` from a stream in which they come in any order, some of them twice."""
    s, _ = cache(spark, sf)
    ready = s.where(F.col("size") % 7 != 0).select("book_id", F.col("span_no").cast("long").alias("span_no"), F.col("size").cast("string").alias("result"))
    run = F.pmod(F.xxhash64("book_id", "span_no"), F.lit(RUNS)).cast("int")
    again = ready.where("span_no % 5 = 0").withColumn("run", F.lit(RUNS - 1))
    return replayed(ready.withColumn("run", run).unionByName(again), state.published_events, "run")
