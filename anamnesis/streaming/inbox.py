"""The capture queue as a file stream, and rates over the access log.

capture() checks a row before it lands; drain() takes what has landed in micro-batches, each
handled as a whole by the caller's function. Delivery is at least once: inserting finds
duplicates, so a batch that is seen again changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.functions.constants import INBOX_CHARS
from anamnesis.sources.store import lines_of

SCHEMA = "id long, text string, source string, session_id string, captured_at timestamp"


def checked(rows: DataFrame) -> DataFrame:
    """rows with white space collapsed and why a row cannot be captured: null where it can."""
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    return rows.withColumn("text", flat).withColumn("rejected", F.when(F.length("text") == 0, "empty").when(F.length("text") > INBOX_CHARS, "too long"))


def capture(rows: DataFrame, path: str) -> None:
    """Land the acceptable rows."""
    checked(rows).filter("rejected is null").drop("rejected").write.mode("append").parquet(path)


def capture_one(spark: SparkSession, said: str, path: str, source: str = "cli", session: str | None = None) -> str | None:
    """Lands one text; returns why it cannot be captured, None where it was. Rows of an hour apart, or of two callers, have
    different ids: a random one each."""
    row = spark.createDataFrame([(uuid.uuid4().int >> 65, said, source, session)], "id long, text string, source string, session_id string").withColumn("captured_at", F.current_timestamp())
    why = checked(row).first()["rejected"]
    if why is None:
        capture(row, path)
    return why


def capture_lines(spark: SparkSession, files: str, path: str, source: str = "stdin") -> None:
    """Lands the acceptable lines of text files, as a caller pipes them in."""
    lines = lines_of(spark, files).withColumn("id", F.shiftrightunsigned(F.xxhash64("id", "text", F.lit(uuid.uuid4().hex)), 1))
    capture(lines.select("id", "text", F.lit(source).alias("source"), F.lit(None).cast("string").alias("session_id"), F.current_timestamp().alias("captured_at")), path)


def drain(spark: SparkSession, path: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """All that has landed and was not drained, in the order of capture within a batch."""
    landed = spark.readStream.schema(SCHEMA).parquet(path)
    query = landed.writeStream.foreachBatch(lambda batch, n: handle(batch.orderBy("captured_at", "id"), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drained(batch: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, status, memory_id, note) of a batch: what decide(batch) says of each row, and error for those it lost."""
    said = decide(batch)
    rows = batch.select("id").join(said.select("id", "action", "target"), "id", "left")
    return rows.select("id", F.when(F.col("action").isNull(), "error").otherwise("drained").alias("status"), F.coalesce("target", "id").alias("memory_id"), F.coalesce("action", F.lit("not handled")).alias("note"))


def recall_rates(log: DataFrame, window: str = "1 hour", late: str = "10 minutes", at: Column | None = None) -> DataFrame:
    """(start, query, recalls, avg_score) for each window; on a stream, rows later than `late` are dropped."""
    rows = log.withWatermark("accessed_at", late)
    counted = rows.groupBy(F.window("accessed_at", window), "query").agg(F.count("*").alias("recalls"), F.avg("score").alias("avg_score"))
    return counted.select(F.col("window.start").alias("start"), "query", "recalls", "avg_score")


def reinforcement_stream(log: DataFrame) -> DataFrame:
    """(memory_id, uses) so far, kept as state by memory: each micro-batch gives the rows that changed."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        uses = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((uses,))
        yield pd.DataFrame({"memory_id": [key[0]], "uses": [uses]})

    return log.groupBy("memory_id").applyInPandasWithState(count, "memory_id long, uses long", "uses long", "update", "NoTimeout")
