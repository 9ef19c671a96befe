"""Scans, statistics and ordered lookups over memories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.functions.lifecycle import c, is_live


def ranked(rows: DataFrame, *order, limit: int | None = None) -> DataFrame:
    """rows in this order with their rank from 1; limit is the feature's own."""
    rows = rows.orderBy(*order).limit(limit) if limit else rows
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def live(mem: DataFrame) -> DataFrame:
    return mem.filter(is_live())


def live_ranked(mem: DataFrame, limit: int) -> DataFrame:
    """The pool: live rows by confidence, then last use, then id."""
    return ranked(live(mem), F.desc("confidence_score"), F.desc("last_accessed_at"), F.asc("id"), limit=limit)


def by_type(mem: DataFrame, kind: str, limit: int) -> DataFrame:
    return ranked(live(mem).filter(c("memory_type") == kind), F.desc("confidence_score"), F.asc("id"), limit=limit)


def in_scope(mem: DataFrame, scope: str) -> DataFrame:
    return mem.filter(c("scope").isin(scope, "global"))


def by_subject(mem: DataFrame, subject: str, scope: str | None = None) -> DataFrame:
    found = live(mem).filter(c("subject") == subject)
    return in_scope(found, scope) if scope else found


def archived(mem: DataFrame, limit: int) -> DataFrame:
    return ranked(mem.filter("is_archived"), F.desc("updated_at"), F.asc("id"), limit=limit)


def expired(mem: DataFrame, now) -> DataFrame:
    return live(mem).filter(c("expires_at") <= now)


def get_many(mem: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The rows with these ids and each one's place in the list; the list is the caller's."""
    wanted = mem.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], "pos int, id long")
    return mem.join(F.broadcast(wanted), "id")


def all_rows(mem: DataFrame) -> DataFrame:
    """Live and archived, each id once."""
    return live(mem).unionByName(mem.filter("is_archived")).dropDuplicates(["id"])


def totals(mem: DataFrame) -> DataFrame:
    on = is_live()
    return mem.agg(
        F.count_if(on).alias("live"),
        F.coalesce(F.sum(F.when(on, c("access_count"))), F.lit(0)).alias("recalls"),
        F.round(F.avg(F.when(on, c("confidence_score"))), 3).alias("avg_confidence"),
        F.count_if(c("is_archived")).alias("archived"),
    )


def count_by_type(mem: DataFrame) -> DataFrame:
    return live(mem).groupBy("memory_type").agg(F.count("*").alias("n"))


def most_used(mem: DataFrame, n: int = 5) -> DataFrame:
    return ranked(live(mem), F.desc("access_count"), F.desc("confidence_score"), F.asc("id"), limit=n)


def inbox_counts(inbox: DataFrame) -> DataFrame:
    names = inbox.sparkSession.createDataFrame([("pending",), ("drained",), ("error",)], "status string")
    return names.join(inbox.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def last_recalls(log: DataFrame, limit: int = 20) -> DataFrame:
    """The newest rows of the access log for each memory."""
    newest = Window.partitionBy("memory_id").orderBy(F.desc("id"))
    return log.withColumn("rank", F.row_number().over(newest)).filter(c("rank") <= limit)


def report(mem: DataFrame) -> DataFrame:
    return mem.agg(
        F.count("*").alias("rows"),
        F.count_if(is_live()).alias("live"),
        F.count_if(c("subject").isNotNull()).alias("with_subject"),
        F.date_format(F.max(F.when(is_live(), c("created_at"))), "yyyy-MM-dd HH:mm:ss").alias("newest"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"),
    )


def grep(texts: DataFrame, needle: str) -> DataFrame:
    """(name, line, text): the lines of each text that hold needle in any case."""
    lines = texts.select("name", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return lines.filter(F.contains(F.lower("content"), F.lit(needle.lower()))).select("name", (c("line") + 1).alias("line"), F.trim("content").alias("content"))
