"""The driver's tables as a store of facts: memories, queries, access log, inbox, vectors, utterances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.functions.constants import POLICY
from anamnesis.functions.lifecycle import decay_rate

NOW = "2024-02-01 00:00:00"
QUERIES = (
    (1, "what inger tion editor"),
    (2, "hest reer anble"),
    (3, "user slot5 tionth rewh"),
    (4, "thre outre dans"),
    (5, "cher zzqx"),
    (6, "!!!"),
    (7, "quantum chromodynamics"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp")


def days_back(c):
    return F.timestamp_seconds(F.unix_timestamp(now()) - c * 86_400)


def policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(POLICY)], "pos long, memory_type string, half_life double, importance double, ttl_days double, user_writable boolean")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as facts; the policy's eight rows are broadcast."""
    d = table(spark, sf_dir, "documents")
    uses = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("access_count"))
    rows = d.join(F.broadcast(policy(spark)), F.pmod(d["doc_id"], F.lit(8)) == F.col("pos")).join(uses, "doc_id", "left")
    created = days_back(F.col("doc_id") * 53 % 1200)
    return rows.select(
        (F.col("doc_id") + 1).alias("id"),
        "text",
        "memory_type",
        (F.lit(0.05) + (F.col("doc_id") % 19) * F.lit(0.05)).alias("confidence_score"),
        decay_rate(F.col("half_life")).alias("decay_rate"),
        "importance",
        "ttl_days",
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("global").alias("scope"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("user.slot"), (F.col("doc_id") % 40).cast("string"))).alias("subject"),
        created.alias("created_at"),
        created.alias("updated_at"),
        days_back(F.col("doc_id") * 37 % 900).alias("last_accessed_at"),
        F.when(F.col("ttl_days").isNotNull(), F.timestamp_seconds(F.unix_timestamp(created) + F.col("ttl_days") * 86_400)).alias("expires_at"),
        (F.col("doc_id") % 11 == 0).alias("is_archived"),
        F.lit(None).cast("long").alias("superseded_by"),
        F.coalesce("access_count", F.lit(0)).alias("access_count"),
        "source",
    )


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUERIES), "qid long, query string")


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") + 1).alias("memory_id"), F.col("ts").cast("timestamp").alias("accessed_at"), F.col("event_type").alias("query"), F.col("value").alias("score")
    )


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.length("text").between(12, 4000))
    status = F.element_at(F.array(F.lit("pending"), F.lit("drained"), F.lit("error")), (F.col("doc_id") % 3 + 1).cast("int"))
    return d.select(F.col("doc_id").alias("id"), "text", "source", F.timestamp_seconds(F.unix_timestamp(now()) - F.col("doc_id") * 60).alias("captured_at"), status.alias("status"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that state facts, one for each customer: the corpus' own conversations hold none."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    place, segment = F.initcap(F.lower("n_name")), F.lower("c_mktsegment")
    name = F.concat(F.lit("Cust"), F.translate((F.col("c_custkey") % 97).cast("string"), "0123456789", "abcdefghij"))
    kinds = (
        F.concat(F.lit("my name is "), name, F.lit(" and I use "), segment),
        F.concat(F.lit("I live in "), place, F.lit(" because of work")),
        F.concat(F.lit("I use "), segment, F.lit(" and yarn")),
        F.concat(F.lit("always check the "), segment, F.lit(" first, I never skip the "), segment, F.lit(" tests")),
    )
    text = F.element_at(F.array(*kinds), (F.col("c_custkey") % 4 + 1).cast("int"))
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("turn_id"), text.alias("text"))


_POLICY = ", ".join(f"({i}, '{n}', {h}::DOUBLE, {imp}::DOUBLE, {'NULL' if t is None else t}::DOUBLE)" for i, (n, h, imp, t, _) in enumerate(POLICY))
#: The same store for DuckDB, as common table expressions.
MEM = f"""policy(pos, memory_type, half_life, importance, ttl_days) AS (VALUES {_POLICY}),
uses AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
mem AS (SELECT doc_id + 1 AS id, text, memory_type, 0.05::DOUBLE + (doc_id % 19) * 0.05::DOUBLE AS confidence_score,
 ln(2::DOUBLE) / greatest(half_life, 0.5::DOUBLE) AS decay_rate, importance, ttl_days,
 CASE WHEN doc_id % 3 = 0 THEN source ELSE 'global' END AS scope,
 CASE WHEN doc_id % 5 = 0 THEN 'user.slot' || (doc_id % 40) END AS subject,
 TIMESTAMP '{NOW}' - to_days((doc_id * 53 % 1200)::INTEGER) AS created_at,
 TIMESTAMP '{NOW}' - to_days((doc_id * 37 % 900)::INTEGER) AS last_accessed_at,
 CASE WHEN ttl_days IS NOT NULL THEN TIMESTAMP '{NOW}' - to_days((doc_id * 53 % 1200)::INTEGER) + to_days(ttl_days::INTEGER) END AS expires_at,
 doc_id % 11 = 0 AS is_archived, coalesce(n, 0) AS access_count, source
 FROM documents JOIN policy ON doc_id % 8 = pos LEFT JOIN uses ON user_id = doc_id),
live AS (SELECT * FROM mem WHERE NOT is_archived)"""
ASKED = "asked(qid, query) AS (VALUES " + ", ".join(f"({i}::BIGINT, '{q}')" for i, q in QUERIES) + ")"
