"""Prompt blocks, history compaction and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.functions import text
from anamnesis.functions.constants import CONTEXT_BUDGET, CONTEXT_HEADING, CONTEXT_IMPORTANCE, GUIDANCE, HEDGE, HISTORY_KEPT, HISTORY_PART, LINE_CHARS, POLICY, ROUTE_AT
from anamnesis.functions.lifecycle import c


def line() -> Column:
    """A memory as a line of the prompt; low confidence is said."""
    tag = F.when(F.coalesce("id", F.lit(0)) != 0, F.format_string("[%d]", c("id"))).otherwise("[ ]")
    subject = F.when(F.coalesce("subject", F.lit("")) != "", F.concat(F.lit("<"), "subject", F.lit(">")))
    percent = F.bround(F.coalesce("confidence_score", F.lit(0.0)) * 100, 0).cast("int").cast("string")
    hedge = F.when(F.coalesce("confidence_score", F.lit(0.0)) < HEDGE, F.concat(F.lit("(confidence: "), percent, F.lit("%)")))
    return F.concat(F.lit("- "), F.concat_ws(" ", tag, F.concat(F.lit("("), "memory_type", F.lit(")")), subject, text.summary(c("text"), LINE_CHARS), hedge))


def context_lines(results: DataFrame, budget: int = CONTEXT_BUDGET) -> DataFrame:
    """(qid, n, id, line) of results that fit the budget: by score, importance and recency; unimportant ones only where
    nothing else is left; the first always, then as long as the sum stays within the budget."""
    important = F.coalesce("importance", F.lit(0.0)) >= CONTEXT_IMPORTANCE
    any_ = F.max(important).over(Window.partitionBy("qid"))
    rows = results.withColumn("keep", important | ~any_).filter("keep").withColumn("line", line())
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("importance"), F.desc("last_accessed_at"), F.asc("id"))
    used = F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) + len(CONTEXT_HEADING) + 1
    rows = rows.withColumns({"n": F.row_number().over(order), "used": used})
    return rows.filter((c("n") == 1) | (c("used") <= budget)).select("qid", "n", "id", "line")


def context_block(results: DataFrame, budget: int = CONTEXT_BUDGET) -> DataFrame:
    """(qid, block): the heading, the lines and the guidance."""
    lines = context_lines(results, budget).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"))
    return lines.select("qid", F.concat_ws("\n", F.lit(f"{CONTEXT_HEADING}:"), F.array_join(F.col("lines.line"), "\n"), F.lit(GUIDANCE)).alias("block"))


def compacted(turns: DataFrame, kept: int = HISTORY_KEPT) -> DataFrame:
    """(conv_id, n, role, text): the last turns as they are, all before them as one summary, number 0."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns.withColumn("back", F.row_number().over(newest))
    tail = rows.filter(c("back") <= kept).select("conv_id", (kept + 1 - c("back")).alias("n"), "role", "text")
    part = F.concat(F.col("role"), F.lit(": "), F.when(F.length("text") > HISTORY_PART, F.concat(F.substring("text", 1, HISTORY_PART), F.lit("..."))).otherwise(c("text")))
    head = rows.filter(c("back") > kept).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("parts"))
    return head.select("conv_id", F.lit(0).alias("n"), F.lit("system").alias("role"), F.array_join(F.col("parts.part"), "\n").alias("text")).unionByName(tail)


def routed(requests: DataFrame) -> DataFrame:
    """requests (..., text) with the complexity score and the tier of model it goes to."""
    return requests.withColumn("complexity", text.complexity(c("text"))).withColumn("tier", F.when(c("complexity") >= ROUTE_AT, "powerful").otherwise("cheap"))


def by_type(mem: DataFrame) -> DataFrame:
    """(place, memory_type, n, lines): the rows of each type as a table's lines, types in the order of the policy, then others by name."""
    known = F.array(*(F.lit(p[0]) for p in POLICY))
    at = F.array_position(known, c("memory_type"))
    flag = F.when(c("is_archived"), "x").otherwise(" ")
    percent = F.concat(F.bround(F.coalesce("confidence_score", F.lit(0.0)) * 100, 0).cast("int").cast("string"), F.lit("%"))
    why = F.when(c("is_archived"), F.concat(F.lit(" ("), F.coalesce("archived_reason", F.lit("archived")), F.lit(")"))).otherwise("")
    said = F.concat(flag, F.format_string(" #%d ", c("id")), percent, F.format_string(" used %d: ", F.coalesce("access_count", F.lit(0))), text.summary(c("text"), 90), why)
    order = F.struct((-F.coalesce("importance", F.lit(0.0))).alias("i"), c("id"), said.alias("line"))
    rows = mem.groupBy("memory_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(order)).alias("lines"))
    rows = rows.withColumn("place", F.when(at > 0, at).otherwise(len(POLICY) + 1).cast("int"))
    return rows.select("place", "memory_type", "n", F.col("lines.line").alias("lines"))


def table(mem: DataFrame) -> DataFrame:
    """(listing): one text, a heading and the lines of each type."""
    part = F.concat_ws("\n", F.concat(F.upper("memory_type"), F.format_string(" (%d)", c("n"))), F.array_join("lines", "\n"))
    rows = by_type(mem).select("place", "memory_type", part.alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("place", "memory_type", "part")))
    return rows.agg(parts.alias("parts")).select(F.array_join(F.col("parts.part"), "\n\n").alias("listing"))
