"""Decay sweeps, forecasts, reinforcement and partial updates as plans over memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.functions import lifecycle, text
from anamnesis.functions.constants import ARCHIVE_BELOW, FORECAST_DAYS, WRITE_SKIP
from anamnesis.functions.lifecycle import c
from anamnesis.operators.scans import live


def confidence_now(mem: DataFrame, now: Column) -> DataFrame:
    return live(mem).select("id", lifecycle.decayed(now).alias("confidence"), lifecycle.days_since(c("last_accessed_at"), now).alias("days"))


def sweep(mem: DataFrame, now: Column) -> DataFrame:
    """(id, action, confidence): what one sweep does to each live row."""
    target = lifecycle.decayed(now)
    due = F.coalesce(c("expires_at") <= now, F.lit(False))
    action = (
        F.when(due, "ttl_expired")
        .when(lifecycle.abandoned(now), "idle")
        .when(F.abs(target - c("confidence_score")) < WRITE_SKIP, "none")
        .when(target < ARCHIVE_BELOW, "decayed")
        .otherwise("write")
    )
    return live(mem).select("id", action.alias("action"), target.alias("confidence"))


def sweep_summary(actions: DataFrame) -> DataFrame:
    is_ = lambda *a: F.count_if(c("action").isin(*a))
    return actions.agg(F.count("*").alias("checked"), is_("write", "decayed").alias("decayed"), is_("idle", "decayed").alias("archived"), is_("ttl_expired").alias("expired"))


def swept(mem: DataFrame, now: Column) -> DataFrame:
    """mem after a sweep: a write moves the clock with the confidence, and what goes says why."""
    actions = sweep(mem, now).withColumnRenamed("confidence", "target")
    joined = mem.join(actions, "id", "left").withColumn("action", F.coalesce("action", F.lit("none")))
    gone, wrote = c("action").isin("ttl_expired", "idle", "decayed"), c("action") == "write"
    return joined.withColumns({
        "is_archived": c("is_archived") | gone,
        "archived_reason": F.when(gone, c("action")).otherwise(c("archived_reason")) if "archived_reason" in mem.columns else F.when(gone, c("action")),
        "confidence_score": F.when(wrote, c("target")).otherwise(c("confidence_score")),
        "last_accessed_at": F.when(wrote, now).otherwise(c("last_accessed_at")),
    }).drop("target", "action")


def forecast(mem: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """(id, step, day, confidence) at fixed days ahead, none beyond `days` where that is below 90."""
    base, held = lifecycle.decayed(now), lifecycle.floor()
    rows = live(mem).select("id", "decay_rate", base.alias("current"), held.alias("floor"))
    rows = rows.select("*", F.posexplode(F.array(*(F.lit(float(d if days >= 90 else min(d, days))) for d in FORECAST_DAYS))).alias("step", "day"))
    left = F.greatest(F.lit(0.0), c("current") - c("floor")) * F.exp(-c("decay_rate") * c("day"))
    return rows.select("id", "step", c("day").cast("long").alias("day"), F.round(c("floor") + left, 3).alias("confidence"))


def reinforce(mem: DataFrame, recalls: DataFrame, now: Column) -> DataFrame:
    """(id, confidence_score, decay_rate, access_count) of the rows in recalls (id, n), used n times now."""
    confidence, rate = lifecycle.reinforced(now, c("n"))
    return mem.join(recalls, "id").select("id", confidence.alias("confidence_score"), rate.alias("decay_rate"), (F.coalesce("access_count", F.lit(0)) + c("n")).alias("access_count"))


#: Columns that a patch may set.
PATCHABLE = ("text", "memory_type", "confidence_score", "importance", "subject", "scope", "ttl_days")


def patched(mem: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """mem with the non-null allowed columns of patches (id, ...) in place; confidence and importance stay within 0 and 1,
    an empty text is no text, and a new text has a new hash."""
    allowed = [p for p in PATCHABLE if p in patches.columns]
    new = patches.select("id", *(c(p).alias(f"new_{p}") for p in allowed))
    rows = mem.join(new, "id", "left")
    for p in allowed:
        value = c(f"new_{p}")
        if p in ("confidence_score", "importance"):
            value = F.when(value.isNotNull(), lifecycle.clamp(value))
        if p == "text":
            value = F.when(F.trim(value) != "", value)
        rows = rows.withColumn(p, F.coalesce(value, c(p)))
    touched = F.coalesce(*(c(f"new_{p}").cast("string") for p in allowed)).isNotNull()
    rows = rows.withColumn("updated_at", F.when(touched, now).otherwise(c("updated_at")))
    return rows.withColumn("norm_hash", text.norm_hash(c("text"))).drop(*(f"new_{p}" for p in allowed))
