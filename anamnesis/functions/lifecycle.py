"""Time, confidence and salience as native Columns over the columns of a memory."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from anamnesis.functions.constants import (
    BOOST, DEFAULT_TYPE, FLOOR_SLACK, FLOOR_WEIGHT, IDLE_DAYS, MIN_HALF_LIFE, MIN_RATE, POLICY, RECENCY_DAYS, RELIEF, RELIEF_USES, TYPE_ALIASES,
)


def c(name: str) -> Column:
    return F.col(name)


def is_live() -> Column:
    return ~c("is_archived") & c("superseded_by").isNull()


def clamp(x: Column, default: float = 0.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(default))))


def parse_time(s: Column) -> Column:
    """ISO-8601 with Z, an offset or none (then UTC), or one of two plainer forms; null for anything else."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*(F.try_to_timestamp(s, F.lit(f)) for f in forms))


def days_since(at: Column, now: Column) -> Column:
    """Days up to now, never below 0; 0 for null."""
    return F.coalesce(F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(at)) / 86_400_000_000.0), F.lit(0.0))


def to_iso(at: Column) -> Column:
    """A time as ISO-8601 in UTC, with microseconds where there are some."""
    utc = F.to_utc_timestamp(at, F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(at) % 1_000_000
    return F.concat(whole, F.when(micros != 0, F.format_string(".%06d", F.pmod(micros, F.lit(1_000_000)))).otherwise(""), F.lit("+00:00"))


def plus_days(at: Column, days: Column) -> Column:
    """at and so many days, which may be a fraction; null for null days."""
    return F.timestamp_micros(F.unix_micros(at) + F.round(days * 86_400_000_000.0).cast("long"))


def normalize_type(label: Column) -> Column:
    """A known type for any label: exact, by alias, else by its parts from the right, else fact."""
    known = {name: name for name, *_ in POLICY} | TYPE_ALIASES
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(known.items())))
    key = F.translate(F.lower(F.trim(label)), "- ", "__")
    parts = F.reverse(F.split(key, "_"))
    found = F.filter(F.transform(parts, lambda p: F.element_at(table, p)), lambda p: p.isNotNull())
    return F.coalesce(F.element_at(table, key), F.get(found, F.lit(0)), F.lit(DEFAULT_TYPE))


def decay_rate(half_life: Column) -> Column:
    return F.log(F.lit(2.0)) / F.greatest(half_life, F.lit(MIN_HALF_LIFE))


def floor() -> Column:
    return FLOOR_WEIGHT * F.coalesce(c("importance"), F.lit(0.0))


def decayed(now: Column) -> Column:
    """Confidence at a time: what is above the floor decays, the floor holds."""
    above = F.greatest(F.lit(0.0), c("confidence_score") - floor())
    value = floor() + above * F.exp(-c("decay_rate") * days_since(c("last_accessed_at"), now))
    return F.when(c("confidence_score").isNull(), 1.0).when(c("last_accessed_at").isNull(), c("confidence_score")).otherwise(value)


def idle_limit() -> Column:
    return IDLE_DAYS * (0.5 + clamp(c("importance")))


def abandoned(now: Column) -> Column:
    return (decayed(now) <= floor() + FLOOR_SLACK) & (days_since(c("last_accessed_at"), now) > idle_limit())


def reinforced(now: Column, uses: Column) -> tuple[Column, Column]:
    """(confidence, decay rate) after so many uses at one moment."""
    relief = F.greatest(F.lit(0), F.least(uses, F.lit(RELIEF_USES) - F.coalesce(c("access_count"), F.lit(0))))
    rate = F.when(relief > 0, F.greatest(F.lit(MIN_RATE), c("decay_rate") * F.pow(F.lit(RELIEF), relief))).otherwise(c("decay_rate"))
    return F.least(F.lit(1.0), decayed(now) + BOOST * uses), rate


def recency(now: Column) -> Column:
    return F.exp(-days_since(c("last_accessed_at"), now) / RECENCY_DAYS)


def usage() -> Column:
    return clamp(F.log1p(F.coalesce(c("access_count"), F.lit(0))) / F.log(F.lit(11.0)))


def salience(now: Column) -> Column:
    return 0.40 * clamp(c("confidence_score")) + 0.30 * clamp(c("importance")) + 0.20 * recency(now) + 0.10 * usage()
