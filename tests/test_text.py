"""Text and lifecycle functions against the behaviour they are to have."""

import math

import pytest
from pyspark.sql import functions as F

from anamnesis.functions import lifecycle, text


def value(spark, column, **columns):
    types = ", ".join(f"{k} {t}" for k, (t, _) in columns.items())
    return spark.createDataFrame([tuple(v for _, v in columns.values())], types).select(column.alias("v")).first()["v"]


def said(spark, f, x):
    return value(spark, f(F.col("x")), x=("string", x))


@pytest.mark.parametrize(
    ("given", "want"),
    [("build 1234567 rust", ["build", "rust"]), ("notebook in slot 0", ["notebook", "slot"]), ("", []), (None, []), ("R and c_d: js", ["r", "c", "js"]), ("Straße don't x", ["strasse", "don't"]), ("日本 語", ["日本"])],
)
def test_tokens(spark, given, want):
    assert said(spark, text.tokens, given) == want


def test_identity_tokens(spark):
    assert said(spark, text.identity_tokens, "notebook in slot 0 of 123456") == ["0", "123456"]


def test_canonical_forms(spark):
    hashes = [said(spark, text.norm_hash, t) for t in ("User's name is Krishna.", "user name is krishna", "...", "!!!", "日本", "中国")]
    assert hashes[0] == hashes[1] and len(set(hashes)) == 5
    assert said(spark, text.normalized, "") == ""


@pytest.mark.parametrize(("word", "want"), [("allergies", "allergy"), ("classes", "class"), ("parsers", "parser"), ("bus", "bus"), ("boxes", "box"), ("running", "runn"), ("cat", "cat"), ("quickly", "quick"), ("analysis", "analysis"), ("glasses", "glass")])
def test_stem(spark, word, want):
    assert said(spark, text.stem, word) == want


def test_exact_fold(spark):
    assert said(spark, text.fold_exact, "ＤeveloperSTRAẞE ﬁ") == "developerstrasse fi"


def test_trigrams_and_overlap(spark):
    assert said(spark, lambda x: text.trigrams(text.tokens(x)), "alpha") == ["alp", "lph", "pha"]
    assert said(spark, lambda x: text.trigrams(text.tokens(x)), "js") == ["js"]
    assert value(spark, text.jaccard(text.words("alpha"), text.words("beta")), x=("int", 1)) == 0.0


def test_subject_weights_and_coverage(spark):
    got = {r["token"]: r["weight"] for r in said(spark, text.subject_weights, "tool.package_manager")}
    assert got == {"tool": 0.35, "package": 1.0, "manager": 1.0}
    cover = text.coverage(text.words("pnpm", "npm"), text.tokens(F.col("x")), F.array().cast("array<string>"))
    assert value(spark, cover, x=("string", "prefers pnpm over npm and yarn")) == 1.0


def test_query_terms_keep_the_longest(spark):
    got = said(spark, lambda x: text.query_terms(text.tokens(x)), " ".join("w" * n for n in range(2, 40)))
    assert len(got) == 12 and min(map(len, got)) == 28


@pytest.mark.parametrize(("label", "want"), [("user_preference", "preference"), ("RULE", "instruction"), ("nonsense", "fact"), (None, "fact"), ("User-Todo", "goal"), ("session", "session")])
def test_types(spark, label, want):
    assert said(spark, lifecycle.normalize_type, label) == want


@pytest.mark.parametrize(("given", "want"), [("2024-01-02T03:04:05+00:00", "2024-01-02 03:04:05"), ("2024-01-02T03:04:05", "2024-01-02 03:04:05"), ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("2024-01-02T03:04:05.25+02:00", "2024-01-02 01:04:05"), ("garbage", None), ("", None), (None, None)])
def test_times(spark, given, want):
    assert said(spark, lambda x: F.date_format(lifecycle.parse_time(x), "yyyy-MM-dd HH:mm:ss"), given) == want


def memory(spark, **over):
    row = {"confidence_score": 1.0, "decay_rate": math.log(2) / 21, "importance": 0.0, "access_count": 0, "days": 21.0} | over
    df = spark.createDataFrame([tuple(row.values())], "confidence_score double, decay_rate double, importance double, access_count long, days double")
    return df.withColumn("last_accessed_at", F.timestamp_seconds(F.lit(1_700_000_000) - F.col("days") * 86_400))


NOW = 1_700_000_000


def test_half_life_and_floor(spark):
    now = F.timestamp_seconds(F.lit(NOW))
    assert memory(spark).select(lifecycle.decayed(now)).first()[0] == pytest.approx(0.5, abs=1e-6)
    assert memory(spark, importance=0.95, days=9000.0).select(lifecycle.decayed(now)).first()[0] == pytest.approx(0.35 * 0.95)
    assert memory(spark, days=-5.0).select(lifecycle.decayed(now)).first()[0] == 1.0
    assert memory(spark, days=900.0).select(lifecycle.abandoned(now)).first()[0]


def test_reinforcement(spark):
    now = F.timestamp_seconds(F.lit(NOW))
    got = memory(spark, access_count=6, confidence_score=0.5, days=0.0).select(*lifecycle.reinforced(now, F.lit(3))).first()
    assert got[0] == pytest.approx(0.86) and got[1] == pytest.approx(math.log(2) / 21 * 0.85**2)
    assert memory(spark, access_count=8).select(lifecycle.reinforced(now, F.lit(1))[1]).first()[0] == pytest.approx(math.log(2) / 21)


def test_complexity(spark):
    assert said(spark, text.complexity, "fix the bug") == 1
    assert said(spark, text.complexity, "debug and refactor and explain and build " + "x " * 60 + "```") == 7
