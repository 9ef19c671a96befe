"""Operators over memories: behaviour, invariants and plain-Python versions of the greedy parts."""

import math
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from anamnesis.functions import text
from anamnesis.operators import context, extract, lifecycle, retrieval, scans, similarity, vectors, writes
from anamnesis.plans.memories import policy
from anamnesis.sources.store import Store, migrated, text_files
from anamnesis.sources.paths import work_dir
from anamnesis.streaming import inbox

NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def store(spark, rows):
    """rows: (id, text, type, subject, confidence, days since use)."""
    df = spark.createDataFrame(rows, "id long, text string, memory_type string, subject string, confidence_score double, days double")
    df = df.join(policy(spark), "memory_type").withColumn("decay_rate", F.log(F.lit(2.0)) / F.col("half_life"))
    at = F.timestamp_seconds(F.unix_timestamp(now()) - F.col("days") * 86_400)
    return migrated(df.withColumns({"created_at": at, "last_accessed_at": at}).drop("pos", "half_life", "user_writable", "days"))


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, query string")


NOTES = [(i, f"reviewed dashboard metric {i}", "event", None, 1.0, 1.0) for i in range(100, 130)]


@pytest.fixture(scope="module")
def mem(spark):
    return store(spark, [
        (1, "The user fixed a parser bug", "fact", None, 1.0, 1.0),
        (2, "likes oat milk", "preference", None, 1.0, 1.0),
        (3, "uses dark mode in the editor", "preference", "tool.editor", 1.0, 1.0),
        (4, "The user's name is Krishna", "identity", "user.name", 1.0, 1.0),
        (5, "drank coffee", "event", None, 1.0, 1.0),
        (6, "prefers pnpm over npm and yarn", "preference", None, 1.0, 1.0),
        *NOTES,
    ]).cache()


def best(spark, mem, *asked):
    return {r.qid: r.id for r in retrieval.top(retrieval.recall(queries(spark, *asked), mem, now(), stems=True), 1).collect()}


def test_recall_finds_what_is_asked(spark, mem):
    assert best(spark, mem, "parsers", "what editor theme do they like", "what is my name", "pnpm or npm", "quantum chromodynamics") == {0: 1, 1: 3, 2: 4, 3: 6}


def test_empty_queries_fall_back_to_salience(spark, mem):
    got = retrieval.salience_only(queries(spark, "!!!", "name"), retrieval.pool_of(mem), now(), 3).collect()
    assert {r.qid for r in got} == {0} and next(r.id for r in got if r.pos == 1) == 4


def test_archived_rows_do_not_leak(spark, mem):
    hidden = mem.withColumn("is_archived", F.col("id") == 3)
    assert retrieval.recall(queries(spark, "dark mode editor"), hidden, now()).filter("id = 3").count() == 0


def test_scope(spark, mem):
    other = mem.withColumn("scope", F.when(F.col("id") == 3, "elsewhere").otherwise(F.col("scope")))
    assert retrieval.recall(queries(spark, "dark mode editor"), other, now(), scope="here").filter("id = 3").count() == 0


def test_bm25_equals_fts5(spark, mem):
    rows = [(r.id, r.text) for r in mem.collect()]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize='unicode61')")
    db.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", rows)
    for asked, match in (("dashboard metric", '"dashboard" OR "metric"'), ("user editor", '"user" OR "editor"'), ("pnpm npm pnpm", '"pnpm" OR "npm" OR "pnpm"')):
        index = retrieval.build_index(mem)
        got = {r.id: r.magnitude for r in retrieval.bm25(retrieval.matches(retrieval.query_terms(queries(spark, asked)), index), index).filter("not prefix").collect()}
        want = {i: -s for i, s in db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,))}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_porter_index_equals_fts5(spark, mem):
    rows = [(r.id, r.text) for r in mem.collect()] + [(900, "relational databases were happily conditioned, flies agreed hopping and falling; allergies"), (901, "generalizations of adjustable oscillators"), (902, "parsers parsing parsed")]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize='porter unicode61')")
    db.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", rows)
    docs = spark.createDataFrame(rows, "id long, text string").withColumns({"is_archived": F.lit(False), "superseded_by": F.lit(None).cast("long")})
    for asked in ("parser dashboards", "relate condition", "fly agree hops", "general adjust oscillate", "allergy", "reviewing metrics", "database falls"):
        index = retrieval.build_index(docs, stems=True)
        got = {r.id: r.magnitude for r in retrieval.bm25(retrieval.matches(retrieval.query_terms(queries(spark, asked), stems=True), index), index).filter("not prefix").collect()}
        want = {i: -s for i, s in db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (" OR ".join(f'"{w}"' for w in asked.split()),))}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want), asked


def test_ladder_prefers_the_strictest_rung(spark, mem):
    rung = {r.qid: r.rung for r in retrieval.bm25_search(queries(spark, "dark editor", "dar edit", "dark zebra", "dar zebra"), retrieval.build_index(mem)).select("qid", "rung").distinct().collect()}
    assert rung == {0: 1, 1: 2, 2: 3, 3: 4}


def test_escalation(spark, mem):
    q = queries(spark, "dark mode editor", "chromodynamics", "!!!")
    got = {r.qid: r.escalate for r in retrieval.escalates(retrieval.recall(q, mem, now()), q).collect()}
    assert got == {0: False, 1: True}


def test_hashing_embedder(spark, mem):
    v = vectors.hashed(["allergies"])
    assert len(v) == 256 and sum(x * x for x in v) == pytest.approx(1, abs=1e-6) and vectors.hashed([]) == [0.0] * 256
    near, far = (sum(a * b for a, b in zip(v, vectors.hashed([w]), strict=True)) for w in ("allergic", "keyboard"))
    assert near > 0.12 > far
    found = vectors.embedded(mem.select("id", "text")).select("id", vectors.unpacked(vectors.packed(F.col("vec")), 256).alias("vec"))
    assert retrieval.vector_search(vectors.embedded(queries(spark, "dark editors").toDF("id", "text")).toDF("qid", "vec"), found, 3).filter("rank = 1").first().id == 3
    assert vectors.embedded(mem.select("id", "text"), lambda ts: [[float(len(t))] for t in ts]).filter("id = 2").first().vec == [14.0]
    assert found.select(vectors.unpacked(vectors.packed(F.col("vec")), 8).alias("v")).filter("v is not null").count() == 0


def test_mmr_equals_plain(spark):
    rows = [(0, 1, 0.9, 1, ["a", "b"]), (0, 2, 0.89, 2, ["a", "b"]), (0, 3, 0.5, 3, ["c"]), (0, 4, 0.4, 4, ["d"]), (1, 9, 0.1, 1, ["x"])]
    df = spark.createDataFrame(rows, "qid long, id long, score double, place long, tokens array<string>")
    got = {(r.qid, r.pos): (r.id, r.mmr) for r in similarity.diversified(df, 3, 0.7).collect()}
    assert [got[0, i][0] for i in (1, 2, 3)] == [1, 3, 2] or [got[0, i][0] for i in (1, 2, 3)] == [1, 3, 4]
    assert got[0, 2][1] == pytest.approx(0.35) and got[1, 1] == (9, None)


def weighted(a, b, idf):
    w = lambda s: sum(idf.get(t, 1.0) for t in s)
    return w(a & b) / w(a | b) if a and b else 0.0


def test_weighted_pairs_equal_all_pairs(spark):
    import random

    rng = random.Random(2)
    bags = {i: {f"t{int(rng.paretovariate(0.6))}" for _ in range(rng.randint(1, 14))} for i in range(80)}
    bags |= {100 + i: set(list(bags[i])[:-1]) | {"extra"} for i in range(30)}
    df = {}
    for s in bags.values():
        for t in s:
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(1 + len(bags) / n) for t, n in df.items()}
    items = spark.createDataFrame([(i, t) for i, s in bags.items() for t in s], "id long, token string")
    weights = spark.createDataFrame(list(idf.items()), "token string, idf double")
    for least in (0.3, 0.58, 0.78):
        got = {(r.a, r.b): r.score for r in similarity.weighted_pairs(similarity.weighted_sets(items, weights), least).collect()}
        want = {(a, b): s for a in bags for b in bags if a < b and (s := weighted(bags[a], bags[b], idf)) >= least}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_postings_are_counted_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "b a b ß A"), (2, ""), (3, None), (4, "x")], "id long, text string")
    rows = retrieval.postings(df)
    assert sorted(map(tuple, rows.collect())) == [(1, "a", 2), (1, "b", 2), (1, "ss", 1), (4, "x", 1)]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_keywords_are_counted_without_a_shuffle(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["keywords_topk"](spark, "/root/testdata/sf0.001")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_vector_scans_equal_plain_and_run_as_matrices(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vecs = {i: v.tolist() for i, v in enumerate(rng.choice([-0.5, 0.0, 0.5], (90, 4)))} | {90: [1.0, 0.0], 91: None}
    table = spark.createDataFrame(list(vecs.items()), "id long, vec array<double>")
    asked = table.filter("id % 9 = 0").withColumnRenamed("id", "qid")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) if a and b and len(a) == len(b) else 0.0
    want = {(q, i): cos(vecs[q], vecs[i]) for q in vecs if q % 9 == 0 for i in vecs}
    pairs = retrieval.dot_products(asked, table)
    assert {(r.qid, r.id): r.cosine for r in pairs.collect()} == want
    assert "MapInArrow" in pairs._jdf.queryExecution().executedPlan().toString()
    found = retrieval.vector_search(asked, table, 3, 0.1)
    best = {q: sorted((i for i in vecs if want[q, i] > 0.1), key=lambda i: (-want[q, i], -i))[:3] for q in vecs if q % 9 == 0}
    assert {(r.qid, r["rank"]): r.id for r in found.collect()} == {(q, k + 1): i for q, ids in best.items() for k, i in enumerate(ids)}
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_block_pairs_lose_nothing_between_blocks(spark, monkeypatch):
    import random

    from anamnesis.operators import pairs

    for name, value in (("BLOCK_SETS", 9), ("BLOCK_TOKENS", 60), ("SIDE_TOKENS", 40), ("LEAST_SETS", 1)):
        monkeypatch.setattr(pairs, name, value)
    rng = random.Random(5)
    bags = {i: {f"t{rng.randint(1, 30)}" for _ in range(rng.choice([1, 2, 8, 9, 10, 40]))} for i in range(60)}
    items = spark.createDataFrame([(i, t) for i, s in bags.items() for t in s], "id long, token string")
    idf = {f"t{k}": 0.2 + k / 4 for k in range(1, 31, 2)}
    sets = similarity.weighted_sets(items, spark.createDataFrame(list(idf.items()), "token string, idf double"))
    want = {(a, b): s for a in bags for b in bags if a < b and (s := weighted(bags[a], bags[b], idf)) >= 0.4}
    got = {(r.a, r.b): r.score for r in similarity.weighted_pairs(sets, 0.4).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    sides = {1, 20, 21, 44, 59}
    some = similarity.weighted_pairs(sets, 0.4, spark.createDataFrame([(i,) for i in sides], "id long")).collect()
    assert sorted((r.a, r.b) for r in some) == sorted(k for k in want if k[1] in sides)


def test_hashing_adds_in_single_precision_one_by_one():
    from anamnesis.operators.vectors import _grams, _slot, hashed

    words = ["allergic", "to", "peanuts"] * 1500 + ["x"]
    v = [0.0] * 256
    f32 = lambda x: __import__("struct").unpack("f", __import__("struct").pack("f", x))[0]
    for w in words:
        for key, weight in [(w, 1.0), *(("#" + g, 0.35) for g in _grams(w))]:
            i, sign = _slot(key, 256)
            v[i] = f32(v[i] + sign * weight)
    norm = math.sqrt(math.fsum(x * x for x in v))
    assert hashed(words) == [f32(x / norm) for x in v]


def test_merge_plan_is_greedy_and_respects_identity(spark):
    items = spark.createDataFrame([(1, "fact", None, []), (2, "fact", None, []), (3, "fact", None, []), (4, "goal", None, []), (5, "fact", None, ["0"]), (6, "fact", "s", []), (7, "fact", "s", [])], "id long, memory_type string, subject string, ident array<string>")
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.95), (1, 3, 0.6), (1, 4, 1.0), (1, 5, 1.0), (6, 7, 1.0)], "a long, b long, score double")
    got = {(r.keep, r.drop, r.action) for r in similarity.merge_plan(items, pairs).collect()}
    assert got == {(1, 2, "merge"), (1, 3, "ask")}


def test_class_pairs_give_the_plan_of_all_pairs(spark):
    from itertools import product

    near = ["user likes strong black coffee every morning", "user likes strong black coffee each morning", "User likes strong, black coffee every morning!", "user likes strnog black coffee every mornings", "deploys run from the main branch on fridays", "deploys run from the main branch on friday"]
    made = [(t, kind, s) for t, kind, s in product(near, ("x", "y"), (None, None, "s"))]
    made = [(1, near[0], "x", None), (2, near[0], "y", None), (3, near[3], "y", None), (4, near[0], "y", None)] + [(10 + i * 7 % 36, *m) for i, m in enumerate(made)]
    rows = spark.createDataFrame(made, "id long, text string, memory_type string, subject string").withColumn("ident", text.identity_tokens(F.col("text")))
    items = rows.select("id", "memory_type", "subject", "ident")
    plan = lambda pairs: {(r.keep, r.drop, round(r.score, 9), r.action) for r in similarity.merge_plan(items, pairs).collect()}
    got = plan(similarity.class_pairs(rows, 0.58))
    assert got == plan(similarity.similar_pairs(rows.select("id", "text"), 0.58))
    assert (2, 4, 1.0, "merge") in got and any(r[:2] == (2, 3) for r in got)


def test_merged_and_retargeted(spark):
    work_dir(spark)
    plan = spark.createDataFrame([(1, 2, "merge"), (2, 3, "merge")], "keep long, drop long, action string")
    items = spark.createDataFrame([(1, "short", 0.2), (2, "a much longer restatement", 0.9), (3, "x", 0.1)], "id long, text string, importance double")
    chain = similarity.retargeted(plan)
    assert {(r.keep, r.drop) for r in chain.collect()} == {(1, 2), (1, 3)}
    assert tuple(similarity.merged(items, chain).first()) == (1, "a much longer restatement", 0.9, 2)


def test_sweeps(spark):
    rows = [(1, "e", "event", None, 1.0, 30.0), (2, "i", "identity", None, 1.0, 900.0), (3, "old", "event", None, 0.2, 400.0), (4, "new", "event", None, 1.0, 0.0)]
    mem = store(spark, rows)
    said = {r.id: r.action for r in lifecycle.sweep(mem, now()).collect()}
    assert said == {1: "write", 2: "write", 3: "idle", 4: "none"}
    once = lifecycle.swept(mem, now())
    again = {r.id: r.confidence_score for r in lifecycle.swept(once, now()).collect()}
    assert {r.id: r.confidence_score for r in once.collect()} == pytest.approx(again)
    steps = [r.confidence for r in lifecycle.forecast(mem, now()).filter("id = 1").orderBy("step").collect()]
    assert steps == sorted(steps, reverse=True) and len(steps) == 6


def test_patches(spark, mem):
    patches = spark.createDataFrame([(1, "new text", 7.0), (2, " ", None)], "id long, text string, confidence_score double")
    got = {r.id: r for r in lifecycle.patched(mem, patches, now()).filter("id <= 2").collect()}
    assert (got[1].text, got[1].confidence_score) == ("new text", 1.0) and got[2].text == "likes oat milk"


def test_slots(spark):
    rows = [(1, "lives in London", "identity", "user.location", 1.0, 5.0), (2, "lives in Tokyo", "identity", "user.location", 1.0, 1.0), (3, "lives in tokyo ", "identity", "user.location", 1.0, 0.5), (4, " ", "event", None, 1.0, 0.0)]
    mem = store(spark, rows)
    assert {(r.kept_id, r.archived_id) for r in similarity.subject_conflicts(mem).collect()} == {(3, 1), (3, 2)}
    assert {(r.id, r.superseded_by) for r in similarity.superseded(mem).collect()} == {(1, 2)}
    assert [r.id for r in similarity.latest_per_subject(mem).collect()] == [3]
    assert {(r.id, r.reason) for r in similarity.prunable(mem).collect()} == {(4, "empty")}


def test_inserts(spark):
    work_dir(spark)
    mem = store(spark, [(1, "The user prefers pnpm over npm", "preference", None, 1.0, 1.0), (2, "lives in London", "identity", "user.location", 1.0, 1.0), *NOTES])
    batch = [(1001, "the user prefers PNPM over npm.", "user_preference", None), (1002, "The user prefers yarn over npm", "preference", None), (1003, "  ", "fact", None), (1004, "lives in Tokyo", "identity", "user.location"),
             (1005, "alarm in slot 7", "fact", None), (1006, "alarm in slot 8", "fact", None), (1007, "Alarm in slot 7", "fact", None)]
    df = spark.createDataFrame(batch, "id long, text string, memory_type string, subject string")
    said = {r.id: (r.action, r.target) for r in writes.decided(df, mem).collect()}
    assert said[1001] == ("duplicate", 1) and said[1002][0] == "insert" and 1003 not in said and said[1007] == ("duplicate", 1005) and said[1006][0] == "insert"
    after = {r.id: r for r in writes.inserted(mem, df, policy(spark), now()).collect()}
    assert after[2].superseded_by == 1004 and after[2].is_archived and after[1004].supersedes == 2 and 1001 not in after and after[1002].memory_type == "preference"


def test_store(spark, mem, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.read().count() == 0 and s.write(mem) == 1
    s.archive([1], "user_requested")
    assert s.read().filter("is_archived").first().archived_reason == "user_requested"
    s.restore([1])
    s.delete([2])
    assert s.read().filter("is_archived").count() == 0 and s.read().filter("id = 2").count() == 0
    s.archive([3], "x")
    s.wipe(include_archived=False)
    assert [r.id for r in s.read().collect()] == [3]
    s.wipe()
    assert s.read().count() == 0 and s.version() == 7
    old = spark.createDataFrame([(1, "legacy", None)], "id long, text string, memory_type string")
    assert migrated(old).first().memory_type == "fact" and migrated(old).first().scope == "global"


def test_inbox(spark, tmp_path):
    at = F.lit(NOW).cast("timestamp")
    rows = spark.createDataFrame([(1, " a  fact ", "x", None), (2, "", "x", None), (3, None, "x", None), (4, "y" * 4001, "x", None), (5, "a fact", "x", None)], "id long, text string, source string, session_id string").withColumn("captured_at", at)
    assert {r.id: r.rejected for r in inbox.checked(rows).collect()} == {1: None, 2: "empty", 3: "empty", 4: "too long", 5: None}
    inbox.capture(rows, f"{tmp_path}/landed")
    got = []
    take = lambda b, n: got.extend((r.id, r.text) for r in b.collect())
    inbox.drain(spark, f"{tmp_path}/landed", f"{tmp_path}/state", take)
    inbox.drain(spark, f"{tmp_path}/landed", f"{tmp_path}/state", take)
    assert sorted(got) == [(1, "a fact"), (5, "a fact")]
    said = spark.createDataFrame([(1, "insert", None)], "id long, action string, target long")
    assert {(r.id, r.status) for r in inbox.drained(rows, lambda b: said).collect()} == {(1, "drained"), (2, "error"), (3, "error"), (4, "error"), (5, "error")}


def test_streams(spark, tmp_path):
    log = spark.createDataFrame([(i % 3, f"q{i % 2}", float(i)) for i in range(30)], "memory_id long, query string, score double").withColumn("accessed_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("score") * 600))
    log.write.parquet(f"{tmp_path}/log")
    batch = inbox.recall_rates(log).agg(F.sum("recalls")).first()[0]
    assert batch == 30
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
    q = inbox.reinforcement_stream(stream).writeStream.format("memory").queryName("uses").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.memory_id: r.uses for r in spark.table("uses").collect()} == {0: 10, 1: 10, 2: 10}


def test_context(spark):
    rows = [(0, i, 1.0 - i / 100, "event", None, 0.1 if i % 2 else 0.4, 0.3, F"note {i} " + "x " * 200) for i in range(1, 37)] + [(1, 99, 0.5, "fact", "a.b", 0.1, 0.9, "only")]
    df = spark.createDataFrame(rows, "qid long, id long, score double, memory_type string, subject string, importance double, confidence_score double, text string").withColumn("last_accessed_at", F.lit(NOW).cast("timestamp"))
    lines = context.context_lines(df, 600).filter("qid = 0").orderBy("n").collect()
    assert [r.id for r in lines] == [2, 4] and sum(len(r.line) + 1 for r in lines) <= 600 and "(confidence: 30%)" in lines[0].line
    assert context.context_lines(df, 5).count() == 2
    block = {r.qid: r.block for r in context.context_block(df).collect()}
    assert block[1].startswith("What you know about the user:\n- [99] (fact) <a.b> only\nThese notes")


def test_history(spark):
    turns = spark.createDataFrame([(1, i, ("user", "assistant")[i % 2], f"m{i} " + "z" * 300) for i in range(40)] + [(2, 0, "user", "a"), (2, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    got = context.compacted(turns)
    assert got.filter("conv_id = 1").count() == 9 and got.filter("conv_id = 2").count() == 2
    assert got.filter("conv_id = 1 and n = 0").first().text.count("...") == 32


@pytest.mark.parametrize(("turn", "want"), [("", False), ("ok", False), ("run the tests", False), ("ls the folder", False), ("fix auth.py please now", False), ("```code block here```", False), ("Traceback (most recent call last): x", False),
    ("what is the capital of France?", False), ("my name is Krishna and I use pnpm", True), ("run the tests, I prefer pytest always", True)])
def test_gate(spark, turn, want):
    assert spark.createDataFrame([(turn,)], "t string").select(extract.worth_extracting(F.col("t")).alias("w")).first().w is want


def test_extraction(spark):
    texts = lambda t: [f["text"] for f in spark.createDataFrame([(t,)], "t string").select(extract.facts(F.col("t")).alias("f")).first().f]
    assert texts("my name is Krishna and I use pnpm") == ["The user's name is Krishna.", "The user uses pnpm."]
    assert texts("I use pnpm and yarn") == ["The user uses pnpm and yarn."]
    assert texts("I prefer dark mode and I am a backend developer")[1] == "The user prefers dark mode."
    assert texts("I live in Berlin and I use pnpm")[0] == "The user lives in Berlin."
    assert texts("never commit to the main branch") == ["The user has asked to never commit to the main branch."]
    assert texts("fix the bug in auth.py") == [] and texts(None) == []
    assert len(texts("my name is Al Bo, I live in Rome, I use vim, always run the linter, remember that it is cold")) == 3
    clean = lambda v: spark.createDataFrame([(v,)], "t string").select(extract.clean(F.col("t")).alias("f")).first().f
    cases = {"pnpm and yarn": "pnpm and yarn", "pnpm and i am": "pnpm", "a, b and c or d": "a, b", "tea or": "tea", "vim and emacs and more words": "vim and emacs", "vim and more words": "vim", "the of it, really just": "the of it", "": "", "so": "", "Rome; because": "Rome"}
    assert {v: clean(v) for v in cases} == cases
    assert texts("I hate tabs! I also dislike mornings") == ["The user dislikes tabs."] and texts("My name's Zoë Angström ok") == ["The user's name is Zoë Angström."]


def test_model_replies(spark):
    good = '[{"text":"The user uses pnpm daily","memory_type":"prefs","subject":"Tool.PM","importance":7}]'
    for reply in (good, f"```json\n{good}\n```", f"Sure: {good} done"):
        assert extract.facts_of_reply(reply) == [{"text": "The user uses pnpm daily", "memory_type": "preference", "subject": "tool.pm", "importance": 1.0}]
    assert [extract.facts_of_reply(r) for r in ("", "not json", "[1,2,3]", None, '{"a":1}', '[{"text":"a session note here","memory_type":"session"}]')] == [[]] * 6
    assert extract.verdicts_of_reply('{"same":[1,9]}', 2) == [1] and extract.verdicts_of_reply('{"same":[[2]]}', 2) == [2] and extract.verdicts_of_reply("no", 2) is None
    turns = spark.createDataFrame([(1, "I enjoy long quiet walks")], "turn_id long, text string")
    assert extract.extracted_by(turns, lambda t: good).first().memory_type == "preference"


def test_echoes(spark):
    hits = spark.createDataFrame([(1, "preference", None, "The user uses pnpm and yarn.")], "turn_id long, memory_type string, subject string, text string")
    said = spark.createDataFrame([(1, "preference", "The user uses pnpm as their package manager"), (1, "preference", "The user dislikes tabs"), (2, "preference", "The user uses pnpm and yarn.")], "turn_id long, memory_type string, text string")
    assert [r.text[-7:] for r in similarity.echoes(said, hits, 0.3).collect()] == ["manager"]


def test_files(spark, tmp_path):
    for name, body in (("a/x.py", "one\nTwo needle\n"), (".hid/y.py", "needle"), ("a/z.bin", "needle"), ("__pycache__/w.py", "needle")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    got = scans.grep(text_files(spark, f"{tmp_path}/"), "NEEDLE").collect()
    assert [(re.sub(".*/", "", r.name), r.line, r.content) for r in got] == [("x.py", 2, "Two needle")]


def test_refinement(spark):
    row = spark.createDataFrame([(["a", "b"], ["b", "a", "c"])], "x array<string>, y array<string>")
    assert row.select(text.refines(F.col("x"), F.col("y")), text.refines(F.col("y"), F.col("x"))).first()[:] == (True, False)


def test_engine(spark, tmp_path):
    from anamnesis.api import MemoryEngine

    e = MemoryEngine(spark, f"file://{tmp_path}/engine", now())
    said = {r.id: r.action for r in e.add_many([("The user is allergic to peanuts", "fact", None), {"text": "The user likes tea", "memory_type": "preference"}, ("the user LIKES tea.", "preference"), ("note", "session", None), "plain words of a fact"]).collect()}
    assert said == {1: "insert", 2: "insert", 3: "duplicate", 5: "insert"}
    e.observe(["I live in Berlin because of work"])
    assert e.observe(["I like that the user likes green tea, remember that The user likes tea"]).filter("action = 'insert'").count() <= 1
    got = {r.qid: r.id for r in e.search(["do I have any allergies", "where do I live", "!!!"], k=1).collect()}
    assert got[0] == 1 and got[1] == 6 and 2 in got
    vectors = e.store.vectors().count()
    assert vectors == e.stats().first().live and e.refresh_vectors() == 0
    before = e.store.accesses().count()
    assert e.search(["where do I live"], k=1, reinforce=True).first().id == 6
    used = e.store.read().filter("id = 6").first()
    logged = e.store.accesses().collect()
    assert (before, used.access_count, [(r.memory_id, r.query) for r in logged]) == (0, 1, [(6, "where do I live")])
    assert "Berlin" in e.context(["where do I live"], use_vectors=False).first().block
    line = e.explain(["where do I live"], k=1).first().explanation
    assert "[6] identity" in line and "coverage" in line
    assert e.tool("remember", text=" ").startswith("Error") and e.tool("forget", memory_id=99).startswith("Error") and e.tool("nothing").startswith("Error")
    assert e.tool("remember", text="The user likes tea", memory_type="preference") == "Known as #2 (duplicate)." and e.tool("forget", memory_id=2) == "Archived #2."
    assert "IDENTITY (1)" in e.tool("memories") and "#2 " not in e.tool("memories") and "x #2 " in e.tool("memories", include_archived=True)


def test_engine_sweeps_and_forgets(spark, tmp_path):
    from anamnesis.api import MemoryEngine

    e = MemoryEngine(spark, f"file://{tmp_path}/engine", now(), every=2)
    rows = [(1, "The user is allergic to peanuts", "fact", None, 1.0, 30.0), (2, "lives in London", "identity", "user.location", 1.0, 5.0), (3, "lives in Tokyo", "identity", "user.location", 1.0, 1.0), (4, "old gossip", "event", None, 0.2, 400.0), (5, " ", "event", None, 1.0, 0.0)]
    e.store.write(store(spark, rows))
    counts = e.tick().first()
    assert (counts.checked, counts.decayed, counts.archived, counts.expired) == (5, 1, 1, 0) and e.last_report is None
    e.forget([1])
    gone = {r.id: r.archived_reason for r in e.store.read().filter("is_archived").collect()}
    assert gone == {1: "user_requested", 4: "idle"}
    assert (e.stats().first().live, e.stats().first().archived) == (3, 2)
    e.tick()  # the second turn consolidates
    assert (e.last_report.superseded, e.last_report.pruned, e.last_report.merged) == ([2], [5], []) and "1 superseded" in str(e.last_report)


def test_consolidation_asks_once_and_remembers(spark, tmp_path):
    from anamnesis.api import MemoryEngine

    e = MemoryEngine(spark, f"file://{tmp_path}/engine", now())
    rows = [(1, "The user is a backend engineer", "fact", None, 1.0, 0.0), (2, "The user works as a backend engineer", "fact", None, 1.0, 0.0), (3, "The user likes tea", "preference", None, 1.0, 0.0), (4, "the user likes tea", "preference", None, 1.0, 0.0)]
    e.store.write(store(spark, rows))
    asked = []
    failing = lambda pairs: asked.append(len(pairs)) or None
    assert e.consolidate(dry_run=True).merged == [(3, 4)] and e.store.read().filter("is_archived").count() == 0
    first = e.consolidate(failing)
    assert first.merged == [(3, 4)] and e.store.verdicts().count() == 0  # no answer is kept of a failure
    pairs = asked[0] if asked else 0
    no = e.consolidate(lambda p: [])
    assert no.merged == [] and e.store.verdicts().count() == pairs
    again = e.consolidate(failing)
    assert again.merged == [] and len(asked) == min(1, pairs)  # what was said is not asked again


def test_two_writers_of_one_version(spark, mem, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.write(mem)
    n, late = s.version(), s.read().filter("id = 1")
    s.write(s.read().filter("id = 2"), n)
    with pytest.raises(Exception):
        s.write(late, n)
    assert [r.id for r in s.read().collect()] == [2] and s.version() == n + 1


def test_index_of_a_version(spark, mem, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.write(mem)
    index = s.index()
    assert retrieval.index_is_sane(index, s.read()) and index.n_docs == mem.count()
    s.delete([1])
    assert not retrieval.index_is_sane(index, s.read()) and s.index().n_docs == mem.count() - 1
    assert s.reindexed().n_docs == mem.count() - 1


def test_adjudication(spark):
    plan = spark.createDataFrame([(1, 2, 0.9, "merge"), (3, 4, 0.7, "ask"), (5, 6, 0.6, "ask")], "keep long, drop long, score double, action string")
    items = spark.createDataFrame([(i, f"text number {chr(96 + i)}") for i in range(1, 7)], "id long, text string")
    none = spark.createDataFrame([], "pair string, same boolean")
    out, fresh = similarity.adjudicated(plan, items, lambda pairs: [2], none)
    assert sorted((r.keep, r.drop) for r in out.collect()) == [(1, 2), (5, 6)] and fresh.count() == 2
    out, more = similarity.adjudicated(plan, items, lambda pairs: 1 / 0, fresh)
    assert sorted((r.keep, r.drop) for r in out.collect()) == [(1, 2), (5, 6)] and more.count() == 0
    assert similarity.adjudicated(plan, items, lambda pairs: 1 / 0, none)[1].count() == 0


def test_embedders():
    from anamnesis.embedders import Embedder, Embedders

    known, calls = Embedders(), []
    encode = lambda texts: calls.append(len(texts)) or [[float(len(t)), 1.0] for t in texts]
    known.register(Embedder("broken", lambda texts: 1 / 0))
    known.register(Embedder("lengths", encode, batch=2, chars=4))
    assert known.use("missing", "broken", "lengths").name == "lengths" and known.get().name == "lengths"
    calls.clear()
    assert known.get().batched()(["a", "bb", "a", None, "", "ccccccc"]) == [[1.0, 1.0], [2.0, 1.0], [1.0, 1.0], None, None, [4.0, 1.0]] and calls == [2, 1]
    assert known.use("broken").name == "hashing-256" and known.get().batched() is None
    known.reset()
    assert known.names() == ["hashing-256"]


def test_plain_functions(spark):
    from anamnesis.functions import lifecycle as life

    at = F.lit("2024-02-01 03:04:05.000006").cast("timestamp")
    row = spark.range(1).select(
        life.to_iso(at), life.to_iso(F.lit("2024-02-01 00:00:00").cast("timestamp")), life.to_iso(life.plus_days(at, F.lit(1.5))), text.truncated(F.lit("abcdef"), 4), text.truncated(F.lit("abcd"), 4), similarity.pair_key(F.lit("b"), F.lit("a"))
    ).first()
    assert row[:] == ("2024-02-01T03:04:05.000006+00:00", "2024-02-01T00:00:00+00:00", "2024-02-02T15:04:05.000006+00:00", "abcd\n[2 characters truncated]", "abcd", "a:b")
    words = [["new", "york"], ["ab"], [], ["ß", "é"]]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w array<string>").select(text.trigrams(F.col("w"))).collect()]
    assert got == [["new", "ew ", "w y", " yo", "yor", "ork"], ["ab"], [], ["ß é"]]


def test_files_and_captures(spark, tmp_path):
    from anamnesis.sources.store import files_under, lines_of

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("first fact of all\n\n  \nsecond fact of all\n")
    assert [(r.name, r.bytes) for r in files_under(spark, f"{tmp_path}/in").collect()] == [("a.txt", 41)]
    assert sorted(r.text for r in lines_of(spark, f"{tmp_path}/in").collect()) == ["first fact of all", "second fact of all"]
    assert inbox.capture_one(spark, " one  fact ", f"{tmp_path}/landed") is None and inbox.capture_one(spark, " ", f"{tmp_path}/landed") == "empty"
    inbox.capture_lines(spark, f"{tmp_path}/in", f"{tmp_path}/landed")
    rows = spark.read.parquet(f"{tmp_path}/landed").collect()
    assert sorted(r.text for r in rows) == ["first fact of all", "one fact", "second fact of all"] and len({r.id for r in rows}) == 3


def test_memories_by_type(spark):
    mem = store(spark, [(1, "likes tea", "preference", None, 0.8, 0.0), (2, "named Al", "identity", None, 1.0, 0.0), (3, "odd", "fact", None, 1.0, 0.0)]).withColumn("memory_type", F.when(F.col("id") == 3, "zzz").otherwise(F.col("memory_type")))
    rows = context.by_type(mem).orderBy("place").collect()
    assert [(r.memory_type, r.n) for r in rows] == [("identity", 1), ("preference", 1), ("zzz", 1)] and "80%" in rows[1].lines[0] and "likes tea" in rows[1].lines[0]
