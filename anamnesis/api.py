"""One object for a store of memories: writing, searching and maintaining it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.embedders import Embedder, registry
from anamnesis.functions import lifecycle as life
from anamnesis.functions import text
from anamnesis.functions.constants import (
    CONSOLIDATE_EVERY, CONTEXT_BUDGET, ECHO, MAX_CANDIDATES, MIN_SCORE, MMR_LAMBDA, SALIENCE_BIAS, SALIENCE_WEIGHT, TOP_K, VECTOR_LIMIT,
)
from anamnesis.operators import context, extract, lifecycle, retrieval, scans, similarity, vectors, writes
from anamnesis.plans.memories import policy
from anamnesis.sources.paths import staged, work_dir
from anamnesis.sources.store import Store

#: A fact as its text, as (text, type, subject), or with these names.
Fact = str | Sequence | Mapping


@dataclass
class Report:
    """What a consolidation did: rows it looked at, and the ids that went."""

    checked: int = 0
    merged: list[tuple[int, int]] = field(default_factory=list)
    superseded: list[int] = field(default_factory=list)
    pruned: list[int] = field(default_factory=list)
    left: int = 0

    def __str__(self) -> str:
        parts = [(len(self.merged), "merged"), (len(self.superseded), "superseded"), (len(self.pruned), "pruned"), (self.left, "left to ask about")]
        return ", ".join([f"{self.checked} checked", *(f"{n} {what}" for n, what in parts if n)])


class MemoryEngine:
    """Batches of queries and facts are tables; a search changes nothing unless it is told to reinforce."""

    def __init__(self, spark: SparkSession, path: str, now: Column | None = None, encode: Callable[[list], list] | None = None, every: int = CONSOLIDATE_EVERY):
        work_dir(spark)
        self.spark, self.store = spark, Store(spark, path)
        self.embedder = Embedder("external", encode) if encode else registry.get()
        self.now = now if now is not None else F.current_timestamp()
        self.every, self.turns, self.last_report = every, 0, None

    def _asked(self, queries: Sequence[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(queries)), "qid long, query string")

    def add_many(self, facts: Sequence[Fact]) -> DataFrame:
        """Inserts facts; returns what became of each: (id, action, target)."""
        named = lambda f: (f, None, None) if isinstance(f, str) else tuple(f.get(k) for k in ("text", "memory_type", "subject")) if isinstance(f, Mapping) else (*f, None, None)[:3]
        n = self.store.version()
        mem = self.store.read()
        base = (mem.agg(F.max("id")).first()[0] or 0) + 1
        batch = self.spark.createDataFrame([(base + i, *named(f)) for i, f in enumerate(facts)], "id long, text string, memory_type string, subject string")
        batch = batch.filter(F.lower(F.coalesce("memory_type", F.lit(""))) != "session")  # working state is not written by request
        said = writes.decided(batch, mem)
        self.store.write(writes.inserted(mem, batch, policy(self.spark), self.now, said), n)
        return said

    def observe(self, turns: Sequence[str], ask: Callable[[str], str] | None = None) -> DataFrame:
        """Facts found in user turns, by patterns or by a model's replies, added to the store. A fact without a subject that
        only repeats a stored one of its type is left out."""
        rows = self.spark.createDataFrame(list(enumerate(turns)), "turn_id long, text string")
        found = staged(extract.extracted_by(rows, ask) if ask else extract.extracted(rows), "found")
        known = scans.live(self.store.read())
        loose = found.filter("subject is null").withColumn("fact", F.concat_ws(":", "turn_id", "n"))
        words = lambda c: F.explode(F.array_distinct(text.tokens(F.col(c)))).alias("word")
        stored = known.filter("subject is null").select("memory_type", F.col("text").alias("known"), words("text"))  # an echo shares a word
        near = staged(loose.select("fact", "memory_type", "text", words("text")).join(stored, ["memory_type", "word"]).drop("word").distinct(), "echo-candidates")
        echo = similarity.echoes(near.select(F.col("fact").alias("turn_id"), "memory_type", "text"), near.select(F.col("fact").alias("turn_id"), "memory_type", F.col("known").alias("text"), F.lit(None).cast("string").alias("subject")), ECHO)
        fresh = found.withColumn("fact", F.concat_ws(":", "turn_id", "n")).join(echo.select(F.col("turn_id").alias("fact")), "fact", "left_anti")
        facts = fresh.orderBy("turn_id", "n").select("text", "memory_type", "subject").collect()  # at most three for each turn given
        return self.add_many([tuple(f) for f in facts])

    def _results(self, queries: Sequence[str], scope: str | None, use_vectors: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The store, the queries and all candidates (qid, id, score, first, pos, text, lexical, slot, coverage, salience)."""
        mem, asked = staged(self.store.read(), "memories"), self._asked(queries)
        found = retrieval.recall(asked, mem, self.now, scope=scope, stems=True, index=self.store.index(True) if self.store.version() else None)
        signals = ["lexical", "slot", "coverage", "salience"]
        ranked = found.select("qid", "id", "score", "first", "text", "memory_type", *signals)
        if use_vectors:
            weak = retrieval.escalates(found, asked).filter("escalate").select("qid")
            ranked = ranked.unionByName(self._by_vector(weak, asked, mem, found, scope), allowMissingColumns=True)
        return mem, asked, staged(retrieval.top(ranked, MAX_CANDIDATES), "results")

    def search(self, queries: Sequence[str], k: int = TOP_K, scope: str | None = None, use_vectors: bool = True, diversify: bool = True, reinforce: bool = False) -> DataFrame:
        """(qid, pos, id, score) of the best memories for each query. reinforce: what was found counts as used, and the access log says so."""
        n = self.store.version()
        mem, asked, ranked = self._results(queries, scope, use_vectors)
        if diversify:
            found = ranked.withColumn("tokens", text.tokens(F.col("text"))).select("qid", "id", "score", F.col("pos").alias("place"), "tokens")
            best = similarity.diversified(found, k, MMR_LAMBDA).join(ranked.select("qid", "id", "score"), ["qid", "id"]).select("qid", "pos", "id", "score")
        else:
            best = ranked.filter(F.col("pos") <= k).select("qid", F.col("pos").cast("long").alias("pos"), "id", "score")
        if reinforce:
            best = staged(best, "best")
            uses = best.groupBy("id").agg(F.count("*").alias("n"))
            new = lifecycle.reinforce(mem, uses, self.now).toDF("id", "c", "r", "a")
            hit = F.col("a").isNotNull()
            rows = mem.join(new, "id", "left").withColumns({"confidence_score": F.coalesce("c", "confidence_score"), "decay_rate": F.coalesce("r", "decay_rate"), "access_count": F.coalesce("a", "access_count"), "last_accessed_at": F.when(hit, self.now).otherwise(F.col("last_accessed_at"))})
            self.store.write(rows.drop("c", "r", "a"), n)
            self.store.log(best.join(asked, "qid").select(F.col("id").alias("memory_id"), self.now.alias("accessed_at"), "query", "score"))
        empty = retrieval.salience_only(asked, retrieval.pool_of(mem), self.now, k)
        return best.unionByName(empty.select("qid", F.col("pos").cast("long").alias("pos"), "id", "score"))

    def explain(self, queries: Sequence[str], k: int = TOP_K, scope: str | None = None) -> DataFrame:
        """(qid, pos, explanation) of the best memories, by score: what each one's score is made of."""
        return retrieval.explained(self._results(queries, scope, False)[2].filter(F.col("pos") <= k))

    def refresh_vectors(self) -> int:
        """Embeds the live rows that have no vector of their present text; returns how many."""
        model, live = self.embedder.name, scans.live(self.store.read())
        have = self.store.vectors().filter(F.col("model") == model).select(F.col("memory_id").alias("id"), "text_hash")
        todo = staged(live.withColumn("text_hash", F.sha1("text")).join(have, ["id", "text_hash"], "left_anti").select("id", "text", "text_hash"), "to-embed")
        n = todo.count()
        if n:
            made = vectors.embedded(todo, self.embedder.batched()).join(todo.select("id", "text_hash"), "id").filter("vec is not null")
            self.store.add_vectors(made.select(F.col("id").alias("memory_id"), F.lit(model).alias("model"), "vec", "text_hash"))
        return n

    def _by_vector(self, weak: DataFrame, asked: DataFrame, mem: DataFrame, found: DataFrame, scope: str | None) -> DataFrame:
        self.refresh_vectors()
        live = scans.live(mem if scope is None else scans.in_scope(mem, scope))
        q = vectors.embedded(asked.join(weak, "qid").select(F.col("qid").alias("id"), F.col("query").alias("text")), self.embedder.batched()).toDF("qid", "vec")
        hits = retrieval.vector_search(q, retrieval.newest_vectors(self.store.vectors(), live.select("id"), self.embedder.name), VECTOR_LIMIT, self.embedder.floor)
        hits = hits.join(found.select("qid", "id"), ["qid", "id"], "left_anti").join(live, "id").withColumn("salience", life.salience(self.now))
        score = retrieval.vector_strength(F.col("cosine"), self.embedder.floor, self.embedder.strong) * (SALIENCE_BIAS + SALIENCE_WEIGHT * F.col("salience"))
        rows = hits.withColumn("raw", score).filter(F.col("raw") >= MIN_SCORE)
        return rows.select("qid", "id", F.round("raw", 4).alias("score"), (F.col("rank") - 1000).alias("first"), "text", "memory_type", "salience")

    def context(self, queries: Sequence[str], budget: int = CONTEXT_BUDGET, **how) -> DataFrame:
        """(qid, block): the prompt block for each query."""
        best = self.search(queries, **how)
        return context.context_block(best.join(self.store.read(), "id"), budget)

    def tick(self, consolidate: bool | None = None, ask: Callable[[list[tuple[str, str]]], list[int] | None] | None = None) -> DataFrame:
        """One turn's maintenance: a sweep of decay, and every so many turns (or as told) a consolidation. Returns the sweep's counts."""
        self.turns += 1
        n, mem = self.store.version(), self.store.read()
        counts = staged(lifecycle.sweep_summary(lifecycle.sweep(mem, self.now)), "sweep")
        self.store.write(lifecycle.swept(mem, self.now), n)
        if consolidate if consolidate is not None else self.turns % self.every == 0:
            self.last_report = self.consolidate(ask)
        return counts

    def consolidate(self, ask: Callable[[list[tuple[str, str]]], list[int] | None] | None = None, dry_run: bool = False) -> Report:
        """Merges facts that say the same, settles slots and prunes debris. ask decides the pairs that are not certain; its
        answers are kept. dry_run: only plans the merges that are certain."""
        n, mem = self.store.version(), staged(self.store.read(), "memories")
        live = scans.live(mem).withColumn("ident", text.identity_tokens(F.col("text")))
        plan = similarity.merge_plan(live.select("id", "memory_type", "subject", "ident"), similarity.class_pairs(live, 0.58))
        left = plan.filter("action = 'ask'").count()
        if ask and not dry_run:
            plan, fresh = similarity.adjudicated(plan, live, ask, self.store.verdicts())
            self.store.add_verdicts(fresh)
            left = max(0, left - plan.count() + plan.filter("score >= 0.88").count())
        plan = staged(similarity.retargeted(plan.filter("action = 'merge'")), "merges")
        report = Report(live.count(), sorted((r["keep"], r["drop"]) for r in plan.select("keep", "drop").collect()), left=left)
        if dry_run:
            return report
        new = similarity.merged(live.select("id", "text", "importance"), plan).filter("merged > 0").select("id", F.col("text").alias("t"), F.col("importance").alias("i"))
        gone = plan.select(F.col("drop").alias("id"), F.lit("merged").alias("what"), F.concat(F.lit("merged into #"), F.col("keep").cast("string")).alias("why"))
        rest = mem.join(plan.select(F.col("drop").alias("id")), "id", "left_anti")
        lost = similarity.subject_conflicts(rest).select(F.col("archived_id").alias("id"), F.lit("superseded").alias("what"), F.concat(F.lit("superseded by #"), F.col("kept_id").cast("string")).alias("why"))
        debris = similarity.prunable(rest).join(lost.select("id"), "id", "left_anti").select("id", F.lit("pruned").alias("what"), F.col("reason").alias("why"))
        gone = staged(gone.unionByName(lost).unionByName(debris), "gone")
        for r in gone.filter("what != 'merged'").select("id", "what").collect():
            getattr(report, r["what"]).append(r["id"])
        mem = mem.join(new, "id", "left").join(gone.select("id", "why"), "id", "left")
        hit = F.col("why").isNotNull()
        rows = mem.withColumns({"text": F.coalesce("t", "text"), "importance": F.coalesce("i", "importance"), "is_archived": F.col("is_archived") | hit, "archived_reason": F.coalesce("why", "archived_reason")})
        self.store.write(rows.withColumn("norm_hash", text.norm_hash(F.col("text"))).drop("t", "i", "why"), n)
        return report

    def forget(self, ids: Sequence[int], reason: str = "user_requested") -> None:
        self.store.archive(list(ids), reason)

    def stats(self) -> DataFrame:
        return scans.totals(self.store.read())

    def listing(self, include_archived: bool = False) -> str:
        """The memories as a table in text, by type."""
        mem = self.store.read()
        return context.table(mem if include_archived else scans.live(mem)).first()["listing"]

    def tool(self, name: str, **args) -> str:
        """What a model's call of remember, recall, forget or memories replies."""
        if name not in ("remember", "recall", "forget", "memories"):
            return f"Error: there is no tool {name!r}."
        return getattr(self, f"_{name}")(**args)

    def _remember(self, text: str | None = None, memory_type: str | None = None, subject: str | None = None) -> str:
        if not (text or "").strip():
            return "Error: there is no text to remember."
        row = self.add_many([(text, memory_type, subject)]).first()
        if row is None:
            return "Error: that type is not written by request."
        return f"Saved as #{row['id']}." if row["action"] == "insert" else f"Known as #{row['target']} ({row['action']})."

    def _recall(self, query: str | None = None, limit: int = 5) -> str:
        if not (query or "").strip():
            return "Error: there is no query."
        found = self.search([query], k=max(1, min(20, int(limit))), reinforce=True).select("pos", "id", "score")
        rows = found.join(self.store.read(), "id").select("pos", context.line().alias("line")).orderBy("pos").collect()
        return "\n".join(r["line"] for r in rows) or "Nothing matches."

    def _forget(self, memory_id: int | None = None, mode: str = "archive") -> str:
        if not isinstance(memory_id, int):
            return "Error: memory_id must be a number."
        if mode not in ("archive", "delete"):
            return "Error: mode is archive or delete."
        if not self.store.read().filter(F.col("id") == memory_id).limit(1).count():
            return f"Error: there is no memory #{memory_id}."
        if mode == "delete":
            self.store.delete([memory_id])
        else:
            self.forget([memory_id])
        return f"{'Deleted' if mode == 'delete' else 'Archived'} #{memory_id}."

    def _memories(self, include_archived: bool = False) -> str:
        return self.listing(include_archived) or "There are no memories."
