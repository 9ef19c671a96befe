"""Secret scans with an incremental blob ledger.

Every historical version of a text is addressed by the SHA-256 of its UTF-8 bytes. The
ledger says which rule versions have scanned which blob and what they found; a run scans
only the blob and rule-version pairs that the ledger lacks, each blob once however many
paths hold it, and joins the findings back to all paths.

Defined results: a null text is the empty blob; empty texts have no findings; repeated rows
are each returned; an empty table gives an empty result; extra columns are ignored. Whole
texts are scanned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.common import in_arrow, pick, slices, written

FINDINGS = "array<struct<rule: string, version: string, start: int, end: int>>"
LEDGER = f"blob binary, scanned array<string>, findings {FINDINGS}"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern; those whose group is shorter than `least` are dropped. hint: text that every match holds."""

    name: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    hint: str = ""

    @property
    def version(self) -> str:
        return hashlib.sha256(repr(self).encode()).hexdigest()[:12]

    @property
    def tag(self) -> str:
        return f"{self.name}@{self.version}"


# The base rules' patterns, and lengths below which a match is dropped.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, hint="AKIA"),
    Rule("hex", r"[0-9a-f]+", 24),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
)
RULES = BASE_RULES + MORE_RULES


class Scanner:
    """Finds the spans of some rules in a text, as code points, end exclusive."""

    def __init__(self, rules: Sequence[Rule]):
        # a plain class repeated: runs shorter than the least length cannot hold a longer one
        self.rules = []
        for r in rules:
            whole_run = r.group == 0 and r.least and re.fullmatch(r"\[[^]]+\]\+", r.pattern)
            pattern = f"{r.pattern[:-1]}{{{r.least},}}" if whole_run else r.pattern
            self.rules.append((r, re.compile(pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0))))

    def find(self, text: str) -> list[dict]:
        out = []
        for r, pattern in self.rules:
            if r.hint not in text:
                continue
            for m in pattern.finditer(text):
                if m.end(r.group) - m.start(r.group) >= r.least:
                    out.append({"rule": r.name, "version": r.version, "start": m.start(), "end": m.end()})
        return out


def blob_of(text):
    """The content address of a text column."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger's next rows (LEDGER), for versions with a text column: one for each blob that some rule has not
    scanned, naming the rules that scanned it now. Append them to the ledger; that makes a rerun scan nothing."""
    blobs = pick(versions, "text").select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))  # copies meet in the scanning tasks first
    tags = F.array(*(F.lit(r.tag) for r in rules))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("scanned")).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(tags, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("todo") > 0)
    else:
        blobs = blobs.withColumn("todo", tags)
    by_tag = {r.tag: r for r in rules}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners: dict[tuple, Scanner] = {}
        kind = pa.list_(pa.struct([("rule", pa.string()), ("version", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in slices(batches):
            todo, found = b.column(2).to_pylist(), []
            for t, tags_left in zip(b.column(1).to_pylist(), todo, strict=True):
                k = tuple(tags_left)
                if k not in scanners:
                    scanners[k] = Scanner([by_tag[x] for x in k])
                found.append(scanners[k].find(t))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.binary()), pa.array(todo, pa.list_(pa.string())), pa.array(found, kind)], names=["blob", "scanned", "findings"])

    return in_arrow(blobs.select("blob", "text", "todo"), scan, LEDGER)


def scan_into(versions: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger kept under path, after it has got what versions lacked in it."""
    spark = versions.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    begun = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    ledger = spark.read.schema(LEDGER).parquet(path) if begun else None
    scan_unseen(versions, ledger, rules).write.mode("append" if begun else "overwrite").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


#: Parts that the copies of a text with findings are dealt to.
SALT = 8


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, blob, findings) of every row of versions: what the ledger's current rule versions found, by start, then rule as listed."""
    paths = pick(versions, "doc_id", "text").select("doc_id", blob_of(F.col("text")).alias("blob"))
    rank = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.tag), F.lit(i))))
    current = F.filter(F.flatten("all"), lambda f: F.element_at(rank, F.concat(f["rule"], F.lit("@"), f["version"])).isNotNull())
    ordered = F.array_sort(
        F.array_distinct(F.transform(current, lambda f: F.struct(f["start"].alias("start"), F.element_at(rank, F.concat(f["rule"], F.lit("@"), f["version"])).alias("rank"), f["end"].alias("end"), f["rule"].alias("rule"))))
    )
    known = ledger.filter(F.size("findings") > 0).groupBy("blob").agg(F.collect_list("findings").alias("all")).select("blob", ordered.alias("findings"))
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))  # few blobs have findings, many paths may share one
    paths = paths.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    return paths.join(known, ["blob", "salt"], "left").select("doc_id", "blob", F.coalesce("findings", F.array().cast("array<struct<start: int, rank: int, end: int, rule: string>>")).alias("findings"))


def spans_text(findings):
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["rule"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """One row per document: doc_id, the counts of the base kinds, the digest of the base spans and all spans as text.
    ledger: the path of one to read and keep; without it all texts are scanned."""
    found = findings_by_path(docs, written(scan_unseen(docs), "secret-ledger") if ledger is None else scan_into(docs, ledger))
    base = [r.name for r in BASE_RULES]

    def count(name: str):
        return F.size(F.filter("findings", lambda f: f["rule"] == name)).cast("long").alias(f"n_{name}")

    digest = F.sha2(spans_text(F.filter("findings", lambda f: f["rule"].isin(base))), 256)
    return found.select("doc_id", *map(count, base), digest.alias("base_sha256"), spans_text(F.col("findings")).alias("spans"))
