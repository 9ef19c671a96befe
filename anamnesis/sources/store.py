"""A store of memories as immutable Parquet versions with an atomic pointer.

A version is a folder of a name that only its writer knows; the file CURRENT.<n> says that it is
version n and holds that name, and the greatest n counts. A writer finishes its folder before it
makes that file, making it fails where another writer has made version n, and no such file is
ever deleted. So a reader sees a whole version or the one before, and of two
writers that read one version the second fails, without touching what the first has published.
Beside the memories lie their access log and their vectors, to which writers only append.
All access goes through Hadoop's file system, so a path may lie in any store Spark reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.operators import retrieval

SCHEMA = """id long, text string, norm_hash string, memory_type string, confidence_score double, decay_rate double,
importance double, ttl_days double, scope string, subject string, created_at timestamp, updated_at timestamp,
last_accessed_at timestamp, expires_at timestamp, is_archived boolean, archived_reason string, supersedes long,
superseded_by long, access_count long, source string, session_id string"""

ACCESS = "memory_id long, accessed_at timestamp, query string, score double"
VECTORS = "memory_id long, model string, dim int, vec array<float>, text_hash string, updated_at timestamp"
VERDICTS = "pair string, same boolean"

#: What a missing or null value of an older store becomes.
DEFAULTS = {"memory_type": "'fact'", "confidence_score": "1.0D", "decay_rate": "0.1D", "importance": "0.5D", "scope": "'global'", "updated_at": "created_at", "is_archived": "false", "access_count": "0L", "source": "'tool'"}


def migrated(rows: DataFrame) -> DataFrame:
    """rows of any earlier layout in the present one."""
    from pyspark.sql.types import _parse_datatype_string

    out = []
    for f in _parse_datatype_string(SCHEMA).fields:
        value = F.col(f.name) if f.name in rows.columns else F.lit(None)
        rows = rows.withColumn(f.name, value.cast(f.dataType))
        out.append(F.expr(f"coalesce({f.name}, {DEFAULTS[f.name]})").alias(f.name) if f.name in DEFAULTS else F.col(f.name))
    return rows.select(*out)


class Store:
    """memories under a path; every change reads the current version and writes the next."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        found = self._fs.globStatus(self._path(f"{self.path}/CURRENT.*"))
        return max((int(f.getPath().getName().split(".")[1]) for f in found or []), default=0)

    def _named(self, n: int) -> str:
        stream = self._fs.open(self._path(f"{self.path}/CURRENT.{n}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self) -> DataFrame:
        n = self.version()
        if not n:
            return self.spark.createDataFrame([], SCHEMA)
        return migrated(self.spark.read.parquet(f"{self.path}/{self._named(n)}"))

    def write(self, rows: DataFrame, after: int | None = None) -> int:
        """Publishes rows as the next version, that after the one they were made from."""
        n = (self.version() if after is None else after) + 1
        name = f"memories-{n}-{uuid.uuid4().hex}"
        migrated(rows).write.parquet(f"{self.path}/{name}")
        out = self._fs.create(self._path(f"{self.path}/CURRENT.{n}"), False)  # fails if another writer has made version n
        out.write(bytearray(name.encode()))
        out.close()
        return n

    def index(self, stems: bool = True) -> retrieval.Index:
        """The index of the current version, built when it is first asked for, and again if it is not whole."""
        at = f"{self.path}/index-{self.version()}-{'stems' if stems else 'words'}"
        if not self._fs.exists(self._path(f"{at}/lengths/_SUCCESS")):
            self._fs.delete(self._path(at), True)
            return retrieval.build_index(self.read(), stems, at)
        return retrieval.read_index(self.spark, at, stems)

    def reindexed(self, stems: bool = True) -> retrieval.Index:
        """The index, rebuilt where its rows are not those of the memories."""
        index = self.index(stems)
        if retrieval.index_is_sane(index, self.read()):
            return index
        self._fs.delete(self._path(f"{self.path}/index-{self.version()}-{'stems' if stems else 'words'}"), True)
        return self.index(stems)

    def _appended(self, name: str, schema: str) -> DataFrame:
        if not self._fs.exists(self._path(f"{self.path}/{name}")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def log(self, rows: DataFrame) -> None:
        """Appends to the access log."""
        rows.select("memory_id", "accessed_at", "query", "score").write.mode("append").parquet(f"{self.path}/access")

    def accesses(self) -> DataFrame:
        return self._appended("access", ACCESS)

    def add_vectors(self, rows: DataFrame) -> None:
        """Appends vectors (memory_id, model, vec, text_hash); of a memory and model the newest counts."""
        rows.select("memory_id", "model", F.size("vec").alias("dim"), "vec", "text_hash", F.current_timestamp().alias("updated_at")).write.mode("append").parquet(f"{self.path}/vectors")

    def vectors(self) -> DataFrame:
        """The newest vector of each memory and model."""
        newest = F.max_by(F.struct("dim", "vec", "text_hash", "updated_at"), F.struct("updated_at", F.xxhash64("vec"))).alias("v")
        return self._appended("vectors", VECTORS).groupBy("memory_id", "model").agg(newest).select("memory_id", "model", "v.*")

    def verdicts(self) -> DataFrame:
        return self._appended("verdicts", VERDICTS)

    def add_verdicts(self, rows: DataFrame) -> None:
        rows.select("pair", "same").write.mode("append").parquet(f"{self.path}/verdicts")

    def change(self, by: Callable[[DataFrame], DataFrame]) -> int:
        n = self.version()
        return self.write(by(self.read()), n)

    def wipe(self, include_archived: bool = True) -> int:
        return self.change(lambda m: m.limit(0) if include_archived else m.filter("is_archived"))

    def restore(self, ids: list[int]) -> int:
        back = F.col("id").isin(ids)
        return self.change(lambda m: m.withColumns({"is_archived": F.col("is_archived") & ~back, "archived_reason": F.when(~back, F.col("archived_reason"))}))

    def archive(self, ids: list[int], reason: str) -> int:
        gone = F.col("id").isin(ids) & ~F.col("is_archived")
        return self.change(lambda m: m.withColumns({"archived_reason": F.when(gone, F.lit(reason)).otherwise(F.col("archived_reason")), "is_archived": F.col("is_archived") | gone}))

    def delete(self, ids: list[int]) -> int:
        return self.change(lambda m: m.filter(~F.col("id").isin(ids)))


def text_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("py", "md", "txt", "json", "toml", "yaml", "yml", "cfg")) -> DataFrame:
    """(name, text) of the text files under path, without hidden folders and caches."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").text(path, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("text"))
    return rows.filter(~F.col("name").rlike(r"/(\.[^/]+|__pycache__)/"))


def files_under(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, modified) of the files right under path; no content is read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of the lines of text files, blank ones left out, numbered by file and place."""
    rows = spark.read.text(path).filter(F.trim("value") != "").withColumn("id", F.monotonically_increasing_id())
    return rows.select("id", F.col("value").alias("text"))
