"""What the training-data operators share: column picking, word rules, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word: a run of anything but the six ASCII white-space characters. bytes.split() cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by exact spelling, so that extra columns whose names
    differ in case, or repeat, cannot make a reference ambiguous. The first of equals counts."""
    have = df.columns
    flat = df.toDF(*(f"_{i}" for i in range(len(have))))
    return flat.select(*(F.col(f"_{have.index(n)}").alias(n) for n in names))


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ... so that equal names cannot clash."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased; every other character as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def n_words(c: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Only a local
    session without one gets a temporary folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/anamnesis-work"


#: Tables that written() made and nothing has deleted, by path.
_tables: set[str] = set()


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and lost executors lose nothing. Whoever has
    replaced the table by a later one calls discard(); clear() deletes all others once results are saved."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _tables.discard(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.work_path)


def clear(spark: SparkSession) -> None:
    """Deletes every table that is left. Results that are not saved yet read some of them, so save first."""
    for path in list(_tables):
        _delete(spark, path)


def texts_as_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without decoding."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


#: Bytes of an Arrow batch on its way to Python, about; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20


def in_arrow(df: DataFrame, judge: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow in a session whose batches are at most BATCH_BYTES where Spark's default would be eight times
    that: a worker holds its batch, what is cut from it and Python objects of a slice. Another bound of the session stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) == "67108864b":
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(judge, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that Python objects of one slice only are alive."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
