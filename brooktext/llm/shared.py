"""What the operators share: the folder that driver and executors both see, and safe column picking."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder as a URI. Where none is set, a folder of our own is set under a local master; others refuse, as
    each executor would write to its own disk."""
    base = spark.conf.get(SHARED_CONF, None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set {SHARED_CONF} to a folder that driver and executors share (the master is {master})")
        base = "file://" + tempfile.mkdtemp(prefix="brooktext-")
        spark.conf.set(SHARED_CONF, base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def persist(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and no executor's loss can undo it. by: a column of few
    values, each of which gets a folder of its own, so that a filter on it reads no other."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.persisted_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes what persist() wrote, once nothing reads it any more."""
    for df in tables:
        delete(df.sparkSession, df.persisted_at)


def free_name(name: str, *columns: str) -> str:
    """The name, with marks before it until none of the columns has it (in any case, as Spark compares them)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Rows in an Arrow batch at most, so that a worker holds a few MB of text at a time. The setting is the session's."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, rows + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


def chunks(items: list[str], chars: int) -> Iterator[list[str]]:
    """The items in order, in lists of about `chars` characters, or of one item that is longer."""
    at = held = 0
    for i, t in enumerate(items):
        held += len(t)
        if held >= chars:
            yield items[at : i + 1]
            at, held = i + 1, 0
    if at < len(items):
        yield items[at:]


def give_back() -> None:
    """Returns the memory that Arrow and the C library keep for reuse."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def tidy(run, every: int = 8):
    """run, for mapInArrow, giving memory back now and then and at the end of a task, as workers live on for other tasks."""

    def tidied(batches):
        try:
            for k, out in enumerate(run(batches), 1):
                yield out
                if k % every == 0:
                    give_back()
        finally:
            give_back()

    return tidied


def file_system(uri: str):
    """pyarrow's file system for a URI or plain path, and the path within it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def id_text(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def fold(mod: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod `mod`; a null id counts as empty text."""
    return F.pmod(F.crc32(id_text(col)), F.lit(mod))


def texts(batch, name: str = "text") -> list[str]:
    """The texts of an Arrow batch; null is empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def hash_sample(df: DataFrame, rows: int, bound: int, col: str = "doc_id") -> DataFrame:
    """Of df, which has or matches `rows` rows, those of the lowest hashes of `col`: about `bound` rows, all of them if there are no more."""
    if rows <= bound:
        return df
    steps = 1 << 40
    return df.where(F.pmod(F.xxhash64(F.col(f"`{col}`"), F.lit(40)), F.lit(steps)) < int(steps * bound / rows))
