"""Tables that are written once: because their rows must not be computed again, or because others read them meanwhile."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; only a local master may do without, as others' executors share no disk."""
    base = spark.conf.get(SHARED_CONF, None)
    if not base:
        if not re.match(r"local(\[[^\]]*\])?$", spark.conf.get("spark.master")):
            raise ValueError(f"set {SHARED_CONF} to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="brooktext-")
        spark.conf.set(SHARED_CONF, base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written_once(df: DataFrame, name: str) -> DataFrame:
    """df, written to the cluster's shared folder and read back: what made it runs once, however often the result is used. `written_at` of
    the result names the folder for `discard`."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def keyed(df: DataFrame, name: str, key: str = "row_key") -> DataFrame:
    """df, written once, with a key of its own for each row, equal rows included."""
    return written_once(df.withColumn(key, F.monotonically_increasing_id()), name)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file systems. Spark has no public call for that."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes what written_once() wrote, once nothing reads it any more."""
    for df in tables:
        delete(df.sparkSession, df.written_at)


def files_in(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path (as Spark writes it), name (below the folder), modified and length of all files under a folder or of one file; contents are not read.
    None if there is nothing."""
    base = urlparse(path).path if "://" in path or path.startswith("file:") else path
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, name string, modified timestamp, length bigint")
    below = F.substring_index("path", base.rstrip("/") + "/", -1)
    return found.select("path", below.alias("name"), F.col("modificationTime").alias("modified"), "length")


# Versions: each is a folder of its own, which counts from the moment at which its row in `commits` is there. Commits are files that
# appear whole and are never changed, so that readers see one version or another, and what fails half way is never seen.
COMMIT = "version string, note string"


def publish(df: DataFrame, folder: str, note: str = "", keep: int = 2) -> str:
    """Writes df as the newest version of a table and returns the version. Of older ones the last `keep - 1` stay for those who read them now."""
    spark, folder = df.sparkSession, folder.rstrip("/")
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/data-{version}")
    spark.createDataFrame([(version, note)], COMMIT).coalesce(1).write.json(f"{folder}/commits/{version}")
    for old, _ in versions(spark, folder)[:-keep]:
        delete(spark, f"{folder}/commits/{old}")
        delete(spark, f"{folder}/data-{old}")
    return version


def versions(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(version, note) of all versions that count, the newest last. A few rows: publish() keeps few."""
    there = files_in(spark, f"{folder.rstrip('/')}/commits", "*.json")
    if not there.limit(1).count():
        return []
    rows = spark.read.schema(COMMIT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{folder.rstrip('/')}/commits")
    return sorted((r.version, r.note) for r in rows.collect())


def newest(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame | None:
    """The newest version of a table; None if there is none."""
    known = versions(spark, folder)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{folder.rstrip('/')}/data-{known[-1][0]}") if known else None
