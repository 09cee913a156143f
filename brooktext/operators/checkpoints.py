"""Checkpoints of tables, as folders whose names end in their step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import number_suffix
from ..sources.files import names_in

MARK = "checkpoint-"


def latest(names: DataFrame) -> DataFrame:
    """name and step of the checkpoint with the highest step, by number; step 0 and no name if there is none. Names whose end isn't a number are skipped."""
    steps = names.where(F.contains("name", F.lit(MARK))).select("name", number_suffix(F.col("name")).alias("step")).where("step is not null")
    return steps.agg(F.max(F.struct("step", "name")).alias("m")).select(F.col("m.name").alias("name"), F.coalesce("m.step", F.lit(0).cast("long")).alias("step"))


def save(df: DataFrame, folder: str, step: int) -> str:
    """Writes a table as the checkpoint of a step, in place of an earlier one of that step."""
    path = f"{folder.rstrip('/')}/{MARK}{step}"
    df.write.mode("overwrite").parquet(path)
    return path


def load(spark: SparkSession, folder: str) -> tuple[DataFrame | None, int]:
    """The latest checkpoint's table and its step; (None, 0) if there is none."""
    found = latest(names_in(spark, folder)).first()
    return (spark.read.parquet(f"{folder.rstrip('/')}/{found.name}"), found.step) if found.name else (None, 0)
