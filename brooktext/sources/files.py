"""The inputs and outputs that aren't plain tables. All go through Spark's readers and writers, so any of its file systems will do, and large files are
read by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import expanded, strip
from ..operators.tables import files_in, newest, publish, versions, written_once
from .arrays import json_elements

DICTIONARY = "word string, meaning array<string>"
#: Columns that tell the order of a dictionary's lines.
LINE_ORDER = ("file", "block", "place")
PAIRS = "batch_original_sentence array<string>, responses array<string>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects with an original_sentence: a row each. Elements that are no such objects give null."""
    return json_elements(spark, path).select(F.from_json("json", "original_sentence string").getField("original_sentence").alias("original_sentence"))


def read_prompt(spark: SparkSession, path: str) -> DataFrame:
    """A whole file as one row's text."""
    return spark.read.text(path, wholetext=True)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of word and meanings, with the line's place. A bad line is an error that names file, block and text; a blank one is skipped, missing
    meanings are none.

    A file is read in blocks by several tasks. A line's place is that of the block it begins in, and its number among the lines of the task that
    reads the block: of two lines of a file, the later one has the higher (block, place)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    rows = lines.where(strip(F.col("value")) != "").withColumn("e", F.from_json("value", f"{DICTIONARY}, bad string", {"columnNameOfCorruptRecord": "bad"}))
    where = F.concat(F.lit(" in "), F.col("file"), F.lit(", block from byte "), F.col("block").cast("string"), F.lit(": "), F.substring("value", 1, 200))
    word = F.when(F.col("e").isNull() | F.col("e.bad").isNotNull(), F.raise_error(F.concat(F.lit("no dictionary entry"), where)))
    word = word.when(F.col("e.word").isNull(), F.raise_error(F.concat(F.lit("a dictionary entry lacks its word"), where))).otherwise(F.col("e.word"))
    return rows.select("file", "block", "place", word.alias("word"), F.col("e.meaning").alias("meaning"))


def vocabulary_of(entries: DataFrame, *order: str) -> DataFrame:
    """word and meaning, one row a word: of equal words the last in `order`; placeholders in its meanings expanded."""
    last = entries.groupBy("word").agg(F.max_by("meaning", F.struct(*order)).alias("meaning"))
    return last.select("word", expanded(F.col("meaning"), F.col("word")).alias("meaning"))


def read_judge_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The nested batches of a judge test set as rows: batch_id, pos, original, response. The longer list of a batch is cut to the shorter. Batches are numbered
    in the order of their file."""
    found = written_once(json_elements(spark, path, "batches"), "judge-batches")
    sizes = found.groupBy("file", "block").agg(F.count("*").alias("n"))  # a row for each block of a file
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    at = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    numbered = found.withColumn("nth", at).join(F.broadcast(sizes.select("file", "block", before.alias("before"))), ["file", "block"])
    batches = numbered.select((F.col("before") + F.col("nth")).cast("int").alias("batch_id"), F.from_json("json", PAIRS).alias("b"))
    both = F.slice(F.arrays_zip("b.batch_original_sentence", "b.responses"), F.lit(1), F.least(F.size("b.batch_original_sentence"), F.size("b.responses")))
    rows = batches.where("b.batch_original_sentence is not null and b.responses is not null").select("batch_id", F.posexplode(both).alias("pos", "pair"))
    return rows.select("batch_id", "pos", F.col("pair.batch_original_sentence").alias("original"), F.col("pair.responses").alias("response"))


def modified(spark: SparkSession, path: str) -> float | None:
    """When the newest file under a path was changed, in seconds; None if there is none."""
    return files_in(spark, path).agg(F.max(_seconds(F.col("modified")))).first()[0]


def _seconds(at: Column) -> Column:
    return at.cast("double")


def names_in(spark: SparkSession, path: str) -> DataFrame:
    """The names of what lies in a folder: name, path; none if the folder is missing. Folders without any file in them, and hidden files, aren't seen."""
    name = F.substring_index("name", "/", 1)
    found = files_in(spark, path).select(name.alias("name"), F.expr("concat(left(path, length(path) - length(name)), substring_index(name, '/', 1))").alias("path"))
    return found.distinct()


def load_vocabulary(spark: SparkSession, source: str, snapshot: str) -> DataFrame:
    """The vocabulary of a dictionary, parsed once: a snapshot is used until its source has changed since it was made, or if the source is gone.

    A snapshot has versions: whoever reads it while another is made sees the one before, and a failed one is never seen. What is
    compared is the source's own time then and now, never the clocks of two stores."""
    since, known = modified(spark, source), versions(spark, snapshot)
    if not known or since is not None and repr(since) != known[-1][1]:
        publish(vocabulary_of(read_dictionary(spark, source), *LINE_ORDER), snapshot, repr(since))
    return newest(spark, snapshot, DICTIONARY)
