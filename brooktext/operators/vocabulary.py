"""How much of a text lies in a vocabulary.

A vocabulary is a table of unique words. It is broadcast when counting it shows no more than `BROADCAST_WORDS` words; a
larger one is joined by a shuffle of the distinct words that the texts have, which Spark splits where a word is very
frequent. Counts are summed up in each task first, where a text's words lie together, so that only one row a text is
shuffled then. Rows are told apart by id and text (by its hash), as an id may be null or stand in several rows; results have a row for
each row, equal rows included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text, tokens

BROADCAST_WORDS = 500_000
#: Bytes that a core reads as one part; what has fewer for each core is dealt out.
PART_BYTES = 128 << 20


def bounded(vocabulary: DataFrame, limit: int = BROADCAST_WORDS) -> DataFrame:
    """The vocabulary, marked for broadcast if it is within the limit."""
    return F.broadcast(vocabulary) if vocabulary.limit(limit + 1).count() <= limit else vocabulary


def spread(df: DataFrame) -> DataFrame:
    """df dealt over the cores if it is read from fewer files than there are, which are too small to be split over them; else as it is. For tables as they are
    read, before anything is computed from their texts."""
    spark, files = df.sparkSession, df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if not 0 < len(files) < cores:
        return df
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0]
    return df.repartition(cores) if size <= cores * PART_BYTES else df


def words_of(items: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct words of all texts: a vocabulary."""
    return items.select(F.explode(tokens(text(text_col))).alias("word")).distinct()


def text_hash(text_col: str) -> Column:
    return F.xxhash64(text(text_col))


def token_rows(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, text_hash, n_tokens and word, a row for each distinct word of each text; a null word for a text without any."""
    rows = df.select(id_col, text_hash(text_col).alias("text_hash"), tokens(text(text_col)).alias("tokens"))
    return rows.select(id_col, "text_hash", F.size("tokens").cast("long").alias("n_tokens"), F.explode_outer("tokens").alias("word"))


def text_coverage(df: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, n_tokens, n_rows, n_matched, coverage of each distinct id and text; n_rows: in how many rows they stand."""
    known = bounded(vocabulary.select("word")).withColumn("known", F.lit(1))
    joined = token_rows(df, id_col, text_col).join(known, "word", "left")
    counts = joined.groupBy(id_col, "text_hash", "n_tokens").agg(F.count("*").alias("n_words"), F.count("known").alias("n_known"))
    n_rows = F.expr("n_words div greatest(n_tokens, 1)")
    counts = counts.withColumn("n_rows", n_rows).withColumn("n_matched", F.expr("n_known div n_rows")).drop("n_words", "n_known")
    return counts.withColumn("coverage", share(F.col("n_matched"), F.col("n_tokens")))


def coverage(df: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_matched, coverage for each row: the share of its distinct words that the vocabulary has; 0 without words."""
    return repeated(text_coverage(df, vocabulary, id_col, text_col)).select(id_col, "n_tokens", "n_matched", "coverage")


def repeated(df: DataFrame) -> DataFrame:
    """Each row n_rows times."""
    return df.withColumn("copy", F.explode(F.expr("sequence(1L, n_rows)"))).drop("copy", "n_rows")


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def matched_words(df: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, words: each text's words that the vocabulary has, sorted; texts without any are left out."""
    rows = token_rows(df, id_col, text_col).join(bounded(vocabulary.select("word")), "word", "left_semi")
    held = rows.groupBy(id_col, "text_hash").agg(F.sort_array(F.collect_set("word")).alias("words"), F.count("*").alias("n_words"))
    return repeated(held.withColumn("n_rows", F.expr("n_words div size(words)"))).select(id_col, "words")


def membership(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, present: whether the vocabulary has each word."""
    known = bounded(vocabulary.select("word")).withColumn("known", F.lit(True))
    return words.join(known, "word", "left").select("word", F.coalesce("known", F.lit(False)).alias("present"))
