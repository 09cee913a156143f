"""The corpus pipeline: documents that are good, one of each group of near copies, free of benchmark items and of personal data, as piece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it decides takes effect on all that the stage before
kept. All but the last return the columns of `documents`.

Defined results: null and empty texts are scored like others by the first stage and pass the rest, with no ids; texts
of any length are taken whole; of rows with equal texts that of the least doc_id stays, and rows that share a doc_id
stay or go together; rows without a doc_id are linked with none; columns beyond those of `documents`, whatever their
names, stay as they are, but for one named `ids`, `round_trip` or `n_pieces`, which the last stage replaces; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooktext.llm.decontamination import drop_contaminated
from brooktext.llm.near_duplicates import drop_near_duplicates
from brooktext.llm.pieces import encode_pieces
from brooktext.llm.pii import key_of, replace_pii
from brooktext.llm.quality import keep_good
from brooktext.llm.shared import discard, persist

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group at a similarity of 0.8 or more of five-word shingles."""
    return drop_near_duplicates(docs, n_words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates for personal data; n_chars follows the new text."""
    return replace_pii(docs, key_of(spark))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the text's piece ids, their number, and whether decoding them gives the text back."""
    return encode_pieces(docs, PIECES, check="round_trip").withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("pieces", pieces)]
#: SQL can express none of these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents, one after another; between stages the rows are written to the shared folder,
    and deleted there when the next stage's have been written."""
    df, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        df = persist(stage(spark, df, sf_dir), f"pipeline-{name}")
        discard(*written)
        written = [df]
    return STAGES[-1][1](spark, df, sf_dir)
