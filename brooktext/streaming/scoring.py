"""Responses that arrive as files, scored as they come.

The plan is stateless: each micro-batch is parsed and scored against a fixed vocabulary and written to a folder named by the
micro-batch, so that one that is repeated after a failure replaces itself. A micro-batch's rows are written once with a key of their own, by which
parts and coverage of a response are put together, whatever its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.responses import parsed
from ..operators.metrics import write_series
from ..operators.tables import discard, keyed
from ..operators.vocabulary import coverage

RESPONSES = "id bigint, response string"


def read_responses(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def start_scoring(responses: DataFrame, vocabulary: DataFrame, out: str, checkpoint: str, once: bool = True, series: str | None = None) -> StreamingQuery:
    """id, rewrite, words, n_tokens, n_matched, coverage of each response, under out/epoch=<n>. series: a folder for the series of each micro-batch
    as a step (from 1), of which the mean coverage is known."""

    def write(rows: DataFrame, epoch: int) -> None:
        rewrite, words = parsed(F.col("response"))
        parts = keyed(rows.select("id", rewrite.alias("rewrite"), words.alias("words")), "micro-batch")
        parts.join(coverage(parts, vocabulary, "row_key", "words"), "row_key").drop("row_key").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        discard(parts)
        if series:
            mean = rows.sparkSession.read.parquet(f"{out}/epoch={epoch}").agg(F.avg("coverage").alias("m")).where("m is not null")
            write_series(mean.select(F.lit(epoch + 1).cast("long").alias("step"), F.create_map(F.lit("custom/wordbank"), "m").alias("stats")), series)

    writer = responses.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
