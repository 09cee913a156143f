"""Judging by an asynchronous service: attempts in, resolved scores or texts out.

Attempts are rows (batch, task, attempt from 1, status, content). PENDING is anything but SUCCESS, FAILED and ERROR, the
last standing for a request that raised. Rounds are bounded by the service's patience (`ROUNDS`), which is part of the
semantics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.responses import UNRESOLVED, score
from ..functions.text import strip, text

ROUNDS = 40
ENDED = ("SUCCESS", "FAILED", "ERROR")


def polled_scores(attempts: DataFrame, tasks: DataFrame | None = None, key: str = "task_id", rounds: int = ROUNDS) -> DataFrame:
    """key, status, attempt, score: the first ended attempt decides. FAILED and ERROR are 0; never ended is 0.01, UNRESOLVED.

    tasks: all keys that are owed a result; those without attempts are unresolved too."""
    ended = attempts.where((F.col("attempt") <= rounds) & F.col("status").isin(*ENDED))
    first = ended.groupBy(key).agg(F.min(F.struct("attempt", "status", "content")).alias("f")).select(key, "f.*")
    owed = (attempts if tasks is None else tasks).select(key).distinct()
    out = owed.join(first, key, "left")
    value = F.when(F.col("status").isNull(), F.lit(UNRESOLVED)).when(F.col("status") == "SUCCESS", score(F.col("content"))).otherwise(F.lit(0.0))
    return out.select(key, F.coalesce("status", F.lit("UNRESOLVED")).alias("status"), F.coalesce("attempt", F.lit(0)).cast("long").alias("attempt"), value.alias("score"))


def padded(scores: DataFrame, size: int, batch: str = "batch_id") -> DataFrame:
    """A batch's scores (batch, pos, score) made `size` long: slots without a task stay at 0.01. More than `size` tasks are an error."""
    slots = scores.select(batch).distinct().withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    checked = scores.withColumn("pos", F.when(F.col("pos") < size, F.col("pos")).otherwise(F.raise_error(F.lit("more tasks than slots in a batch"))))
    return slots.join(checked, [batch, "pos"], "left").withColumn("score", F.coalesce("score", F.lit(UNRESOLVED)))


def polled_texts(attempts: DataFrame, batch: str = "batch_id", key: str = "task_id", rounds: int = ROUNDS) -> DataFrame:
    """batch, key, status, result. SUCCESS gives the stripped content, FAILED and ERROR an error text, an unfinished task "".

    A batch is polled until a round in which none of its open tasks is pending. An empty success leaves its task open, so
    that it is polled again while others make the batch go on."""
    told = F.when(F.col("status") == "SUCCESS", strip(text("content"))).when(F.col("status") == "FAILED", F.concat(F.lit("Error processing "), F.col(key).cast("string"))).when(F.col("status") == "ERROR", F.concat(F.lit("API Error: "), text("content"))).otherwise(F.lit(""))
    polls = attempts.where(F.col("attempt") <= rounds).withColumn("told", told)
    first = polls.where("told <> ''").groupBy(batch, key).agg(F.min(F.struct("attempt", "status", "told")).alias("f"))
    open_ = polls.join(first.select(batch, key, F.col("f.attempt").alias("until")), [batch, key], "left").where(F.col("until").isNull() | (F.col("attempt") < F.col("until")))
    waiting = open_.where(~F.col("status").isin(*ENDED)).select(batch, "attempt").distinct()
    # the rounds that made the batch go on are those from the first without a gap; a batch has `rounds` of them at most
    run = waiting.withColumn("n", F.row_number().over(Window.partitionBy(batch).orderBy("attempt"))).where("attempt = n").groupBy(batch).agg((F.max("attempt") + 1).alias("last"))
    tasks = attempts.select(batch, key).distinct().join(first, [batch, key], "left").join(run, batch, "left")
    got = F.col("f").isNotNull() & (F.col("f.attempt") <= F.coalesce("last", F.lit(1)))
    return tasks.select(batch, key, F.when(got, F.col("f.status")).otherwise(F.lit("UNRESOLVED")).alias("status"), F.when(got, F.col("f.told")).otherwise(F.lit("")).alias("result"))


def all_done(attempts: DataFrame, batch: str = "batch_id") -> DataFrame:
    """batch, attempt, done: whether none of a round's tasks is pending."""
    return attempts.groupBy(batch, "attempt").agg(F.bool_and(F.col("status").isin(*ENDED)).alias("done"))
