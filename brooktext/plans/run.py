"""The whole loop over epochs, in chunks that are committed one by one, so that a run that was killed goes on where it was.

A chunk is `save_every` steps. Its results go to folders of its own, which a repetition replaces; then its checkpoint is written, and at last its
row in the commit log. What has no commit is never read, and is run again; what has one is never run again.

The work grows with the sentences, not with their number times the chunks': a pass, about an epoch, deals them with their texts into a folder for
each group of chunks, and a group reads its own folder only. A group is one chunk, as a model may have learned from the one before; where the model
steps stay the same, `ahead` chunks are scored in one go, and learned from and committed one by one as ever.

    run/deal      the epochs' batches: key, epoch, step, batch_id, pos (written once, in one piece)
    run/words     the vocabulary
    run/dealt     the present pass: a folder for each group with its sentences (deleted at the end)
    run/scored    a folder for each chunk: the scored responses
    run/series    step, tag, value
    run/state     checkpoint-<step>: the state after a chunk
    run/commits   a row for each chunk
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batches import epoch_batches, every
from ..operators.checkpoints import MARK, save
from ..operators.metrics import step_log, write_series
from ..operators.models import ModelStep
from ..operators.tables import delete, newest, publish, versions
from .config import Settings
from .scoring import scored_responses, step_statistics

#: Takes the state before a chunk (None at first) and the chunk's scored rows; returns the state after it.
Learn = Callable[[DataFrame | None, DataFrame], DataFrame]
#: The columns that folders are named by.
GROUP, UPTO = "run_group", "run_upto"


def totals(state: DataFrame | None, scored: DataFrame) -> DataFrame:
    """The default state: how many responses there were, and the sums of their coverage, expression and reward."""
    names = ("coverage", "expression", "reward")
    new = scored.select(F.lit(1).cast("long").alias("n"), *names)
    rows = new.unionByName(state) if state is not None else new
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names))


def commits(spark: SparkSession, folder: str) -> dict[int, str]:
    """The last step of each committed chunk, and its note: one row a chunk."""
    return {int(v): note for v, note in versions(spark, folder)}


def scored_so_far(spark: SparkSession, folder: str) -> DataFrame | None:
    """The scored responses of all committed chunks."""
    done = commits(spark, folder)
    return spark.read.parquet(*(f"{folder}/scored/{_name(last)}" for last in sorted(done))) if done else None


def _name(last: int) -> str:
    return f"{UPTO}={last:012d}"


#: Rows in a file: at most about so many, and at least, where files are for the cores' sake.
FILE_ROWS, LEAST_ROWS = 100_000, 250


def _dealt(rows: DataFrame, by: str, key: str, files: int):
    """A writer of rows into a folder for each value of `by`, of about so many files each."""
    return rows.repartition(by, F.pmod(F.xxhash64(key), F.lit(files))).write.mode("overwrite").partitionBy(by)


def run(
    sentences: DataFrame, key: str, generate: ModelStep, vocabulary: DataFrame, judge: ModelStep, folder: str, settings: Settings,
    word_filter: ModelStep | None = None, learn: Learn = totals, rounded=None, order: Column | None = None, log_file: str | Path | None = None, ahead: int = 1,
) -> int:
    """Runs, or goes on with, a loop over sentences; returns its last step.

    key: a unique column of sentences. generate adds `response` to a group's sentences; the rest is as in scored_responses(), whose key is `task`, a
    sentence in an epoch. order: what shuffles, by default the key. ahead: the chunks of a group; more than one only where no model step depends on
    what is learned. Chunks that were scored, but not committed, are scored again by a run that goes on."""
    spark, folder = sentences.sparkSession, folder.rstrip("/")
    deal = newest(spark, f"{folder}/deal")
    if deal is None:
        ids = sentences.select(key)
        publish(epoch_batches(ids, F.col(key).cast("string") if order is None else order, settings.batch_size, settings.epochs), f"{folder}/deal")
        deal = newest(spark, f"{folder}/deal")
    last = deal.agg(F.max("step")).first()[0] or 0
    done = max(commits(spark, folder), default=0)
    if done >= last:
        return last
    log = step_log(str(log_file)) if log_file else None
    state = spark.read.parquet(f"{folder}/state/{MARK}{done}") if done else None
    vocabulary.select("word").write.mode("overwrite").parquet(f"{folder}/words")
    known = spark.read.schema("word string").parquet(f"{folder}/words")
    group = settings.save_every * ahead
    groups, n_rows = max(1, last // settings.epochs // group), settings.batch_size * group
    files = max(n_rows // FILE_ROWS + 1, min(spark.sparkContext.defaultParallelism, n_rows // LEAST_ROWS))
    while done < last:
        begun, end = done, min(last, done + groups * group)
        steps = deal.where(F.col("step").between(begun + 1, end)).withColumn(GROUP, F.floor((F.col("step") - (begun + 1)) / group))
        dealt = sentences.join(steps, key)
        _dealt(dealt, GROUP, key, files).parquet(f"{folder}/dealt")
        dealt = spark.read.schema(dealt.schema).parquet(f"{folder}/dealt")
        for k in range(-(-(end - begun) // group)):
            to = min(end, done + group)
            rows = dealt.where(F.col(GROUP) == k).drop(GROUP).withColumn("task", F.concat_ws("-", F.col(key).cast("string"), F.col("epoch").cast("string")))
            made = scored_responses(generate(rows), known, judge, word_filter, rounded, key="task")
            chunk = F.least(F.lit(to), F.lit(done) + F.ceil((F.col("step") - done) / settings.save_every) * settings.save_every)
            out = _dealt(made.withColumn(UPTO, F.lpad(chunk.cast("string"), 12, "0")), UPTO, key, settings.batch_size * settings.save_every // FILE_ROWS + 1)
            out.option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/scored")
            chunks = [*range(done + settings.save_every, to, settings.save_every), to]
            reader = spark.read.schema(made.schema)
            scored = reader.parquet(*(f"{folder}/scored/{_name(upto)}" for upto in chunks))
            stats = every(step_statistics(scored, "step"), "step", settings.log_every)
            write_series(stats, f"{folder}/series")
            if log:  # a row for each step of a group
                epochs = {r.step: r.epoch for r in scored.select("step", "epoch").distinct().collect()}
                told = stats.orderBy("step").collect()
            for upto in chunks:
                new = learn(state, reader.parquet(f"{folder}/scored/{_name(upto)}"))
                state = spark.read.schema(new.schema).parquet(save(new, f"{folder}/state", upto))
                entry = spark.range(0, 1, 1, 1).select(F.lit(f"{upto}").alias("version"), F.lit(f"steps {done + 1} to {upto}").alias("note"))
                entry.write.mode("overwrite").json(f"{folder}/commits/{upto}")
                for r in told if log else ():
                    if done < r.step <= upto:
                        log.info("Epoch %d Step %d: Loss=%s, Reward=%s", epochs[r.step], r.step, r.stats.get("ppo/loss/total", 0), r.stats["custom/reward"])
                done = upto
    delete(spark, f"{folder}/dealt")
    return last
