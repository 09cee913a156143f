"""The scoring of model responses, from text to batch metrics, as one declarative plan.

Every response is a row with a key of its own, equal ids and equal rows included: it is judged, filtered and scored for itself. Where the
responses have no unique column to serve as the key, they are written once with one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import judge_prompt
from ..functions.responses import UNRESOLVED, parsed
from ..functions.text import text
from ..operators.judging import padded, polled_scores, polled_texts
from ..operators.models import ModelStep
from ..operators.reward import batch_means, blended
from ..operators.tables import keyed, written_once
from ..operators.vocabulary import coverage

#: Takes rows with a prompt and returns the attempts at each: the key, attempt, status, content (and the batch, for texts).
Ask = Callable[[DataFrame], DataFrame]
KEY = "row_key"


def scored_responses(responses: DataFrame, vocabulary: DataFrame, judge: ModelStep, word_filter: ModelStep | None = None, rounded=None, key: str = KEY) -> DataFrame:
    """responses: response, and what else the steps need. judge adds `expression` (-1 to 1) to rows with `rewrite`; word_filter may rewrite `words`.

    Adds rewrite, words, coverage, expression and reward. Each model step runs once a row: what word_filter returns is written out before
    coverage and judge read it, and judge comes last. key: a column that is unique in responses; without it they are written once with `row_key`."""
    own = key not in responses.columns
    rows = keyed(responses, "responses", key) if own else responses
    rewrite, words = parsed(F.col("response"))
    rows = rows.withColumns({"rewrite": rewrite, "words": words})
    if word_filter:
        rows = written_once(word_filter(rows), "filtered-words")
    covered = coverage(rows, vocabulary, key, "words").select(key, "coverage")
    judged = judge(rows.join(covered, key))
    reward = blended(F.col("coverage"), F.col("expression"), rounded) if rounded else blended(F.col("coverage"), F.col("expression"))
    scored = judged.withColumn("reward", reward)
    return scored.drop(key) if own else scored


def polled_judge(ask: Ask, instructions: str, *parts: str, key: str = KEY) -> ModelStep:
    """A judge that is asked and polled: the prompt of a row is its texts in `parts` and then the instructions. Rows that never get a result have 0.01 for
    `expression`. ask is called once, and what comes back is written out, so that no plan asks again."""

    def judge(rows: DataFrame) -> DataFrame:
        attempts = written_once(ask(rows.withColumn("prompt", judge_prompt(instructions, *map(F.col, parts)))).select(key, "attempt", "status", "content"), "attempts")
        scores = polled_scores(attempts, key=key).select(key, F.col("score").alias("expression"))
        return rows.join(scores, key, "left").withColumn("expression", F.coalesce("expression", F.lit(UNRESOLVED)))

    return judge


def polled_filter(ask: Ask, instructions: str, batch: str = "batch_id", key: str = KEY) -> ModelStep:
    """A word filter that is asked and polled: `words` becomes the text that comes back. An error's text goes on as words, and nothing
    comes of what never ends."""

    def word_filter(rows: DataFrame) -> DataFrame:
        prompted = rows.withColumn("prompt", judge_prompt(instructions, F.col("words")))
        attempts = written_once(ask(prompted).select(batch, key, "attempt", "status", "content"), "attempts")
        kept = polled_texts(attempts, batch, key).select(key, F.col("result").alias("kept"))
        return rows.join(kept, key, "left").withColumn("words", text("kept")).drop("kept")

    return word_filter


def stored_pair_scores(pairs: DataFrame, ask: Ask, instructions: str, size: int) -> DataFrame:
    """batch_id, pos, score of stored pairs (batch_id, pos, original, response): prompts, attempts, polled scores, `size` to a batch.

    ask takes batch_id, pos and prompt, and returns attempts with batch_id and pos; they are written once."""
    prompts = pairs.select("batch_id", "pos", judge_prompt(instructions, F.col("original"), F.col("response")).alias("prompt"))
    attempts = written_once(ask(prompts).select(F.struct("batch_id", "pos").alias("task"), "attempt", "status", "content"), "attempts")
    scores = polled_scores(attempts, pairs.select(F.struct("batch_id", "pos").alias("task")), "task").select("task.batch_id", "task.pos", "score")
    return padded(scores, size)


def step_statistics(scored: DataFrame, step: str | None = None) -> DataFrame:
    """step and stats (a map of name to number) of each batch; step: the column that numbers them, else batch_id + 1."""
    means = batch_means(scored, step or "batch_id")
    stats = F.create_map(F.lit("custom/reward"), "avg_reward", F.lit("custom/wordbank"), "avg_coverage", F.lit("custom/expression"), "avg_expression")
    return means.select((F.col(step) if step else F.col("batch_id") + 1).alias("step"), stats.alias("stats"))
