"""Rewards and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import exact_round3

COVERAGE_WEIGHT, EXPRESSION_WEIGHT = 0.6, 0.4


def blended(coverage: Column, expression: Column, rounded=exact_round3) -> Column:
    """The reward: both scores rounded to three digits, weighted, and rounded again. The outer rounding has no ties, so that any rounding does."""
    return F.round(rounded(coverage) * COVERAGE_WEIGHT + rounded(expression) * EXPRESSION_WEIGHT, 3)


def half_up(c: Column) -> Column:
    """Three digits, halves up: the rounding that SQL engines share, for comparison with them."""
    return F.round(c, 3)


def batch_means(rows: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The means of unrounded coverage and expression and of the rounded reward in each batch."""
    return rows.groupBy(batch).agg(F.avg("coverage").alias("avg_coverage"), F.avg("expression").alias("avg_expression"), F.avg("reward").alias("avg_reward"), F.count("*").alias("n"))
