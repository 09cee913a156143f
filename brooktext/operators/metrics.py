"""Step statistics as long tables."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, files_in, written_once

#: Each series' tag and the statistic it shows.
SERIES = {
    "Loss/Policy": "ppo/loss/policy",
    "Loss/Value": "ppo/loss/value",
    "Loss/Total": "ppo/loss/total",
    "Metrics/KL": "objective/kl",
    "Metrics/Adv": "ppo/policy/advantages_mean",
    "Reward/Average": "custom/reward",
    "Reward/Wordbank": "custom/wordbank",
    "Reward/Semantics": "custom/semantics",
    "Reward/Expression": "custom/expression",
}


def looked_up(stats: str, name: str, default: float = 0.0):
    """A statistic of a map column, or the default."""
    return F.coalesce(F.try_element_at(F.col(stats), F.lit(name)), F.lit(default))


def scalar_series(steps: DataFrame, step: str = "step", stats: str = "stats") -> DataFrame:
    """step, tag, value: nine rows a step; statistics that are missing are 0."""
    wide = steps.select(step, *(looked_up(stats, name).alias(tag) for tag, name in SERIES.items()))
    return wide.unpivot(step, [F.col(f"`{t}`") for t in SERIES], "tag", "value")


#: Steps that share a folder of a written series.
SPAN = 1000


def write_series(steps: DataFrame, path: str, step: str = "step", stats: str = "stats") -> None:
    """Writes the steps' series into a table of step, tag, value. A step that the table has already is replaced, so that a step that is run again
    leaves its nine rows. Only the folders of `SPAN` steps that the new steps lie in are written."""
    spark = steps.sparkSession
    new = written_once(scalar_series(steps, step, stats).withColumn("span", F.floor(F.col(step) / SPAN)), "series")
    out = new
    if files_in(spark, path).limit(1).count():
        old = spark.read.schema(new.schema).parquet(path).join(F.broadcast(new.select("span").distinct()), "span", "left_semi")
        out = old.join(new.select(step).distinct(), step, "left_anti").unionByName(new)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("span").parquet(path)
    discard(new)


def step_log(path: str, name: str = "train") -> logging.Logger:
    """The driver's log of steps, into a file."""
    log = logging.getLogger(name)
    if not any(getattr(h, "baseFilename", None) == path for h in log.handlers):
        handler = logging.FileHandler(path, encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    log.setLevel(logging.INFO)
    return log
