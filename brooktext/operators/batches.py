"""Order, batches and pairs.

A global order is never made in one task: rows are keyed by a hash, whose first digits deal them evenly into buckets; the
buckets' sizes, one row a bucket, give each bucket's offset, and rows are numbered within their bucket. There are as many digits as keep a
bucket near `BUCKET` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 100_000


def shuffled_index(df: DataFrame, key: Column, rows: int, within: tuple[str, ...] = ()) -> DataFrame:
    """df with idx, a dense number from 0 in the order of md5(key), a shuffle that the key's salt decides; within: columns of few values, each numbered for
    itself. Rows of one key are in the order of a hash of all their columns (but maps), so that every computation numbers them alike. rows: about how many there are."""
    digits = next(d for d in range(1, 9) if d == 8 or rows <= BUCKET * 16**d)
    tie = F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()), F.lit(0))
    keyed = df.withColumns({"order_key": F.md5(key), "tie": tie}).withColumn("bucket", F.substring("order_key", 1, digits))
    sizes = keyed.groupBy(*within, "bucket").agg(F.count("*").alias("n"))  # 16 ** digits rows at most, for each value of within
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy(*within).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(*within, "bucket", F.coalesce("before", F.lit(0).cast("long")).alias("before"))
    at = F.row_number().over(Window.partitionBy(*within, "bucket").orderBy("order_key", "tie")) - 1
    return keyed.withColumn("at", at).join(F.broadcast(before), [*within, "bucket"]).withColumn("idx", F.col("before") + F.col("at")).drop("bucket", "at", "before", "order_key", "tie")


def fixed_batches(df: DataFrame, key: Column, size: int, drop_last: bool = True) -> DataFrame:
    """df in shuffled batches of `size` rows: batch_id and pos from 0, step from 1; the last, shorter batch is dropped."""
    n = df.count()
    rows = _batched(shuffled_index(df, key, n), size).withColumn("step", F.col("batch_id") + 1)
    return rows.where(F.col("batch_id") < n // size) if drop_last else rows


def epoch_batches(df: DataFrame, key: Column, size: int, epochs: int, salt: str = "epoch-") -> DataFrame:
    """Several epochs of df, each in an order of its own: epoch, batch_id and pos from 0, step from 1 through all epochs; each epoch's last, shorter
    batch is dropped. df should have the ids only, as each epoch is a copy."""
    n = df.count()
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    salted = F.concat(key, F.lit(salt), F.col("epoch").cast("string"))
    rows = _batched(shuffled_index(rows, salted, n, ("epoch",)), size).where(F.col("batch_id") < n // size)
    return rows.withColumn("step", F.col("epoch") * F.lit(n // size) + F.col("batch_id") + 1)


def _batched(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("batch_id", F.floor(F.col("idx") / size)).withColumn("pos", F.pmod("idx", F.lit(size))).drop("idx")


def collated(batches: DataFrame, *columns: str) -> DataFrame:
    """A row for each batch, with an array of each column in the order of pos."""
    held = batches.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("rows"))
    return held.select("batch_id", *(F.col(f"rows.{c}").alias(c) for c in columns))


def turn_pairs(messages: DataFrame) -> DataFrame:
    """conv_id, turn, original, response: each user turn with the assistant turn right after it, by a join on the turn."""
    user = messages.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("original"))
    reply = messages.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return user.join(reply, ["conv_id", "turn"])


def every(df: DataFrame, step: str, k: int) -> DataFrame:
    """The rows of every k-th step, for logs, checkpoints and the like."""
    return df.where(F.pmod(F.col(step), F.lit(k)) == 0)
