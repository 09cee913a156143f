"""Mixing sources to target weights by entropy balancing.

Each document has a rate from 0 to `MOST` at which the mix takes it. Of all rates under which every source gives its target
of words, those are wanted that stay nearest to one copy a document (in bounded relative entropy). They are tilted exponentially
in the document's size: rate = MOST / (1 + (MOST - 1) * exp(-lambda * size)), with one multiplier lambda for each source, the solution
of the convex dual.

1. Sizes are counted once; equal sizes of a source are one bin with a number of documents, as they have the same rate.
2. Targets: the sources' weights share the words asked for; a target stops at MOST times its source's words, and what is left over is shared
   again. Whole numbers decide, so nothing depends on the order of sums.
3. Newton iterations on the dual, kept within a bracket: each is one aggregate over the bins for all sources at once. What is summed up are whole
   numbers (millionths), so that reruns agree to the last bit.
4. Rates become copies: a bin's copies are its documents times its rate, rounded; what rounding leaves over is carried to the next
   smaller size, so that a source ends within about half its smallest size of the target, if it has sizes to do it. Which documents
   of a bin get the extra copy is decided by the order of a hash.

A source's bins are scanned in one task. They are few: d different sizes take at least d * d / 2 words, so a source of 10**13 words has
fewer than 5 million. No task gets a source's documents, and bins of over `PART` documents are parted by the hash.

Defined results: a null text has size 0; null is a source of its own, after all others; documents of size 0 are taken once, as no words; a source without
words has target 0; rows that share a doc_id are documents of their own; a null doc_id is like any other; extra columns don't matter; an empty table
gives an empty result. A source of few documents comes as near to its target as whole copies allow.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, persist

#: Weights by the source's rank, repeating; words of the mix as a fraction of all; copies of a document at most.
WEIGHTS, SHARE, MOST = (3, 1, 2), (3, 2), 2
#: Documents that are put in order together; rows that are broadcast at most; Newton iterations at most.
PART, ROWS, ROUNDS = 1_000, 200_000, 200
WORD = r"[^\x20\x09-\x0D]+"
_EXACT = "decimal(38,0)"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and u, a hash that orders documents."""
    size = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("u"))


def joined(df: DataFrame, facts: DataFrame, *names: str, how: str = "left") -> DataFrame:
    """df with the columns of facts, which has one row for each value of names; null equals null. facts is broadcast if it has ROWS rows at most."""
    known = facts.select(*(F.col(n).alias(f"_{n}") for n in names), *(c for c in facts.columns if c not in names))
    known = F.broadcast(known) if facts.limit(ROWS + 1).count() <= ROWS else known
    on = F.lit(True)
    for n in names:
        on &= F.col(n).eqNullSafe(F.col(f"_{n}"))
    return df.join(known, on, how).drop(*(f"_{n}" for n in names))


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, from 0 in code point order, null last. They are dealt by range, and numbered within each part."""
    parted = persist(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-ranks")
    sizes = parted.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"))
    at = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parted.withColumn("rank", at).join(F.broadcast(before), "part").withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """sources (source, source_size) with target: share of all words by weights, none above most times the source's words."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = persist(ranked(sources).withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most), "mix-sources")
    whole, every = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    up, down = share
    left, among, full = up * (whole or 0), every or 0, F.lit(False)  # left: words times `down`
    while among:
        above = F.col("weight").cast(_EXACT) * F.lit(left).cast(_EXACT) > F.col("cap").cast(_EXACT) * F.lit(down * among).cast(_EXACT)
        caps, held = rows.where(above).agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        full = above
        if (up * whole - down * caps, every - held) == (left, among):
            break
        left, among = up * whole - down * caps, every - held
    fair = F.col("weight") * F.lit(float(left)) / F.lit(float(down * among)) if among else F.col("cap").cast("double")
    return rows.select("source", "source_size", "rank", F.when(full | F.lit(not among), F.col("cap").cast("double")).otherwise(fair).alias("target"), (F.lit(not among) | full).alias("full"))


def rate(tilt: Column, size: Column, most: int = MOST) -> Column:
    """Copies of a document, from 0 to most; 1 without a tilt."""
    return F.lit(float(most)) / (1 + (most - 1) * F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -tilt * size))))


def balanced(bins: DataFrame, aims: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, target, tilt: each source's multiplier. bins: source, size (over 0), n. A full source has an infinite tilt, one whose target is 0
    a tilt of minus infinity."""
    spread = bins.groupBy("source").agg((F.sum(F.col("n") * F.col("size") * F.col("size").cast("double")) / F.sum(F.col("n") * F.col("size"))).alias("scale"))
    inf = F.lit(float("inf"))
    start = F.when(F.col("full"), inf).when(F.col("target") <= 0, -inf).otherwise(F.lit(0.0))
    state = joined(aims, spread, "source").withColumns({"tilt": start, "low": -inf, "high": inf, "done": F.abs(start) == inf})
    state = persist(state.withColumn("scale", F.coalesce("scale", F.lit(1.0))), "mix-tilts")
    for _ in range(ROUNDS):
        if not state.where("not done").limit(1).count():
            return state
        wanted = joined(bins, state.where("not done").select("source", "tilt", "scale"), "source", how="inner")
        r, x = rate(F.col("tilt"), F.col("size") / F.col("scale"), most), F.col("size") / F.col("scale")
        words = F.col("n") * F.col("size") * r
        slope = words * x * (1 - r / most)
        fixed = lambda c: F.sum(F.round(c * 1e6).cast(_EXACT)).cast("double") / 1e6  # noqa: E731  the same in any order
        sums = wanted.groupBy("source").agg(fixed(words).alias("words"), fixed(slope).alias("slope"))
        state, old = persist(_newton(joined(state, sums, "source")), "mix-tilts"), state
        discard(old)
    raise ArithmeticError(f"no balance after {ROUNDS} iterations")


def _newton(state: DataFrame) -> DataFrame:
    """The next multipliers: a Newton step, no longer than 4 or the multiplier itself; half way where that leaves the bracket."""
    off, tilt = F.col("target") - F.col("words"), F.col("tilt")
    low, high = F.when(off > 0, tilt).otherwise(F.col("low")), F.when(off < 0, tilt).otherwise(F.col("high"))
    reach = F.greatest(F.lit(4.0), F.abs(tilt))
    step = F.when(F.col("slope") > 0, off / F.col("slope")).otherwise(F.signum(off) * reach)
    new = tilt + F.greatest(-reach, F.least(reach, step))
    close = F.abs(off) <= 0.01 + 1e-7 * F.col("target")
    out = state.withColumns({"close": F.col("done") | close, "l": low, "h": high, "new": new})
    inside = (F.col("new") > F.col("l")) & (F.col("new") < F.col("h"))
    mid = F.when(inside, F.col("new")).when((F.col("h") < float("inf")) & (F.col("l") > float("-inf")), (F.col("l") + F.col("h")) / 2).otherwise(F.col("new"))
    stay = F.col("close") | (mid == F.col("tilt"))  # as near as doubles come
    return out.withColumns({"tilt": F.when(F.col("close"), F.col("tilt")).otherwise(mid), "low": F.when(F.col("done"), F.col("low")).otherwise(F.col("l")), "high": F.when(F.col("done"), F.col("high")).otherwise(F.col("h")), "done": stay}).drop("close", "l", "h", "new", "words", "slope")


def carried(pdf: pd.DataFrame, most: int = MOST) -> pd.DataFrame:
    """A source's bins with base and k: each of a bin's n documents gets base copies, k of them one more. Together that is n times the rate, rounded;
    what is left over goes to the next smaller size."""
    pdf = pdf.sort_values("size", ascending=False)
    over, base, ks = 0.0, [], []
    for r, size, n in zip(pdf["rate"].tolist(), pdf["size"].tolist(), pdf["n"].tolist(), strict=True):
        taken = min(most * n, max(0, round(n * r + over / size)))
        over += (n * r - taken) * size
        base.append(taken // n)
        ks.append(taken % n)
    return pdf.assign(base=base, k=ks)[["source", "size", "n", "rate", "base", "k"]]


def copies(docs: DataFrame, plan: DataFrame, part: int = PART) -> DataFrame:
    """docs (source, size, u, ...) with rate and copies. plan: the rows of carried()."""
    rows = joined(docs, plan, "source", "size")
    plain = rows.where("size = 0 or k = 0").withColumn("copies", F.when(F.col("size") == 0, F.lit(1).cast("long")).otherwise(F.col("base")))
    some = rows.where("size > 0 and k > 0").withColumn("part", F.pmod(F.xxhash64("u"), F.ceil(F.col("n") / part)))
    if plan.where((F.col("n") > part) & (F.col("k") > 0)).limit(1).count():
        # a large bin's k is dealt over its parts in proportion to their documents
        large = some.where(F.col("n") > part).groupBy("source", "size", "part").agg(F.count("*").alias("m"), F.first("n").alias("all"), F.first("k").alias("want"))
        upto = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each `part` documents of a bin
        dealt = F.floor(F.col("want").cast("decimal(19,0)") * F.sum("m").over(upto).cast("decimal(19,0)") / F.col("all"))
        each = large.withColumn("upto", dealt.cast("long")).withColumn("k_part", F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy("source", "size").orderBy("part")), F.lit(0)))
        some = joined(some, each.select("source", "size", "part", "k_part"), "source", "size", "part").withColumn("k", F.coalesce("k_part", "k")).drop("k_part")
    order = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("u"))
    some = some.withColumn("copies", F.col("base") + (order <= F.col("k")).cast("long")).drop("part")
    return plain.unionByName(some).drop("n", "base", "k")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, part: int = PART) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for each document of (doc_id, text, source); taken: the words that the mix takes, size times copies."""
    rows = persist(sized(docs), "mix-sizes")
    aims = persist(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    bins = persist(rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mix-bins")
    tilts = balanced(bins, aims, most)
    rated = joined(bins, tilts.select("source", "tilt", "scale"), "source").withColumn("rate", rate(F.col("tilt"), F.col("size") / F.col("scale"), most))
    plan = persist(rated.groupBy("source").applyInPandas(lambda pdf: carried(pdf, most), "source string, size bigint, n bigint, rate double, base bigint, k bigint"), "mix-plan")
    discard(bins, tilts)
    out = joined(copies(rows, plan, part), aims.select("source", "source_size", "target"), "source")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("rate", F.lit(1.0)).alias("rate"), "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeated(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken; mix: doc_id and copies, one row a doc_id."""
    rows = docs.join(mix.select(F.col("doc_id").alias("_mixed"), "copies"), F.col("doc_id").eqNullSafe(F.col("_mixed")))
    return rows.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_mixed", "copies", "_copy")
