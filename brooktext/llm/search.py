"""Ranked lexical search over posting lists.

A term is a maximal run of letters, digits and characters beyond ASCII, with A-Z lower-cased. A term's weight is
floor(1000 * ln((2N + 2) / (2df + 1))), its impact in a document (10**9 * tf) div (1000 * tf + 20 * m), with
m = 50 + (50 * n * N) div L; a document's score for an item sums weight * impact over the item's terms, in 64-bit integers.

1. Documents are read once, in blocks of up to `BLOCK` documents. A block gives a row for each of its terms: the term's
   bucket, the term, and the list of its postings in the block, bucket by bucket; and one row of its counts. Only terms that are
   asked for are kept if these are at most `ASKED`; else all are.
2. Lists are joined with the items' terms by bucket and term, matches are scored and summed up for each item and document.
   All lists of a block lie in one partition, so that the sums need no shuffle of matches: dealt by term alone, a document's
   matches would meet only after a shuffle of every match.
3. Each partition keeps its best rows for an item before the last row numbers are given (Spark's group limit).

A term that stands in every document is no hot key: a list is no longer than its block. Defined results: a null text has no
terms; documents are rows, so rows that share a doc_id are ranked each for itself; a null doc_id comes last among equal scores; rows
that share an item_id are one item, with the terms of all; items without terms, or whose terms no document has, have no
rows; extra columns don't matter; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import give_back, persist, small_batches, tidy

#: Fixed value: what parts terms.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents and characters of a block, buckets of terms, terms that workers are told of, item terms that are broadcast,
#: (document, item) sums of a task.
BLOCK, CHARS, BUCKETS, ASKED, PAIRS, SUMS = 1024, 1 << 22, 64, 500_000, 500_000, 1 << 20
LISTS = "block bigint, term string, postings array<struct<pos:int,tf:int,n:int>>, ids array<bigint>, n_docs bigint, n_terms bigint"
_POSTING = pa.struct([("pos", pa.int32()), ("tf", pa.int32()), ("n", pa.int32())])
_LISTS = pa.schema([("block", pa.int64()), ("term", pa.string()), ("postings", pa.list_(_POSTING)), ("ids", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64())])


def terms(text: Column) -> Column:
    """The terms of a text, in order, with repeats."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), GAP), lambda t: t != "")


def block_lists(block: int, ids: list, docs: list[str], asked: pa.Array | None) -> pa.RecordBatch:
    """A block's posting lists, a row each, and a row without a term for its ids and counts."""
    split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(pa.array(docs, pa.large_string())), GAP, " "))
    coded = split.flatten().dictionary_encode()
    doc, code = np.repeat(np.arange(len(docs)), np.diff(split.offsets.to_numpy())), coded.indices.to_numpy()
    known = coded.dictionary.cast(pa.string())
    real = pc.not_equal(known, "").to_numpy(zero_copy_only=False)
    doc, code = doc[real[code]], code[real[code]]
    n = np.bincount(doc, minlength=len(docs))
    if asked is not None:
        wanted = pc.is_in(known, value_set=asked).to_numpy(zero_copy_only=False)[code]
        doc, code = doc[wanted], code[wanted]
    pairs, tf = np.unique(code.astype(np.int64) * len(docs) + doc, return_counts=True)
    of_term, pos = pairs // len(docs), pairs % len(docs)
    starts = np.flatnonzero(np.diff(of_term, prepend=-1))
    postings = pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), pa.array(tf.astype(np.int32)), pa.array(n[pos].astype(np.int32))], fields=list(_POSTING))
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(pos)).astype(np.int32)), postings)
    k = len(starts)
    none = lambda kind: pa.nulls(k, kind)
    rows = pa.table([pa.array(np.full(k, block)), known.take(pa.array(of_term[starts])), lists, none(pa.list_(pa.int64())), none(pa.int64()), none(pa.int64())], schema=_LISTS)
    counts = pa.table([[block], [None], [None], [ids], [int((n > 0).sum())], [int(n.sum())]], schema=_LISTS)
    return pa.concat_tables([rows, counts]).combine_chunks().to_batches()[0]


def posting_lists(docs: DataFrame, asked: list[str] | None = None) -> DataFrame:
    """The rows of block_lists() for all documents (doc_id, text), with the term's bucket; asked: the terms to be kept, all if None."""
    spark = small_batches(docs.sparkSession)
    told = spark.sparkContext.broadcast(asked) if asked is not None else None  # at most ASKED terms

    def run(batches):
        wanted = pa.array(told.value, pa.string()) if told else None
        block, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or "")
                held += len(texts[-1])
                if len(ids) == BLOCK or held >= CHARS:
                    yield block_lists(block, ids, texts, wanted)
                    block, ids, texts, held = block + 1, [], [], 0
                    give_back()
        if ids:
            yield block_lists(block, ids, texts, wanted)

    lists = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), LISTS)
    return lists.withColumn("bucket", bucket(F.col("term")))


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    wanted = persist(items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms(F.col("text"))).alias("term")).distinct(), "search-terms")
    distinct = wanted.select("term").distinct()
    few = distinct.limit(ASKED + 1).count() <= ASKED
    lists = persist(posting_lists(docs, [r.term for r in distinct.collect()] if few else None).sortWithinPartitions("bucket", "block"), "search-lists")
    n_docs, n_terms, n_blocks = lists.where("term is null").agg(F.sum("n_docs"), F.sum("n_terms"), F.count("*")).first()
    if not n_terms:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")

    df = lists.where("term is not null").groupBy("bucket", "term").agg(F.sum(F.size("postings").cast("long")).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double")))
    weighed = wanted.withColumn("bucket", bucket(F.col("term"))).join(df, ["bucket", "term"]).select("bucket", "term", "item_id", weight.alias("w")).where("w > 0")
    weighed = persist(weighed, "search-weights")
    n_items = weighed.select("item_id").distinct().count()
    if weighed.limit(PAIRS + 1).count() <= PAIRS:
        weighed = F.broadcast(weighed)

    # a posting becomes one number: its place in the block and its impact, which is below 10**6
    code = F.expr(f"transform(postings, p -> shiftleft(cast(p.pos as bigint), 32) + (1000000000L * p.tf) div (1000L * p.tf + 20L * (50L + (50L * p.n * {n_docs}L) div {n_terms}L)))")
    parts = max(1, n_blocks // max(1, SUMS // (BLOCK * max(1, n_items))))
    coded = lists.where("term is not null").select("block", "bucket", "term", code.alias("codes")).repartition(parts, "block")
    matches = coded.join(weighed, ["bucket", "term"]).select("block", "item_id", "w", F.explode("codes").alias("code"))
    scored = matches.select("block", "item_id", F.expr("cast(shiftright(code, 32) as int)").alias("pos"), (F.col("w") * F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"))
    sums = scored.groupBy("block", "item_id", "pos").agg(F.sum("s").alias("score")).where("score > 0")
    # a partition's blocks have BLOCK ids each: a small table to look them up in
    named = lists.where("term is null").select("block", "ids").repartition(parts, "block").hint("shuffle_hash")
    rows = sums.join(named, "block").select("item_id", "block", "pos", F.element_at("ids", F.col("pos") + 1).alias("doc_id"), "score")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "block", "pos")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
