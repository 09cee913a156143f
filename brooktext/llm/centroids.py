"""Centroid clustering of vectors in whole numbers, by ball-tree filtering.

A component x becomes floor(1024 * x), so that distances, sums and means are exact whatever the order of summation.

1. Each task builds metric trees over bounded runs of its own vectors (`TREE`): a ball has a centre, a radius, a count and
   the sum of its vectors. They are written once, to the shared folder.
2. A round descends each tree. Where the triangle inequality shows that every vector of a ball is nearer to one centroid
   than to all others, the ball's count and sum are added as a whole; else its children are looked at, and at a leaf
   each vector is compared with every centroid.
3. A task gives one row for each centroid; Spark adds them up, and the driver gets k * dims sums, whatever the input.

No vector is shuffled. Defined results: vectors with another number of components, with a null or with a component that
isn't finite are left out; rows that share a vec_id are vectors of their own; a null vec_id is drawn as a first centroid
only after all others; with fewer vectors than centroids there are as many centroids as vectors; extra columns don't
matter; an empty table gives an empty result. A component of 131,072 or more is an error, as distances would leave
64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import persist, small_batches, tidy

#: Vectors in a tree and in a leaf; scale of the whole numbers; the bound on a component before it.
TREE, LEAF, SCALE, LARGEST = 4096, 32, 1024, 1 << 17
TREES = "ids array<bigint>, points binary, spans binary, radii binary, sums binary"
RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).where((F.size(x) == dims) & finite)


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the vector in whole numbers."""
    number = lambda v: F.when(F.abs(v) < LARGEST, F.floor(v * SCALE)).otherwise(F.raise_error(F.lit(f"a component of {LARGEST} or more")).cast("long"))
    return vectors.select("vec_id", F.transform("embedding", number).cast("array<int>").alias("x"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of salt:vec_id, in that order."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = whole(vectors.withColumn("key", key).orderBy(F.col("key").asc_nulls_last(), "embedding").limit(k)).collect()  # k rows
    return np.array([r.x for r in rows], np.int64)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of points (rows) and centroids (columns)."""
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * points.shape[1] * largest * largest < 1 << 53 else np.int64  # doubles multiply faster, and are exact up to there
    p, c = points.astype(kind), centroids.astype(kind)
    return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)


def ball_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """order, spans, radii, sums: node i holds the points order[lo:hi], (lo, hi, first) = spans[i]; its children are nodes first and
    first + 1, or it has none (-1). Its centre is the sum divided by the count, rounded down; a radius of 0 means equal points."""
    order, spans, radii, sums, at = np.arange(len(points)), [[0, len(points), -1]], [], [], 0
    while at < len(spans):
        lo, hi, _ = spans[at]
        part = points[order[lo:hi]]
        total = part.sum(0)
        off = part - total // len(part)
        radii.append(float(np.sqrt((off * off).sum(1).max())))
        sums.append(total)
        width = part.max(0) - part.min(0)
        if len(part) > LEAF and width.max():
            mid = len(part) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(part[:, width.argmax()], mid)]
            spans[at][2] = len(spans)
            spans += [[lo, lo + mid, -1], [lo + mid, hi, -1]]
        at += 1
    return order, np.array(spans, np.int32), np.array(radii), np.array(sums, np.int64)


def grown(batches, dims: int):
    """Batches of (vec_id, x) as batches of trees."""
    ids, held = [], []

    def tree():
        points = np.concatenate(held)
        order, spans, radii, sums = ball_tree(points)
        row = {"ids": [[ids[i] for i in order]], "points": [points[order].astype(np.int32).tobytes()], "spans": [spans.tobytes()], "radii": [radii.tobytes()], "sums": [sums.tobytes()]}
        ids.clear()
        held.clear()
        return pa.RecordBatch.from_pydict(row, pa.schema([("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("points", "spans", "radii", "sums"))]))

    for b in batches:
        x = b.column("x").flatten().to_numpy().astype(np.int64).reshape(-1, dims)
        v = b.column("vec_id").to_pylist()
        for at in range(0, len(v), TREE):
            ids += v[at : at + TREE]
            held.append(x[at : at + TREE])
            if len(ids) >= TREE:
                yield tree()
    if ids:
        yield tree()


def descended(spans: np.ndarray, radii: np.ndarray, sums: np.ndarray, centroids: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """(node, cluster) of the balls that lie with one centroid, and the leaves that don't."""
    settled, open_leaves, level = [], [], np.array([0])
    while len(level):
        counts = (spans[level, 1] - spans[level, 0])[:, None]
        d = squared(sums[level] // counts, centroids)
        best, far = d.argmin(1), np.sqrt(d)  # the first of equals is the smaller number
        near = far[np.arange(len(level)), best]
        far[np.arange(len(level)), best] = np.inf
        # a vector of the ball is nearer than near + r to the best, further than far - r from the others; the rest is for rounding
        sure = (radii[level] == 0) | (far.min(1) - near > 2 * radii[level] + 1e-6 + 1e-12 * near)
        settled += zip(level[sure].tolist(), best[sure].tolist(), strict=True)
        first = spans[level[~sure], 2]
        open_leaves += level[~sure][first < 0].tolist()
        level = np.concatenate([first[first >= 0], first[first >= 0] + 1])
    return settled, open_leaves


def _trees(batch, dims: int):
    for i in range(batch.num_rows):
        get = lambda c, kind, *shape: np.frombuffer(batch.column(c)[i].as_py(), kind).reshape(*shape)  # noqa: B023, E731
        yield batch.column("ids")[i].values, get("points", np.int32, -1, dims), get("spans", np.int32, -1, 3), get("radii", np.float64, -1), get("sums", np.int64, -1, dims)


def assigned(points: np.ndarray, spans: np.ndarray, radii: np.ndarray, sums: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Each point's cluster."""
    settled, leaves = descended(spans, radii, sums, centroids)
    out = np.empty(len(points), np.int32)
    for node, cluster in settled:
        out[spans[node, 0] : spans[node, 1]] = cluster
    if leaves:
        at = np.concatenate([np.arange(*spans[n, :2]) for n in leaves])
        out[at] = squared(points[at].astype(np.int64), centroids).argmin(1)
    return out


def summed(trees: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts (k) and sums (k x dims) of the centroids' vectors: a row for each centroid from each task, added up by Spark."""
    k, dims = centroids.shape

    def run(batches):
        counts, totals = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            for _, points, spans, radii, sums in _trees(b, dims):
                settled, leaves = descended(spans, radii, sums, centroids)
                for node, cluster in settled:
                    counts[cluster] += spans[node, 1] - spans[node, 0]
                    totals[cluster] += sums[node]
                if leaves:
                    rest = np.concatenate([points[slice(*spans[n, :2])] for n in leaves]).astype(np.int64)
                    cluster = squared(rest, centroids).argmin(1)
                    counts += np.bincount(cluster, minlength=k)
                    for j in range(k):
                        totals[j] += rest[cluster == j].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(counts), pa.array(totals.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = trees.mapInArrow(tidy(run), "cluster int, n bigint, sums array<bigint>")
    each = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dims))).alias("sums"))
    counts, totals = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for r in each.collect():  # k rows
        counts[r.cluster], totals[r.cluster] = r.n, r.sums
    return counts, totals


def labelled(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    dims = centroids.shape[1]

    def run(batches):
        for b in batches:
            for ids, points, spans, radii, sums in _trees(b, dims):
                cluster = assigned(points, spans, radii, sums, centroids)
                off = points - centroids[cluster]
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array((off * off).sum(1))], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(tidy(run), "vec_id bigint, cluster int, distance bigint")


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, salt: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each usable vector of (vec_id, embedding)."""
    spark = small_batches(vectors.sparkSession)
    kept = usable(vectors, dims)
    centroids = first_centroids(kept, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    trees = persist(whole(kept).mapInArrow(tidy(lambda batches: grown(batches, dims)), TREES), "ball-trees")
    for _ in range(rounds):
        counts, totals = summed(trees, centroids)
        centroids = np.where(counts[:, None] > 0, totals // np.maximum(counts, 1)[:, None], centroids)
    rows = labelled(trees, centroids)
    of_cluster = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    every = sum(r.cluster_inertia for r in of_cluster)
    facts = [(r.cluster, r.cluster_inertia, every, hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in of_cluster]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # known: k rows
