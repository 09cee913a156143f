import hashlib
import math
import random

import numpy as np
import pytest

from brooktext.llm.centroids import LEAF, ball_tree, clustered, descended, squared

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, distance double, x string"


def brute(rows, k=8, rounds=10, dims=64):
    """Sorted (vec_id, cluster, distance, cluster inertia, inertia, hash), comparing every vector with every centroid in Python's whole numbers."""
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cs = [x for _, x in order[:k]]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    label = lambda: [min(range(len(cs)), key=lambda j: (dist(x, cs[j]), j)) for _, x in kept]  # noqa: E731, B023
    for _ in range(rounds):
        of = label()
        for j in range(len(cs)):
            own = [x for (_, x), c in zip(kept, of, strict=True) if c == j]
            cs[j] = [sum(v) // len(own) for v in zip(*own, strict=True)] if own else cs[j]
    of = label()
    d = [dist(x, cs[c]) for (_, x), c in zip(kept, of, strict=True)]
    own = [sum(e for e, c in zip(d, of, strict=True) if c == j) for j in range(len(cs))]
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted((i if i is not None else -1, c, e, own[c], sum(d), text[c]) for (i, _), c, e in zip(kept, of, d, strict=True))


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, e, 1, "clash", 0.5, "clash") for i, e in rows], SCHEMA).repartition(3)
    return sorted((r.vec_id if r.vec_id is not None else -1, *r[1:]) for r in clustered(df, **how).collect())


def vectors(seed, n, near=0.0):
    """Vectors around five places; near: how close."""
    rng = np.random.default_rng(seed)
    places = rng.normal(size=(5, 64))
    return [(i, (places[rng.integers(5)] + near * rng.normal(size=64)).tolist()) for i in range(n)]


@pytest.mark.parametrize("near", [0.0, 0.01, 0.3, 3.0])
def test_like_brute_force(spark, near):
    rows = vectors(1, 400, near)
    assert run(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    rows = vectors(2, 60, 0.2)
    one = rows[0][1]
    rows += [(100 + i, one) for i in range(150)] + [(7, one), (7, one), (None, one), (None, rows[3][1])]  # a frequent vector, repeated and null ids
    rows += [(300, None), (301, []), (302, one[:63]), (303, [*one, 0.0]), (304, [None, *one[1:]]), (305, [math.nan, *one[1:]]), (306, [-math.inf, *one[1:]]), (307, [0.0] * 64), (308, [-0.0001] * 64)]
    assert run(spark, rows) == brute(rows)


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [float(i % 2)] + [0.0] * 63) for i in range(40)]  # two different vectors, eight centroids
    got = run(spark, rows)
    assert got == brute(rows) and len({r[1] for r in got}) == 2


def test_few_and_none(spark):
    assert run(spark, vectors(3, 3, 1.0)) == brute(vectors(3, 3, 1.0))
    assert run(spark, []) == []
    with pytest.raises(Exception, match="a component of"):
        run(spark, [(1, [2e5] * 64)])


def test_other_sizes(spark):
    rows = [(i, [float(i * i % 17), -float(i)]) for i in range(90)]
    assert run(spark, rows, k=3, rounds=4, dims=2) == brute(rows, 3, 4, 2)


def test_balls_settle_as_a_whole():
    """Of vectors in close groups most balls go to one centroid without a look at their vectors, and none wrongly."""
    points = np.floor(1024 * np.array([e for _, e in vectors(4, 2000, 0.02)])).astype(np.int64)
    order, spans, radii, sums = ball_tree(points)
    centroids = points[[0, 1, 2, 3, 4, 5, 6, 7]]
    settled, leaves = descended(spans, radii, sums, centroids)
    held = sorted((int(spans[n, 0]), int(spans[n, 1])) for n in [*(n for n, _ in settled), *leaves])
    assert held[0][0] == 0 and held[-1][1] == len(points) and all(a[1] == b[0] for a, b in zip(held, held[1:], strict=False))
    nearest = squared(points[order], centroids).argmin(1)
    for n, c in settled:
        assert (nearest[spans[n, 0] : spans[n, 1]] == c).all()
    far = np.array([points[points[:, 0].argmax()], points[points[:, 0].argmin()]])
    settled, leaves = descended(spans, radii, sums, far)
    assert sum(spans[n, 1] - spans[n, 0] for n, _ in settled) > 0.5 * len(points)
    assert all(spans[n, 1] - spans[n, 0] <= LEAF for n in leaves)


def test_tree_sums(seed=5):
    rng = random.Random(seed)
    points = np.array([[rng.randrange(-5, 5) for _ in range(3)] for _ in range(500)])
    order, spans, radii, sums = ball_tree(points)
    for (lo, hi, _), r, s in zip(spans, radii, sums, strict=True):
        part = points[order[lo:hi]]
        assert (part.sum(0) == s).all() and np.sqrt(((part - s // (hi - lo)) ** 2).sum(1)).max() <= r
