import math
import random
import re
from collections import Counter, defaultdict

import pytest

from brooktext.llm.mixing import carried, mixed, repeated, targets

DOCS = "doc_id long, text string, source string, size long, u string, rate string"


def frame(spark, rows):
    """Documents with columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, s, 7, "u", "r") for i, t, s in rows], DOCS).repartition(3)


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def water(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """source -> target, sharing again until no target is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        among = sum(w[s] for s in free)
        above = {s for s in free if left * w[s] / among > most * sizes[s]}
        if not above:
            return out | {s: left * w[s] / among for s in free}
        out |= {s: most * sizes[s] for s in above}
        free -= above
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def rates(sizes, target, most=2):
    """The rates of one source's sizes, by bisection on the multiplier."""
    if target >= most * sum(sizes):
        return [float(most)] * len(sizes)
    if target <= 0:
        return [0.0] * len(sizes)
    scale = sum(x * x for x in sizes) / sum(sizes)
    of = lambda t: [most / (1 + (most - 1) * math.exp(max(-700, min(700, -t * x / scale)))) for x in sizes]
    lo, hi = -1e5, 1e5
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(r * x for r, x in zip(of(mid), sizes, strict=True)) < target else (lo, mid)
    return of(lo)


def corpus(seed, n=900):
    """Sources of very different sizes, one with a third of all documents, and many documents of equal size."""
    rng = random.Random(seed)
    names = ["hot"] * 6 + ["", "b", "Z", "é", "中", "😀", "a", "tiny", None, None, "ab", "c"]
    out = []
    for i in range(n):
        s = rng.choice(names)
        words = 12 if s == "hot" and rng.random() < 0.5 else rng.choice([1, 2, 3, 5, 8]) if s == "tiny" else rng.randint(0, 300)
        out.append((i, " ".join(["w"] * words), s))
    return out


@pytest.mark.parametrize("part", [7, 100_000])
def test_like_brute_force(spark, part):
    rows = corpus(1)
    got = mixed(frame(spark, rows), part=part).collect()
    assert sorted(r.doc_id for r in got) == [i for i, *_ in rows]
    sizes, of = Counter(), defaultdict(list)
    for i, t, s in rows:
        sizes[s] += size(t)
        of[s].append((i, size(t)))
    aims, by = water(sizes), {r.doc_id: r for r in got}
    for s, docs in of.items():
        least = min((n for _, n in docs if n), default=0)
        assert abs(sum(by[i].taken for i, _ in docs) - aims[s]) <= least / 2 + 0.1, s
        some = [(i, n) for i, n in docs if n]
        for (i, _), want in zip(some, rates([n for _, n in some], aims[s]), strict=True):
            assert by[i].rate == pytest.approx(want, abs=1e-4)
        for i, n in docs:
            r = by[i]
            assert (r.size, r.source_size, r.source) == (n, sizes[s], s) and r.target == pytest.approx(aims[s], rel=1e-12)
            assert r.copies in (0, 1, 2) and r.taken == n * r.copies
    for n in (12,):  # equal sizes of a source get numbers of copies that differ by one at most, their rate on average
        same = [by[i] for i, m in of["hot"] if m == n]
        assert max(r.copies for r in same) - min(r.copies for r in same) <= 1 and sum(r.copies for r in same) == pytest.approx(same[0].rate * len(same), abs=30)


def test_reruns_agree(spark):
    df = frame(spark, corpus(2, 300))
    one = sorted(map(tuple, mixed(df).collect()), key=str)
    assert one == sorted(map(tuple, mixed(df.repartition(7)).collect()), key=str)


def test_few_documents_and_sources_without_words(spark):
    rows = [(1, "a b c", "x"), (2, None, "y"), (3, "", "y"), (4, " \n", None), (5, "a", "z"), (5, "a", "z"), (None, "b b", "z"), (None, None, None)]
    got = mixed(frame(spark, rows)).collect()
    aims = water({"x": 3, "y": 0, "z": 4, None: 0})
    assert len(got) == len(rows) and all(r.target == pytest.approx(aims[r.source]) for r in got)
    assert all(r.taken == 0 and r.copies == 1 for r in got if r.size == 0)


def test_odd_rows(spark, odd, empty):
    got = mixed(odd).collect()
    assert len(got) == odd.count() and all(r.taken <= 2 * r.size for r in got)
    assert mixed(empty).collect() == []
    assert all(r.taken == 0 for r in mixed(odd.where("text is null")).collect())


def test_targets_share_again(spark):
    names = {"a": 10, "b": 1000, "c": 10, "d": 500, "e": 0, None: 300}
    df = spark.createDataFrame(list(names.items()), "source string, source_size long")
    assert {r.source: r.target for r in targets(df).collect()} == pytest.approx(water(names))
    other = targets(df, weights=(1,), share=(1, 2), most=1)
    assert {r.source: r.target for r in other.collect()} == pytest.approx(water(names, (1,), 0.5, 1))


def test_what_is_left_over_goes_to_smaller_sizes():
    import pandas as pd

    pdf = pd.DataFrame({"source": "s", "size": [100, 40, 3], "n": [3, 1, 50], "rate": [0.5, 0.5, 1.0]})
    got = carried(pdf)
    assert abs((got["size"] * (got["n"] * got["base"] + got["k"])).sum() - 320) <= 1.5


def test_the_mix_itself(spark):
    df = frame(spark, [(i, "w " * (i + 1), "ab"[i % 2]) for i in range(40)])
    mix = mixed(df)
    got = Counter(r.doc_id for r in repeated(df, mix).collect())
    assert got == {r.doc_id: r.copies for r in mix.collect() if r.copies}
    assert repeated(df, mix).columns == df.columns
