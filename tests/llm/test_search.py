import math
import random
import re
from collections import Counter

import pytest

from brooktext.llm import search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))


def brute(docs, items, k=50):
    """Sorted (item, rank, doc_id, score), scoring every document for every item."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item in {i for i, _ in items}:
        asked, scores = {t for i, x in items if i == item for t in terms(x)}, []
        for i, c in held:
            n = sum(c.values())
            s = 0
            for t in asked & set(c):
                w, m = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))), 50 + 50 * n * n_docs // n_terms
                s += w * (10**9 * c[t] // (1000 * c[t] + 20 * m))
            if s > 0:
                scores.append((-s, i is None, i if i is not None else 0))
        out += [(item if item is not None else -1, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=lambda r: r[:2])


def run(spark, docs, items, k=50):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, block long").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score long")
    got = S.search(d, q, k)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(((r.item_id if r.item_id is not None else -1, *r[1:]) for r in got.collect()), key=lambda r: r[:2])


def corpus(seed, n=300):
    """Frequent and rare words, copies, and marks of all kinds."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "And", "naïve", "中文", "x_y", "don't", "A1", " sp", "É", "é", "٣", "a\x00b", "z{z"] + [f"w{i}" for i in range(60)]
    word = lambda: rng.choice(vocabulary[: rng.choice([3, 14, 74])])
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return docs + [(n + i, docs[5][1]) for i in range(80)]


@pytest.mark.parametrize(("asked", "pairs", "block"), [(500_000, 500_000, 1024), (0, 0, 16)])
def test_like_brute_force(spark, monkeypatch, asked, pairs, block):
    """Also with all terms in the lists, item terms joined by a shuffle, and many blocks."""
    monkeypatch.setattr(S, "ASKED", asked)
    monkeypatch.setattr(S, "PAIRS", pairs)
    monkeypatch.setattr(S, "BLOCK", block)
    docs = corpus(1)
    items = [(i, docs[i * 7][1]) for i in range(12)] + [(20, "absent words only"), (21, None), (22, " . "), (23, "THE the The w1"), (24, "the"), (24, "w2 w3"), (None, "naïve é")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, k=3) == brute(docs, items, 3)


def test_odd_rows(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "one word"), (2, "the same words in a text of two 中文"), (3, None)]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, []) == [] and S.search(empty, empty.selectExpr("doc_id as item_id", "text")).collect() == []
    assert run(spark, [(1, None), (2, " ")], items) == []


def test_long_texts_fill_blocks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(S, "CHARS", 500)
    docs = [(i, f"w{i} " * 400 + "shared") for i in range(6)] + [(9, "shared")]
    items = [(1, "shared w3")]
    assert run(spark, docs, items) == brute(docs, items)


def test_terms_of_both_sides_agree(spark):
    docs = [t for _, t in corpus(2, 60)]
    got = [r.ts for r in spark.createDataFrame([(t,) for t in docs], "text string").select(S.terms(S.F.col("text")).alias("ts")).collect()]
    assert got == [terms(t) for t in docs]
