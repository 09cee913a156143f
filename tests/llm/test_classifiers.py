"""Quality and toxicity: held-out accuracy, and what scores may depend on."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brooktext.llm import quality
from brooktext.llm.quality import STATISTICS, isotonic, keep_good, quality_scores, statistics
from brooktext.llm.toxicity import LEXICON, PATTERNS, LabelModel, fit, logistic, sketch, terms_of, toxicity_scores

DATA = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    return (rank[label == 1].mean() - rank[label == 0].mean()) / len(label) + 0.5


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.mark.parametrize("scores, target, mod, rest, least", [(quality_scores, "quality", 5, 0, 0.99), (toxicity_scores, "toxic", 4, 2, 0.93)])
def test_held_out(tables, scores, target, mod, rest, least):
    docs, labels = tables
    got = scores(docs, labels)
    assert got.count() == docs.count() and got.columns == ["doc_id", "held_out", "score", "predicted"]
    x = got.join(labels, "doc_id").toPandas()
    assert all((zlib.crc32(str(i).encode()) % mod == rest) == h for i, h in zip(x.doc_id, x.held_out, strict=True))
    assert ((x.score >= 0.3) == (x.predicted == 1)).all() and x.score.between(0, 1).all()
    held = x[x.held_out]
    assert auc(held.score.values, held[target].values) > least
    if target == "toxic":  # wherever there are enough labelled toxic rows to learn a language's words from
        by_lang = held[held.toxic == 1].merge(docs.select("doc_id", "lang").toPandas(), on="doc_id").groupby("lang").predicted.agg(["size", "mean"])
        assert len(big := by_lang[by_lang["size"] >= 10]) >= 3 and (big["mean"] >= 0.85).all(), by_lang
    assert held[held[target] == 0].predicted.mean() < 0.02 if target == "toxic" else held[held[target] == 1].predicted.mean() > 0.99


@pytest.mark.parametrize("scores", [quality_scores, toxicity_scores])
def test_only_the_text_and_the_right_labels_count(spark, scores):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    mod, rest = (5, 0) if scores is quality_scores else (4, 2)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod)) == rest
    flipped = labels.withColumns({c: F.when(held, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    a = {r.doc_id: r.score for r in scores(docs, labels).collect()}
    b = {r.doc_id: r.score for r in scores(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("s")), flipped).collect()}
    assert a == pytest.approx(b, abs=1e-9)


@pytest.mark.parametrize("scores", [quality_scores, toxicity_scores])
def test_odd_rows(spark, odd, empty, scores):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, None), (None, 0, 1), (99, 0, 1), (6, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert scores(empty, labels).count() == 0
    for some in (labels, labels.limit(0)):
        got = scores(odd, some).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
        assert len({r.score for r in got if r.doc_id in (8, 9)}) == 1


def test_kept_rows(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = keep_good(docs, labels)
    want = {r.doc_id for r in quality_scores(docs, labels).collect() if r.predicted}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    assert set(keep_good(odd, labels.limit(0)).columns) == set(odd.columns)


def test_statistics():
    assert statistics("") == statistics(" \n") == [0.0] * STATISTICS
    for t in ("a", "word " * 5000, "\n", "é中😀", "x\n\n\ny"):
        assert len(statistics(t)) == STATISTICS and np.isfinite(statistics(t)).all()


def test_isotonic():
    rng = np.random.default_rng(1)
    s = rng.random(400)
    knots, values = isotonic(s, (rng.random(400) < s).astype(float))
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all() and 0 < values[0] < values[-1] < 1


def test_label_model():
    rng = np.random.default_rng(2)
    y = (rng.random(4000) < 0.1).astype(float)
    hit = np.where(y[:, None] > 0, rng.random((4000, 12)) < 0.4, rng.random((4000, 12)) < 0.01)
    votes = np.column_stack([hit, hit[:, 0]]).astype(np.uint8)  # the last repeats the first
    m = LabelModel.fit(votes, 0.1)
    assert auc(m.posterior(votes), y) > 0.97 and m.weight[-1] < m.weight[3]
    assert (m.hit[1] > 10 * m.hit[0]).all()
    assert terms_of({"abcdef", "abcxyz", "abcd"}) >= {"abcd", "^abcd", "^abcx"}


def test_sketches_part_rows_that_only_share_a_passage():
    passage = " ".join(f"licence{i}" for i in range(60))
    rows = [f"{passage} {' '.join(f'{k}own{i}' for i in range(60))}" for k in range(200)]
    assert len({sketch(t) for t in rows}) > 180 and sketch(rows[0]) == sketch(rows[0] + " ")


def test_hit_rates_are_found_without_labels(tables):
    docs, labels = tables
    learned = labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    m = fit(docs, learned)
    x = docs.join(learned, "doc_id").select("text", "toxic").toPandas()
    votes = m.features.matrix(list(x.text.fillna("")))[:, : m.voters.hit.shape[1]]
    off = np.abs(m.voters.hit[1] - votes[x.toxic == 1].mean(axis=0))
    assert votes.shape[1] > 50 and off.mean() < 0.015 and off.max() < 0.1


def test_toxicity_scores_like_a_plain_model(spark):
    """The query's scores, from the fitted weights, recomputed text by text without Spark, and those weights, from a plain solver."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learned = labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    m = fit(docs, learned)
    names, want = m.features.names, {}
    plain = {t: k for k, t in enumerate(names) if k >= len(LEXICON) + len(PATTERNS)}
    for r in docs.collect():
        lower = (r.text or "").lower()
        words = set(re.findall(r"\w+", lower))
        hits = {plain[t] for t in terms_of(words) if t in plain} | {k for k, ws in enumerate(LEXICON.values()) if words & set(ws.split())}
        masked, aimed = (bool(re.search(p, lower)) for p in PATTERNS.values())
        hits |= {len(LEXICON)} if masked else set()
        hits |= {len(LEXICON) + 1} if aimed and hits else set()
        want[r.doc_id] = 1 / (1 + np.exp(-(m.weight[-1] + sum(m.weight[k] for k in hits))))
    got = {r.doc_id: r.score for r in toxicity_scores(docs, learned).collect()}
    assert got == pytest.approx(want, abs=1e-9)

    rng = np.random.default_rng(11)
    x, y = rng.integers(0, 2, (500, 6)), rng.random(500)
    w, z = logistic(x, y, rounds=40), np.column_stack([x, np.ones(500)])
    p = 1 / (1 + np.exp(-z @ w))
    assert np.abs(z.T @ (p - y) + np.array([1.0] * 6 + [1e-3]) * np.append(w[:-1], 0)).max() < 1e-3  # the loss's gradient is nought


def test_quality_scores_like_a_plain_ridge_fit(spark):
    """Scores of the whole query against normal equations solved at once in numpy, with the same features and calibrating rows."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r.score for r in quality_scores(docs, labels).collect()}
    x = {r.doc_id: statistics(r.text or "") for r in docs.collect()}
    rows = labels.withColumn("c", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) == 0).where("quality is not null").collect()
    rows = [(x[r.doc_id], r.quality, r.c) for r in rows if r.doc_id in x and zlib.crc32(str(r.doc_id).encode()) % 5]
    s, y, calibrates = (np.array(v) for v in zip(*rows, strict=True))
    scale = s.std(axis=0)
    fourier = quality.Fourier.of(s.mean(axis=0), np.where(scale > 1e-9, scale, 1.0))
    z, t = fourier(s[~calibrates]), y[~calibrates]
    w = np.where(t > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    ridge = quality.RIDGE * max(1.0, (w @ (z * z)).sum() / z.shape[1])
    root = np.sqrt(w)[:, None]  # least squares with the ridge as further rows, in place of normal equations
    weight = np.linalg.lstsq(np.vstack([z * root, np.sqrt(ridge) * np.eye(z.shape[1])]), np.append(t * root[:, 0], np.zeros(z.shape[1])), rcond=None)[0]
    raw, held = fourier(np.array(list(x.values()))) @ weight, fourier(s[calibrates]) @ weight
    knots, values = isotonic(held, y[calibrates])
    want = np.clip(0.999 * np.interp(raw, knots, values) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)
    assert got == pytest.approx(dict(zip(x, want, strict=True)), abs=1e-6)


def test_isotonic_like_the_largest_of_least_means():
    rng = np.random.default_rng(13)
    score, label = rng.random(60), (rng.random(60) < 0.5).astype(float)
    knots, values = isotonic(score, label)
    y = label[np.argsort(score)]
    want = [max(min(y[i : j + 1].mean() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    want = np.clip(want, 0.5 / 60, 1 - 0.5 / 60)
    assert np.allclose(np.unique(np.round(values, 9)), np.unique(np.round(want, 9))) and len(knots) == len(values)


def test_posterior_like_every_voter_multiplied():
    votes = (np.random.default_rng(12).random((300, 9)) < 0.2).astype(np.uint8)
    m = LabelModel.fit(votes, 0.2)
    for v, p in zip(votes, m.posterior(votes), strict=True):
        odds = m.prior / (1 - m.prior) * (m.none[1] / m.none[0] if not v.any() else 1.0)
        for k in np.flatnonzero(v):
            odds *= (m.hit[1, k] / m.hit[0, k]) ** m.weight[k]
        assert p == pytest.approx(odds / (1 + odds), rel=1e-9)
