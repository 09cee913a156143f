"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

One pass over the texts turns each into a fixed number of statistics (lengths, shares of character classes, repetition,
entropy, compressibility), kept as a table. Random Fourier features approximate a Gaussian kernel over the standardised
statistics. Each partition of the training rows sums its part of the normal equations; the sums are added up and solved
for ridge weights. Isotonic regression on rows that the ridge fit has not seen maps scores to probabilities.

The fit takes about `FIT_ROWS` labelled rows at most (those of the lowest hashes of the id, a documented bound); scoring
covers every row. Labels, lang, source and doc_id are never inputs of a score.

Defined results: null and empty texts get the score of their (all-zero) statistics; equal texts get equal scores;
repeated rows get a row each; texts of any length are measured whole; an empty table gives no rows; other columns,
whatever their names, are not read (`keep_good` returns them as they are);
labels that are null or whose document is missing are ignored; repeated labels count each; without labels of both
kinds every score is the share of label 1 among the fit's rows (0.5 with none).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, fold, hash_sample, persist, small_batches, texts, tidy

FEATURES, RIDGE, SEED, FIT_ROWS, FIT_PARTS = 384, 1e-3, 20_240_229, 200_000, 16
THRESHOLD = 0.3

_PROSE = np.zeros(256, bool)
_PROSE[[*b" \t\n\r.,;:'\"()-?!"]] = True
_CLASS = np.zeros((256, 6), np.float64)  # lower, upper, digit, space, prose marks, other ASCII marks
for _c in range(128):
    _CLASS[_c, 0 if 97 <= _c < 123 else 1 if 65 <= _c < 91 else 2 if 48 <= _c < 58 else 3 if _c in (32, 9, 10, 13) else 4 if _PROSE[_c] else 5] = 1
STATISTICS = 27
SLICE = 1 << 20


def statistics(text: str) -> list[float]:
    """STATISTICS numbers of a whole text; all 0 for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * STATISTICS
    data = text.encode("utf-8", "surrogatepass")
    n, nw = len(data), len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = counts @ _CLASS / n
    p = counts[counts > 0] / n
    entropy = float(-(p * np.log2(p)).sum())
    seen = Counter(words)
    top = seen.most_common(3)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    upper = sum(map(str.isupper, words))
    title = sum(map(str.istitle, words))
    letters = sum(map(str.isalpha, words))
    size = np.fromiter(map(len, words), np.float64, nw)
    lines = text.split("\n")
    full = [x for x in lines if x]
    ends = sum(x[-1] in ".!?" for x in full)
    packer = zlib.compressobj(1)
    packed = sum(len(packer.compress(data[i : i + SLICE])) for i in range(0, n, SLICE)) + len(packer.flush())
    marks = counts[[33, 124]].sum() / nw, counts[[42, 36, 37, 38, 35, 64, 94, 126, 60, 62, 61, 95, 92]].sum() / nw
    return [
        math.log1p(n), math.log1p(nw), *map(float, shares), float(counts[128:].sum()) / n, entropy, float(size.mean()), float(size.std()), math.log(float(size.max())),
        len(seen) / nw, math.log(len(seen)) / math.log(nw + 1), top[0][1] / nw, sum(c for _, c in top) / nw, same / nw, upper / nw, title / nw, letters / nw,
        len(set(full)) / max(1, len(full)), ends / max(1, len(full)), math.log1p(nw / len(full)), packed / n, float(marks[0]), float(marks[1]),
    ]


def with_statistics(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and stats array<double>, one row for each row of df."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([statistics(t) for t in texts(b)], pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text].cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, stats array<double>")


@dataclass
class Fourier:
    """cos(x W + b) over standardised statistics: a random approximation of a Gaussian kernel."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    shift: np.ndarray

    @classmethod
    def of(cls, mean: np.ndarray, scale: np.ndarray, n: int = FEATURES, seed: int = SEED) -> Fourier:
        rng = np.random.default_rng(seed)
        width = math.sqrt(2 * len(mean))  # the median distance of standardised rows
        return cls(mean, scale, rng.standard_normal((len(mean), n)) / width, rng.uniform(0, 2 * np.pi, n))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        out = np.empty((len(x), self.weight.shape[1] + 1 + z.shape[1]))
        out[:, : self.weight.shape[1]] = np.cos(z @ self.weight + self.shift) * math.sqrt(2 / self.weight.shape[1])
        out[:, self.weight.shape[1] : -1] = 0.1 * z
        out[:, -1] = 1
        return out


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares non-decreasing fit: the blocks' middle scores and their means, short of 0 and 1."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of labels, sum of scores
    for s, y in zip(score[order], label[order], strict=True):
        blocks.append([1.0, float(y), float(s)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, a, b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + a, blocks[-1][2] + b]
    least = 0.5 / len(score)
    return np.array([b[2] / b[0] for b in blocks]), np.clip([b[1] / b[0] for b in blocks], least, 1 - least)


@dataclass
class QualityModel:
    fourier: Fourier | None
    weight: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated probability; a slight slope within level stretches keeps the raw order."""
        if self.fourier is None:
            return np.full(len(x), self.prior)
        raw = self.raw(x)
        p = np.interp(raw, self.knots, self.values)
        return np.clip(0.999 * p + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def _matrix(batch) -> np.ndarray:
    col = batch.column("stats")
    return np.asarray(col.flatten()).reshape(batch.num_rows, STATISTICS)


def fit(stats: DataFrame, labels: DataFrame, target: str = "quality", fit_rows: int = FIT_ROWS) -> QualityModel:
    """labels: doc_id and `target`, of the rows that may be learned from. Its fifth by another hash calibrates."""
    known = labels.select("doc_id", F.col(target).cast("double").alias("y")).where("y is not null")
    rows = stats.join(hash_sample(known, known.count(), fit_rows), "doc_id").select("doc_id", "stats", "y")
    rows = persist(rows.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) == 0).repartition(FIT_PARTS), "quality-fit")
    n, ones = rows.agg(F.count("*"), F.sum("y")).first()
    prior = ones / n if n else 0.5
    if not n or not 0 < ones < n:
        discard(rows)
        return QualityModel(None, np.zeros(0), np.zeros(0), np.zeros(0), prior)
    moments = rows.select(*(f(F.col("stats")[k]).alias(f"{a}{k}") for k in range(STATISTICS) for a, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scale = np.array([moments[f"s{k}"] for k in range(STATISTICS)])
    fourier = Fourier.of(np.array([moments[f"m{k}"] for k in range(STATISTICS)]), np.where(scale > 1e-9, scale, 1.0))

    def sums(batches):
        a = b = None
        for batch in batches:
            x, y = fourier(_matrix(batch)), np.asarray(batch.column("y"))
            w = np.where(y > 0, 0.5 / prior, 0.5 / (1 - prior))  # both labels weigh alike
            a, b = (0 if a is None else a) + (x * w[:, None]).T @ x, (0 if b is None else b) + x.T @ (w * y)
        if a is not None:
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()])], names=["a", "b"])

    parts = rows.where("not calibrates").mapInArrow(tidy(sums), "a binary, b binary").collect()  # FIT_PARTS at most
    d = len(fourier.shift) + 1 + STATISTICS
    a = sum((np.frombuffer(p.a).reshape(d, d) for p in parts), np.zeros((d, d)))
    b = sum((np.frombuffer(p.b) for p in parts), np.zeros(d))
    model = QualityModel(fourier, np.linalg.solve(a + RIDGE * max(1.0, np.trace(a) / d) * np.eye(d), b), np.array([0.5]), np.array([prior]), prior)

    def raws(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch))), batch.column("y")], names=["raw", "y"])

    held = np.array([tuple(r) for r in rows.where("calibrates").mapInArrow(tidy(raws), "raw double, y double").collect()]).reshape(-1, 2)  # a fifth of fit_rows
    discard(rows)
    if len(held):
        model.knots, model.values = isotonic(held[:, 0], held[:, 1])
    return model


def quality_scores(df: DataFrame, labels: DataFrame, target: str = "quality", text: str = "text", id_col: str = "doc_id", held_out: tuple[int, int] = (5, 0), threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Labels are learned only where crc32(id) mod held_out[0] isn't held_out[1]."""
    stats = persist(with_statistics(df, text, id_col), "quality-stats")
    model = fit(stats, labels.where(fold(held_out[0]) != held_out[1]), target)
    return scored(stats, model, held_out, threshold)


def scored(stats: DataFrame, model: QualityModel, held_out: tuple[int, int], threshold: float) -> DataFrame:
    def run(batches):
        for b in batches:
            s = model.score(_matrix(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    out = stats.mapInArrow(tidy(run), "doc_id long, score double")
    return out.select("doc_id", (fold(held_out[0]) == held_out[1]).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = THRESHOLD, held_out: tuple[int, int] = (5, 0)) -> DataFrame:
    """df's rows, with all their columns, whose text scores at least `threshold`. Texts are measured and scored where they lie: none is shuffled."""
    small_batches(df.sparkSession)
    learned = labels.where((fold(held_out[0]) != held_out[1]) & F.col(target).isNotNull())
    # only texts that the fit takes are measured for it; their ids are bounded, so that they may be broadcast
    ids = hash_sample(learned, learned.count(), FIT_ROWS).select("doc_id").distinct().limit(2 * FIT_ROWS)
    stats = persist(with_statistics(df.join(F.broadcast(ids), "doc_id", "left_semi")), "quality-stats")
    model = fit(stats, learned, target)
    discard(stats)

    def run(batches):
        for b in batches:
            t = texts(b)
            keep = []
            for lo in range(0, len(t), 1000):
                keep += (model.score(np.array([statistics(x) for x in t[lo : lo + 1000]]).reshape(-1, STATISTICS)) >= threshold).tolist()
            yield b.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(tidy(run), df.schema)
