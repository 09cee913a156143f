"""Toxicity by weak supervision.

Voters: fixed lexicon and pattern voters, and voters induced from labelled rows (words, and beginnings shared by
one, two or three different words, that toxic rows hold much more often than others). A generative label model estimates each
voter's hit rates under both classes by expectation maximisation, from how the voters agree, and the correlation of each
pair of voters given the class; a voter's evidence is divided by how much it repeats its correlated peers. A voter that
doesn't hit abstains; that none hits is a vote of its own, for the other class. Labels choose the induced voters and
give the model the classes' balance; they are no evidence for any row's posterior. The posterior labels train a linear
classifier (ridge logistic regression) over the voters and further words, which scores every row.

The fit takes about `FIT_ROWS` labelled rows at most, those of the lowest hashes of the id (a documented bound), and one
of each set of rows among them with one label and one sketch (the `SKETCH` least hashes of five-word runs), so that a
much copied text doesn't make voters of its chance words; rows that share passages only have different sketches.
`VOTERS` and `TERMS` are the model's size: the most telling terms that occur in enough toxic rows. Scoring
covers every row, whole texts of any length, in one pass without a shuffle. Labels, lang, source and doc_id are never
inputs of a score.

Defined results: null and empty texts score as texts without any feature; equal texts get equal scores and repeated rows
a row each; an empty table gives no rows; other columns, whatever their names, are not read; labels that are
null or whose document is missing are ignored. Without labels of both kinds only the fixed voters count.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, fold, hash_sample, persist, small_batches, texts, tidy

FIT_ROWS, VOTERS, TERMS, SKETCH, THRESHOLD = 30_000, 128, 320, 4, 0.3
PREFIXES = (4, 5, 6)
MEMO = 400_000

#: A small public lexicon of insults and threats in four languages.
LEXICON = {
    "insult_en": "idiot moron stupid loser clown trash scum worthless pathetic disgusting dumb imbecile bastard jerk fool filth vermin",
    "insult_de": "idiot trottel arschloch dummkopf abschaum schwachkopf versager drecksau",
    "insult_fr": "idiot imbécile connard salaud ordure crétin abruti débile",
    "insult_es": "idiota imbécil estúpido estúpida basura cabrón gilipollas escoria",
    "threat": "kill murder töten tuer matar",
}
#: Patterns of insults that are masked or aimed at the reader.
PATTERNS = {
    "masked": r"\b[fs][*#@$]{2,3}[kt]\b|\bb[*!1]tch\b",
    "aimed": r"\byou(?: are|'re)? (?:an? |such an? )?(?:idiot|moron|loser|clown|scum|trash|stupid|pathetic|worthless|disgusting)\b",
}
_WORD = re.compile(r"\w+")
_PATTERNS = {k: re.compile(p) for k, p in PATTERNS.items()}
_MARKS = "*#@$!1"


def words_of(lower: str) -> set[str]:
    return set(_WORD.findall(lower))


def terms_of(words: set[str]) -> set[str]:
    """The words and, marked by ^, how they begin; #2 and #3: at least as many different words begin so."""
    out = set(words)
    for n in PREFIXES:
        for p, k in Counter(w[:n] for w in words if len(w) > n).items():
            out.add("^" + p)
            if k > 1:
                out.add(f"^{p}#2")
                if k > 2:
                    out.add(f"^{p}#3")
    return out


def sketch(lower: str) -> bytes:
    """The least hashes of the text's five-word runs: those of near copies are mostly the same, those of texts that share a passage hardly ever."""
    w = lower.split()
    runs = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    return b"".join(heapq.nsmallest(SKETCH, {hashlib.blake2b(r.encode("utf-8", "surrogatepass"), digest_size=8).digest() for r in runs}))


@dataclass
class LabelModel:
    """P(voter hits | class) for both classes, the prior, and each voter's weight after its correlations."""

    prior: float
    hit: np.ndarray  # 2 x voters
    none: np.ndarray  # that no voter hits
    weight: np.ndarray
    correlation: np.ndarray

    @classmethod
    def fit(cls, votes: np.ndarray, prior: float, rounds: int = 60) -> LabelModel:
        """votes: rows x voters of 0 or 1; prior: the share of class 1, which is held fixed, as any chance agreement could make a class
        of its own otherwise."""
        v = votes.astype(np.float64)
        k = v.shape[1]
        q, prior = np.clip(v.sum(axis=1) / 3, 0.01, 0.99), float(np.clip(prior, 1e-4, 1 - 1e-4))
        weight, corr = np.ones(k), np.zeros((k, k))
        for step in range(rounds):
            m = np.array([1 - q, q])
            hit = (m @ v + [[0.02], [0.5]]) / (m.sum(axis=1, keepdims=True) + 1.0)
            hit = np.clip(hit, 1e-5, 1 - 1e-3)
            hit[0] = np.minimum(hit[0], hit[1])  # a voter never speaks against what it stands for
            none = (m @ (v.sum(axis=1) == 0) + [0.5, 0.5]) / (m.sum(axis=1) + 1.0)
            if step in (5, 15):  # residual correlations given the class, then how often each voter's evidence is repeated
                r = np.sqrt(m[0])[:, None] * (v - hit[0]), np.sqrt(m[1])[:, None] * (v - hit[1])
                c = sum(x.T @ x for x in r)
                s = np.sqrt(np.maximum(np.diag(c), 1e-9))
                corr = c / np.outer(s, s)
                weight = 1 / np.sqrt(np.maximum(1.0, np.where(np.abs(corr) > 0.3, np.abs(corr), 0).sum(axis=1)))
            now = cls(prior, hit, none, weight, corr).posterior(votes)
            if np.abs(now - q).max() < 1e-6 and step > 15:
                break
            q = now
        return cls(prior, hit, none, weight, corr)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = np.log(self.prior / (1 - self.prior)) + votes @ (self.weight * np.log(self.hit[1] / self.hit[0]))
        z += (votes.sum(axis=1) == 0) * np.log(self.none[1] / self.none[0])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Newton's method on soft labels; the last weight is the intercept's."""
    d = x.shape[1]
    w = np.zeros(d + 1)
    w[-1] = np.log(max(1e-3, y.mean()) / max(1e-3, 1 - y.mean()))
    pen = np.full(d + 1, ridge)
    pen[-1] = 1e-3
    for _ in range(rounds):
        g, h = pen * np.append(w[:-1], 0), np.diag(pen)
        for lo in range(0, len(x), 4096):
            b = np.column_stack([x[lo : lo + 4096].astype(np.float64), np.ones(len(x[lo : lo + 4096]))])
            p = 1 / (1 + np.exp(-np.clip(b @ w, -30, 30)))
            g += b.T @ (p - y[lo : lo + 4096])
            h += (b * (p * (1 - p))[:, None]).T @ b
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-4:
            break
    return w


class Features:
    """0/1 features of a text: the fixed voters, then terms."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.names = [*LEXICON, *PATTERNS, *terms]
        self.of_word: dict[str, list[int]] = {}
        for v, k in ((w, k) for k, ws in enumerate(LEXICON.values()) for w in ws.split()):
            self.of_word.setdefault(v, []).append(k)
        self.of_prefix: dict[str, list[tuple[int, int]]] = {}  # (words at least, feature)
        for i, t in enumerate(terms, len(LEXICON) + len(PATTERNS)):
            if t.startswith("^"):
                prefix, _, least = t[1:].partition("#")
                self.of_prefix.setdefault(prefix, []).append((int(least or 1), i))
            else:
                self.of_word.setdefault(t, []).append(i)
        self.lengths = sorted({len(p) for p in self.of_prefix})
        self.memo: dict[str, tuple[tuple[int, ...], tuple[str, ...]]] = {}

    def __getstate__(self):
        return self.terms

    def __setstate__(self, terms):
        self.__init__(terms)

    def of(self, text: str) -> set[int]:
        lower = text.lower()
        memo, out, begun = self.memo, set(), []
        for w in words_of(lower):
            f = memo.get(w)
            if f is None:
                f = tuple(self.of_word.get(w, ())), tuple(w[:n] for n in self.lengths if len(w) > n and w[:n] in self.of_prefix)
                if len(memo) >= MEMO:
                    memo.clear()
                memo[w] = f = f if f[0] or f[1] else ()
            if f:
                out.update(f[0])
                begun += f[1]
        for p, k in Counter(begun).items() if begun else ():
            out.update(i for least, i in self.of_prefix[p] if k >= least)
        if any(c in lower for c in _MARKS):
            out |= {len(LEXICON)} if _PATTERNS["masked"].search(lower) else set()
        if "you" in lower and out and _PATTERNS["aimed"].search(lower):
            out.add(len(LEXICON) + 1)
        return out

    def matrix(self, docs: list[str]) -> np.ndarray:
        x = np.zeros((len(docs), len(self.names)), np.uint8)
        for i, t in enumerate(docs):
            x[i, list(self.of(t))] = 1
        return x


@dataclass
class ToxicityModel:
    features: Features
    weight: np.ndarray
    voters: LabelModel | None = None

    def scores(self, docs: list[str]) -> np.ndarray:
        z = np.full(len(docs), self.weight[-1])
        for i, t in enumerate(docs):
            hits = self.features.of(t)
            if hits:
                z[i] += self.weight[list(hits)].sum()
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _counted(rows: DataFrame, keep: frozenset | None) -> DataFrame:
    """How many rows hold each term; each partition adds up its own first."""

    def run(batches):
        n: Counter = Counter()
        for b in batches:
            for t in texts(b):
                s = terms_of(words_of(t.lower()))
                n.update(s if keep is None else s & keep)
        for lo in range(0, len(items := sorted(n.items())), 10_000):
            part = items[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([v for _, v in part], pa.int64())], names=["term", "n"])

    return rows.select("text").mapInArrow(tidy(run), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _unlike(features: Features, rows: DataFrame) -> list[str]:
    """The features' terms without those that hit nearly the same rows as an earlier one."""

    def run(batches):
        a = 0
        for b in batches:
            x = features.matrix(texts(b))[:, -len(features.terms) :].astype(np.float64)
            a = a + x.T @ x
        if not isinstance(a, int):
            yield pa.RecordBatch.from_arrays([pa.array([a.astype(np.uint32).tobytes()])], names=["a"])

    n = len(features.terms)
    if not n:
        return []
    both = sum((np.frombuffer(r.a, np.uint32).reshape(n, n).astype(np.float64) for r in rows.select("text").coalesce(8).mapInArrow(tidy(run), "a binary").collect()), np.zeros((n, n)))
    size, kept = np.maximum(np.diag(both), 1), []
    for i in range(n):
        if all(both[i, j] <= 0.9 * (size[i] + size[j] - both[i, j]) for j in kept):
            kept.append(i)
    return [features.terms[i] for i in kept[:TERMS]]


def fit(df: DataFrame, labels: DataFrame, target: str = "toxic", text: str = "text", id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """labels: doc_id and `target`, of the rows that may be learned from."""
    small_batches(df.sparkSession)
    known = labels.select(F.col("doc_id").alias("id"), F.col(target).cast("int").alias("y")).where("y is not null and id is not null")
    some = hash_sample(known, known.count(), fit_rows, "id").limit(2 * fit_rows)  # a proven bound, so that it may be broadcast
    src = df.select(df[id_col].cast("long").alias("id"), df[text].cast("string").alias("text")).join(F.broadcast(some), "id")

    def keyed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("text"), b.column("y"), pa.array([sketch(t.lower()) for t in texts(b)], pa.binary())], names=["text", "y", "sketch"])

    rows = persist(src.select("text", "y").mapInArrow(tidy(keyed), "text string, y int, sketch binary").groupBy("sketch", "y").agg(F.min(F.struct(F.xxhash64("text"), "text", "y")).alias("r")).select("r.text", "r.y"), "toxicity-fit")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    terms: list[str] = []
    if n1 and n0:
        least = max(3, n1 // 200)
        held = {r.term: r.n for r in _counted(rows.where("y = 1"), None).where(F.col("n") >= least).collect()}  # at most 200 times as many as a row has terms
        others = {r.term: r.n for r in _counted(rows.where("y = 0"), frozenset(held)).collect()}
        # a lower bound of the rate among toxic rows against an upper bound of the rate among the others
        # (a beginning that several words share is less likely to be chance)
        lift = {t: (max(0.0, n - (0.8 if "#" in t else 1.5) * n**0.5) / n1) / ((others.get(t, 0) + 1.5 * others.get(t, 0) ** 0.5 + 1) / n0) for t, n in held.items()}
        terms = sorted((t for t in held if lift[t] > 3), key=lambda t: (-lift[t], t))[: 2 * TERMS]
        terms = _unlike(Features(terms), rows.where("y = 1"))
    features = Features(terms)
    fixed = len(LEXICON) + len(PATTERNS)

    def rowed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in features.matrix(texts(b))], pa.binary()), b.column("y")], names=["x", "y"])

    got = rows.mapInArrow(tidy(rowed), "x binary, y int").collect()  # 2 * fit_rows at most, a few hundred bytes each
    discard(rows)
    if not got or not n1 or not n0:
        weight = np.zeros(len(features.names) + 1)
        weight[:fixed], weight[-1] = 3.0, -3.0
        return ToxicityModel(features, weight)
    x = np.frombuffer(b"".join(r.x for r in got), np.uint8).reshape(len(got), -1)
    votes = x[:, : fixed + min(VOTERS, len(terms))]
    model = LabelModel.fit(votes, n1 / (n1 + n0))
    return ToxicityModel(features, logistic(x, model.posterior(votes)), model)


def toxicity_scores(df: DataFrame, labels: DataFrame, target: str = "toxic", text: str = "text", id_col: str = "doc_id", held_out: tuple[int, int] = (4, 2), threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Labels are learned only where crc32(id) mod held_out[0] isn't held_out[1]."""
    model = fit(df, labels.where(fold(held_out[0]) != held_out[1]), target, text, id_col)
    model.voters = None

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(texts(b)))], names=["doc_id", "score"])

    out = df.select(df[id_col].cast("long").alias("doc_id"), df[text].cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, score double")
    return out.select("doc_id", (fold(held_out[0]) == held_out[1]).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
