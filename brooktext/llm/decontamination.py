"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

CGK's random walk turns a window of text into a string in which a small edit distance becomes a small Hamming distance:
at each step it writes the byte under the cursor, and a random bit for the step and that byte says whether the cursor
moves on. Bit sampling hashes a few places of that string; windows that agree in all places of any sampling are
candidates, if their whole embedded strings agree in a given share of the places too (the Hamming distance that the
embedding is for). Candidates that a lower bound of the edit distance rules out are dropped, the others verified exactly:
an item is found in a text if its edit distance to some stretch of it is at most `1 - similarity` of its length, in
characters, after A-Z are lower-cased and white space is made plain.

Items are sorted into classes by length, each with a plan of its own (`CLASSES`). A window is no longer than the shortest
item allows when windows begin at every `step` bytes of the texts: every copy of an item then holds a whole window at a
known offset, and most hold several, of which some have few edits. On the benchmark's side windows at all offsets are indexed, so that no alignment is lost. Texts are embedded
where they lie, without a shuffle. A window's cost doesn't depend on the number of items. Walks go two steps at a time, by tables of
pairs of letters; windows that share several samplings of a walk are compared once, in parts of bounded size.

The index is made by each worker from the items' texts, which are sent along up to `BLOCK_BYTES`; a larger benchmark is
dealt into blocks of that size, and each block takes a pass of its own over the texts.

Recall for changed copies is measured in the tests by length class up to the threshold, a fifth of the characters edited at
random (above 0.95 in each class); unchanged copies are always found. The plans are made for a similarity of 0.8; at a lower one, recall is lower.
Items shorter than `SHORTEST` bytes hold too few windows and are searched exactly: cut into one piece more than there may be edits, a
copy holds some piece unchanged, and the edit distance is computed wherever a piece stands. Defined results: null and empty texts and items match nothing; repeated
items or rows match each; every stretch of a text of any length is searched; of stretches that are equally near the first counts; an empty table or benchmark
gives no matches; extra columns don't matter.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, texts, tidy

SIMILARITY = 0.8
SHORTEST, BLOCK_BYTES, WINDOWS, PAIRS = 20, 1 << 20, 1 << 14, 1 << 19


class _Plan(NamedTuple):
    """How items of at least so many bytes are looked for."""

    least: int
    step: int  # windows begin at every so many bytes of the texts
    width: int  # and are so long, if the shortest item allows
    walks: int
    samplings: int  # of each walk's embedded string
    places: int  # of each sampling
    agree: float  # share of the embedded string


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[9, 10, 11, 12, 13]] = 32
#: By the recall wanted where a fifth of the characters are edited: short items hold few windows, so theirs are shorter and denser.
CLASSES = (_Plan(150, 16, 50, 4, 4, 11, 0.55), _Plan(80, 10, 30, 4, 4, 12, 0.6), _Plan(20, 3, 14, 6, 4, 8, 0.6))
#: Walks tell letters by the low five bits of their bytes: what is equal stays so, and texts seem nearer by it, never farther.
LETTERS = 32
#: How many of two pairs' letters are equal, by the exclusive or of the pairs.
_ALIKE = np.add(*(x == 0 for x in np.divmod(np.arange(LETTERS * LETTERS), LETTERS)), dtype=np.int64)


def plain(text: str) -> str:
    """The text as it is compared: of the same length in characters and bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN.tobytes()).decode("utf-8", "surrogatepass")


_ONE = np.uint64(1)


class _Step(NamedTuple):
    """Two steps of a walk at once, by the pair of letters that begins under the cursor."""

    move: np.ndarray  # how far the cursor goes
    written: np.ndarray  # the two letters written, as a pair
    keys: np.ndarray  # what each sampling adds to its hash, if it has a place here


def _pairs(data: np.ndarray) -> np.ndarray:
    """Each byte's letter with the next one's, as walks read them."""
    letters = (data % LETTERS).astype(np.uint16)
    letters[:-1] += letters[1:] * np.uint16(LETTERS)
    return letters


class _Class:
    """The windows of the items of one length class."""

    def __init__(self, items: list[tuple[int, bytes]], plan: _Plan, seed: int = 20_240_401):
        rng = np.random.default_rng(seed + plan.least)
        self.step, self.walks, self.samplings = plan.step, plan.walks, plan.samplings
        self.width = max(8, min(plan.width, min(len(t) for _, t in items) - plan.step + 1)) // 2 * 2
        self.agree = plan.agree * self.width
        self.steps = [self.walk(rng, plan.places) for _ in range(self.walks)]
        data = np.frombuffer(b"".join(t for _, t in items) + bytes(self.width + 8), np.uint8)
        base = np.concatenate([[0], np.cumsum([len(t) for _, t in items])])
        starts = [np.arange(base[k], base[k + 1] - self.width + 1) for k in range(len(items))]
        self.item = np.repeat([i for i, _ in items], [len(s) for s in starts])
        self.offset = np.concatenate([s - base[k] for k, s in enumerate(starts)])
        every = np.concatenate(starts)
        self.pairs, self.start = _pairs(data), every
        self.tables = []
        parts = [[h for walk in self.hashes(self.pairs, every[lo : lo + WINDOWS]) for h in walk] for lo in range(0, len(every), WINDOWS)]
        for k in range(self.walks * self.samplings):
            h = np.concatenate([p[k] for p in parts])
            by = np.argsort(h, kind="stable")
            marks = np.zeros(1 << 20, bool)
            marks[h >> 12] = True
            self.tables.append((marks, h[by], by))

    def walk(self, rng: np.random.Generator, places: int) -> list[_Step]:
        moves = rng.integers(0, 2, (self.width, LETTERS), dtype=np.int64)
        keys = rng.integers(0, 1 << 32, (self.width, LETTERS), dtype=np.uint32)
        chosen = [rng.choice(self.width, places, replace=self.width < places) for _ in range(self.samplings)]
        second, first = np.divmod(np.arange(LETTERS * LETTERS), LETTERS)
        out = []
        for j in range(0, self.width, 2):
            then = np.where(moves[j, first] == 1, second, first)
            adds = np.zeros((LETTERS * LETTERS, -(-self.samplings // 4) * 4), np.uint32)  # rows of 16 bytes are taken as fast as numbers
            for s, places_of in enumerate(chosen):
                for k, letter in ((j, first), (j + 1, then)):
                    if k in places_of:
                        adds[:, s] += keys[k, letter]
            out.append(_Step(moves[j, first] + moves[j + 1, then], first + LETTERS * then, adds))
        return out

    def hashes(self, pairs: np.ndarray, starts: np.ndarray):
        """The samplings of the windows at `starts`, walk by walk."""
        pair, code, move = (np.empty(len(starts), t) for t in (np.uint16, np.int64, np.int64))
        for steps in self.steps:
            at, h = starts.astype(np.int64), np.zeros((len(starts), steps[0].keys.shape[1]), np.uint32)
            key = np.empty_like(h)
            for step in steps:
                pairs.take(at, out=pair, mode="clip")
                np.copyto(code, pair)
                step.keys.take(code, 0, out=key, mode="clip")
                h += key
                step.move.take(code, out=move, mode="clip")
                at += move
            yield [np.ascontiguousarray(h[:, s]) for s in range(self.samplings)]

    def agreement(self, walk: int, pairs: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """In how many places the embedded strings of windows of the data and of the items' windows agree."""
        out = np.zeros(len(at), np.int64)
        for lo in range(0, len(at), WINDOWS):
            a, b = at[lo : lo + WINDOWS].astype(np.int64), self.start[rows[lo : lo + WINDOWS]].astype(np.int64)
            for step in self.steps[walk]:
                x, y = pairs.take(a).astype(np.int64), self.pairs.take(b).astype(np.int64)
                out[lo : lo + WINDOWS] += _ALIKE.take(step.written.take(x) ^ step.written.take(y))
                a += step.move.take(x)
                b += step.move.take(y)
        return out

    def candidates(self, pairs: np.ndarray, size: int):
        """(position, item, offset) of windows of the first `size` bytes that share a sampling with an item's window."""
        for lo in range(0, max(0, size - self.width + 1), self.step * WINDOWS):
            starts = np.arange(lo, min(size - self.width + 1, lo + self.step * WINDOWS), self.step)
            for w, walk in enumerate(self.hashes(pairs, starts)):
                for at, row in self.shared(w, walk, starts):
                    alike = self.agreement(w, pairs, at, row) >= self.agree
                    yield at[alike], self.item[row[alike]], self.offset[row[alike]]

    def shared(self, walk: int, samplings: list[np.ndarray], starts: np.ndarray):
        """(position, row) of windows that share a sampling of a walk with an item's window: each pair once, in parts of about `PAIRS`."""
        tables, hits = self.tables[walk * self.samplings : (walk + 1) * self.samplings], []
        for s, ((marks, keys, _), h) in enumerate(zip(tables, samplings, strict=True)):
            some = np.flatnonzero(marks.take(h >> 12))
            a, b = np.searchsorted(keys, h[some], "left"), np.searchsorted(keys, h[some], "right")
            held = b > a
            hits.append((some[held], np.full(held.sum(), s), a[held], b[held] - a[held]))
        window, table, first, n = (np.concatenate(x) for x in zip(*hits, strict=True))
        if not len(window):
            return
        by = np.argsort(window, kind="stable")
        window, table, first, n = window[by], table[by], first[by], n[by]
        begins = np.flatnonzero(np.diff(window, prepend=-1))  # a window's hits stay together
        part = (np.cumsum(n) - n)[begins] // PAIRS
        for hit in np.split(np.arange(len(window)), begins[np.flatnonzero(np.diff(part)) + 1]):
            size = n[hit]
            place = np.repeat(first[hit] - np.cumsum(size) + size, size) + np.arange(size.sum())
            of, row = np.repeat(table[hit], size), np.empty(len(place), np.int64)
            for s, (_, _, rows) in enumerate(tables):
                row[of == s] = rows[place[of == s]]
            at, row = np.divmod(np.unique(np.repeat(starts[window[hit]], size) * len(self.start) + row), len(self.start))
            yield at, row


def nearest(pattern: str, text: str, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the stretch of text nearest to the pattern, if at most `most` edits away.

    Bit-parallel: a column of the table of edit distances is held as two big integers."""

    def ends(pattern: str, text: str, free: bool) -> tuple[int, int]:
        m, masks = len(pattern), {}
        for i, c in enumerate(pattern):
            masks[c] = masks.get(c, 0) | 1 << i
        full, top = (1 << m) - 1, 1 << m - 1
        pv, mv, score, best, at = full, 0, m, m, 0
        for k, c in enumerate(text):
            eq = masks.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv) & full, pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = (ph << 1 | (0 if free else 1)) & full, mh << 1 & full
            pv, mv = mh | ~(xv | ph) & full, ph & xv
            if score < best:
                best, at = score, k + 1
        return best, at

    best, end = ends(pattern, text, True)
    if best > most:
        return None
    size = ends(pattern[::-1], text[:end][::-1], False)[1]
    return best, end - size, end


def exactly(item: str, text: str, most: int) -> tuple[int, int, int] | None:
    """As nearest(), for a short item: only about the places where one of most + 1 pieces of the item stands unchanged, as one does in every such stretch."""
    if most >= len(item):
        return nearest(item, text, most)
    cuts, spans = [len(item) * j // (most + 1) for j in range(most + 2)], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        at = text.find(item[a:b])
        while at >= 0:
            spans.append((max(0, at - a - most), at - a + len(item) + most))
            at = text.find(item[a:b], at + 1)
    joined: list[list[int]] = []
    for lo, hi in sorted(spans):
        if joined and lo <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], hi)
        else:
            joined.append([lo, hi])
    found = [(got[0], got[1] + lo, got[2] + lo) for lo, hi in joined if (got := nearest(item, text[lo:hi], most))]
    return min(found, default=None)


def _letters(text: str) -> np.ndarray:
    """The last byte of each code point: texts seem nearer by it than they are, never farther."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint8)


class _Bound:
    """A lower bound of edit distances of many (text, item, start) at once: an item's pieces of up to 64 characters cost at least
    as many edits as the stretches nearest to each, looked for as far off as the edits allow."""

    def __init__(self, items: list[str]):
        self.size = np.array([len(t) for t in items], np.int64)
        self.pieces = (self.size + 63) // 64
        self.first = np.concatenate([[0], np.cumsum(self.pieces)])
        # A piece's last character has the highest bit; bits below its first one match everything and cost nothing.
        self.masks = np.zeros((max(1, int(self.first[-1])), 256), np.uint64)
        self.held = np.zeros(len(self.masks), np.uint64)
        for k, t in enumerate(items):
            letters = _letters(t).tolist()
            for p in range(int(self.pieces[k])):
                own, row = letters[self.cut(k, p) : self.cut(k, p + 1)], int(self.first[k]) + p
                self.held[row] = (1 << 64) - (1 << 64 - len(own))
                self.masks[row] = ~self.held[row]
                for i, c in enumerate(own, 64 - len(own)):
                    self.masks[row, c] |= np.uint64(1 << i)
        self.masks = self.masks.ravel()

    def cut(self, item, piece):
        """Where a piece of an item begins; pieces of an item are about equally long."""
        return self.size[item] * piece // self.pieces[item]

    def near(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, about: np.ndarray, item: np.ndarray, similarity: float, back: np.ndarray | bool = False) -> np.ndarray:
        """Which of the items may lie at `about` of the texts data[lo:hi]. back: those whose last piece is to be tried first."""
        most = (self.size[item] * (1 - similarity) + 1e-9).astype(np.int64)
        total, left, tried = np.zeros(len(item), np.int64), np.arange(len(item)), 0
        back = np.broadcast_to(back, len(item))
        while len(left := left[(total[left] <= most[left]) & (tried < self.pieces[item[left]])]):
            k, slack = item[left], most[left] + 16
            piece = np.where(back[left], self.pieces[k] - 1 - tried, tried)
            a = np.clip(about[left] + self.cut(k, piece) - slack, lo[left], hi[left])
            b = np.clip(about[left] + self.cut(k, piece + 1) + slack, lo[left], hi[left])
            by = np.argsort(b - a, kind="stable")  # stretches of one length together
            for part in np.split(by, range(2048, len(by), 2048)):
                total[left[part]] += self.least(data, a[part], b[part], self.first[k[part]] + piece[part], self.cut(k[part], piece[part] + 1) - self.cut(k[part], piece[part]))
            tried += 1
        return total <= most

    def least(self, data: np.ndarray, a: np.ndarray, b: np.ndarray, row: np.ndarray, long: np.ndarray) -> np.ndarray:
        """The least edit distance of each piece to a stretch of data[a:b], by columns of bits as in `nearest`."""
        pv, mv, masks, at = self.held[row], np.zeros(len(a), np.uint64), row * 256, a.copy()
        letter, code, top = np.empty(len(a), np.uint8), np.empty(len(a), np.int64), np.empty(len(a), bool)
        eq, xv, xh, ph, mh = (np.empty(len(a), np.uint64) for _ in range(5))
        score, best = long.astype(np.int8), long.astype(np.int8)
        whole = int((b - a).min())
        for j in range(int((b - a).max())):
            data.take(at, out=letter, mode="clip")
            np.copyto(code, letter)
            code += masks
            self.masks.take(code, out=eq, mode="clip")
            np.bitwise_or(eq, mv, out=xv)
            np.bitwise_and(eq, pv, out=xh)
            xh += pv
            xh ^= pv
            xh |= eq
            np.bitwise_or(xh, pv, out=ph)
            np.invert(ph, out=ph)
            ph |= mv
            np.bitwise_and(pv, xh, out=mh)
            score += np.less(ph.view(np.int64), 0, out=top).view(np.int8)
            score -= np.less(mh.view(np.int64), 0, out=top).view(np.int8)
            np.minimum(best, score if j < whole else np.where(at < b, score, best), out=best)
            ph <<= _ONE
            mh <<= _ONE
            np.bitwise_or(xv, ph, out=pv)
            np.invert(pv, out=pv)
            pv |= mh
            np.bitwise_and(ph, xv, out=mv)
            at += 1
        return best


class Index:
    """A block of items, ready to be looked for."""

    def __init__(self, items: tuple[tuple[int, str], ...]):
        self.texts = [(i, plain(t)) for i, t in items if t]
        self.bytes = [t.encode("utf-8", "surrogatepass") for _, t in self.texts]
        self.long = np.array([len(t) for t in self.bytes], np.int64)
        self.short = [k for k, t in enumerate(self.bytes) if len(t) < SHORTEST]
        self.classes = []
        for plan, above in zip(CLASSES, (1 << 62, *(c.least for c in CLASSES)), strict=False):
            if own := [(k, t) for k, t in enumerate(self.bytes) if plan.least <= len(t) < above]:
                self.classes.append(_Class(own, plan))
        self.bound = _Bound([t for _, t in self.texts])
        self.grams = [{t[j : j + 3] for j in range(len(t) - 2)} for _, t in self.texts]

    def verified(self, k: int, text: str, about: int, similarity: float) -> tuple[int, int, int] | None:
        """(distance, start, end) of item k in the text near a start in characters."""
        item = self.texts[k][1]
        most = int(len(item) * (1 - similarity) + 1e-9)
        lo = max(0, about - 2 * most - 8)
        part = text[lo : about + len(item) + 2 * most + 8]
        have = {part[j : j + 3] for j in range(len(part) - 2)}
        if sum(item[j : j + 3] in have for j in range(len(item) - 2)) < len(item) - 2 - 3 * most:
            return None  # each edit spoils three runs of three characters at most
        got = nearest(item, part, most)
        return got and (got[0], got[1] + lo, got[2] + lo)

    def matches(self, docs: list[str], similarity: float = SIMILARITY) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item's number in the block, distance, start, end), the best place of each item found."""
        raw = [t.encode("utf-8", "surrogatepass") for t in docs]
        cuts = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        data = _PLAIN[np.frombuffer(b"".join(raw) + bytes(512), np.uint8)]
        begun = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])  # code points before each byte
        pairs, letters = _pairs(data), _letters(data[: cuts[-1]].tobytes().decode("utf-8", "surrogatepass"))
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in docs]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        near: list[tuple[int, int, int]] = []
        likely: list[tuple[np.ndarray, ...]] = []

        def bounded() -> None:
            d, k, about, offset = (np.concatenate(x) for x in zip(*likely, strict=True))
            # Verification looks 8 characters further than the edits reach, so a start holds those of its eight as well.
            one = np.unique(((d * len(self.texts) + k) << 32) + (about >> 3), return_index=True)[1]
            d, k, about, offset = d[one], k[one], about[one], offset[one]
            # What lies far from the window that agreed is tried first: texts that hold no more than that drop out sooner.
            some = self.bound.near(letters, begun[cuts[d]], begun[cuts[d + 1]], begun[cuts[d]] + about, k, similarity, 2 * offset < self.long[k])
            near.extend(zip(d[some].tolist(), k[some].tolist(), about[some].tolist(), strict=True))
            likely.clear()

        for c in self.classes:
            for at, item, offset in c.candidates(pairs, int(cuts[-1])):
                doc = np.searchsorted(cuts, at, "right") - 1
                likely.append((doc, item, begun[np.maximum(at - offset, cuts[doc])] - begun[cuts[doc]], offset))
                if sum(len(x[0]) for x in likely) > 4 * PAIRS:
                    bounded()
        if likely:
            bounded()
        held, flat = -1, ""
        for x, y, b in sorted(near):
            if best.get((x, y), (1,))[0] == 0:
                continue  # an unchanged copy that begins before this start; none nearer can follow
            if x != held:
                held, flat = x, plain(docs[x])
            if (got := self.verified(y, flat, b, similarity)) and got < best.get((x, y), (1 << 30, 0, 0)):
                best[x, y] = got
        for (d, k), got in best.items():
            out[d].append((k, *got))
        for d, t in enumerate(docs) if self.short else ():
            t = plain(t)
            for k in self.short:
                item = self.texts[k][1]
                if got := exactly(item, t, int(len(item) * (1 - similarity) + 1e-9)):
                    out[d].append((k, *got))
        return [sorted(x) for x in out]


@functools.lru_cache(2)
def index_of(items: tuple[tuple[int, str], ...]) -> Index:
    """The process's index of a block of items."""
    return Index(items)


def blocks_of(benchmark: DataFrame, text: str, id_col: str, size: int = BLOCK_BYTES) -> list[tuple[tuple[int, str], ...]]:
    """The items in blocks of about `size` bytes of text, read one by one; a benchmark is a bounded table of questions, read as such."""
    out, block, held = [], [], 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("t <> ''").orderBy("i", "t").toLocalIterator():
        block.append((r.i, r.t))
        held += len(r.t)
        if held >= size:
            out.append(tuple(block))
            block, held = [], 0
    return [*out, tuple(block)] if block else out


def benchmark_matches(df: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, distance, start, end (code points, end exclusive): the best place of each item in each text that holds it."""
    spark = small_batches(df.sparkSession)
    src = df.select(df[id_col].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))
    ddl, out = "doc_id long, item_id long, distance long, start long, end long", None
    for items in blocks_of(benchmark, item_text, item_id):

        def run(batches, items=items):
            index = index_of(items)
            for b in batches:
                rows = [(d, index.texts[k][0], *rest) for d, found in zip(b.column("doc_id").to_pylist(), index.matches(texts(b), similarity), strict=True) for k, *rest in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], names=["doc_id", "item_id", "distance", "start", "end"])

        part = src.mapInArrow(tidy(run), ddl)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], ddl) if out is None else out


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """df's rows, with all their columns, whose text holds no benchmark item."""
    small_batches(df.sparkSession)
    for items in blocks_of(benchmark, "text", "item_id"):

        def run(batches, items=items):
            index = index_of(items)
            for b in batches:
                yield b.filter(pa.array([not found for found in index.matches(texts(b, text), similarity)], pa.bool_()))

        df = df.mapInArrow(tidy(run), df.schema)
    return df
