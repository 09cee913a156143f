"""SentencePiece encoding and decoding by suffix-array matching, for BPE models with byte fallback.

A batch's texts are cut into chunks that no piece crosses (white space and the word after it). The chunks not met before
are laid end to end and their suffixes sorted, to the depth of the longest piece, by prefix doubling. Every piece of the
vocabulary is then looked up by binary search, which gives the range of its occurrences; these edges are sorted by the
position where they end, and relaxed from left to right: an edge is taken if the pieces' merge order would keep it apart
from the piece that ends where it begins. BPE's result is unique and each of its prefixes' result is its own prefix, so
each position has one such edge at most and the last one's path is the encoding.

Whether two pieces stay apart is found by undoing the merges on both sides of their border, latest first, and seeing
whether a merge across it would have come earlier. Pieces of white-space marks alone may have equal scores, so that
where they stand decides which merge comes first; their scores are below all others', so that what they do concerns
themselves only, and which two of them stay apart is a small table, made from the merges of every two. Characters
outside the vocabulary become bytes.

The model's normaliser must be the identity with a dummy prefix (as in piece_bpe_32k.model), and no two pieces but
those of marks alone may have one score; others are refused.
Defined results: null and empty texts have no ids; equal texts have equal ids, and repeated rows a row each; a text of any
length is encoded whole; an empty table gives no rows; decoding gives the text back, but for U+2581 in it, which the
model itself reads as a space. Other columns stay as they are, but for those named as an added one, which it replaces;
`piece_table` reads the id and the text only.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, small_batches, texts, tidy
from .token_files import Table, gathered

SPACE = "▁"
KNOWN_CHUNKS, BATCH_CHARS, MATCH_CHARS, CACHE_BITS = 600_000, 2 << 20, 400_000, 20
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Model:
    """A BPE model's pieces, ranks and merges as arrays. Piece numbers beyond the vocabulary stand for characters that become bytes."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, train = spec.normalizer_spec, spec.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation are supported")
        self.size = len(spec.pieces)
        self.text = [p.piece for p in spec.pieces]
        self.byte_of = {i: int(p.piece[3:5], 16) for i, p in enumerate(spec.pieces) if p.type == 6}
        self.id_of_byte = np.zeros(256, np.uint32)
        for i, b in self.byte_of.items():
            self.id_of_byte[b] = i
        self.of = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        self.score = np.array([p.score for p in spec.pieces] + [0.0])
        crossing = [p for p in self.of if SPACE in p[1:] and p.strip(SPACE)]
        if crossing:
            raise ValueError(f"pieces hold white space within: {crossing[:3]}")
        marks = {i: len(p) for p, i in self.of.items() if not p.strip(SPACE)}
        others = sorted(self.score[i] for i in self.of.values() if i not in marks)
        if any(x == y for x, y in zip(others, others[1:], strict=False)):
            raise ValueError("two pieces that aren't of white space alone have one score")
        if others and any(self.score[i] >= others[0] for i, n in marks.items() if n > 1):
            raise ValueError("a piece of white space alone has no lower score than the others")
        order = sorted(self.of.values(), key=lambda i: (-self.score[i], i))
        chars = sorted({c for p in self.of for c in p})
        if missing := [c for c in chars if c not in self.of]:
            raise ValueError(f"characters of pieces that are no pieces: {missing[:3]}")
        self.code = {c: k for k, c in enumerate(chars, 2)}  # 0: nothing, 1: a character outside the vocabulary
        self.code_table = np.ones(0x110000, np.uint16)
        self.code_table[[ord(c) for c in chars]] = np.arange(2, 2 + len(chars), dtype=np.uint16)
        self.unknown = self.size  # the piece number of any such character
        self.rank = np.full(self.size + 1, -1, np.int64)  # single characters come before all merges
        merges = [i for i in order if len(self.text[i]) > 1]
        self.rank[merges] = np.arange(1, len(merges) + 1)
        # every way to make a piece of two, and the last merge that makes it
        pairs = [(self.of[p[:k]], self.of[p[k:]], i) for p, i in self.of.items() for k in range(1, len(p)) if p[:k] in self.of and p[k:] in self.of]
        keys = np.array([a * (self.size + 1) + b for a, b, _ in pairs], np.int64)
        by = np.argsort(keys)
        self.pair_keys, self.pair_piece = keys[by], np.array([i for *_, i in pairs], np.int64)[by]
        self.left, self.right = np.arange(self.size + 1), np.arange(self.size + 1)
        for p, i in self.of.items():
            if len(p) > 1:
                parts = self.merged(p)[1]
                if parts:
                    self.left[i], self.right[i] = parts
        self.alone = np.ones(self.size + 1, bool)  # whether the piece's own text is encoded as this one piece
        for p, i in self.of.items():
            self.alone[i] = self.merged(p)[0] == [i]
        lengths = np.array([len(p) for p in self.of], np.int64)
        if lengths.max() > 16:
            raise ValueError("a piece is longer than 16 characters")
        self.n_marks = np.zeros(self.size + 1, np.int64)  # how many marks a piece of marks alone has
        self.marks_apart = np.zeros((17, 17), bool)
        for i, n in marks.items():
            self.n_marks[i] = n
            for j, m in marks.items():
                self.marks_apart[n, m] = self.merged(SPACE * (n + m))[0] == [i, j]
        self.ids = np.array(list(self.of.values()), np.int64)
        self.codes = np.zeros((len(self.of), 16), np.uint64)
        for k, p in enumerate(self.of):
            self.codes[k, : len(p)] = [self.code[c] for c in p]
        self.lengths = lengths
        use = self.alone[self.ids]
        self.ids, self.codes, self.lengths = self.ids[use], self.codes[use], self.lengths[use]
        self.cache_key, self.cache_ok = np.full(1 << CACHE_BITS, -1, np.int64), np.zeros(1 << CACHE_BITS, bool)
        of_id = {i: p for p, i in self.of.items()}
        raw = [bytes([self.byte_of[i]]) if i in self.byte_of else of_id[i].replace(SPACE, " ").encode() if i in of_id else b"" for i in range(self.size)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_start = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)

    def merged(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """A text's pieces by merging the best pair again and again, the leftmost of equals; and the two parts of the last merge."""
        syms: list[str | None] = list(text)
        left, right = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < len(text) and (p := syms[i] + syms[j]) in self.of:
                heapq.heappush(heap, (-self.score[self.of[p]], i, p))

        for i in range(len(text) - 1):
            offer(i)
        parts = None
        while heap:
            _, i, p = heapq.heappop(heap)
            if syms[i] is None or (j := right[i]) >= len(text) or syms[i] + syms[j] != p:
                continue
            parts = (self.of.get(syms[i], self.unknown), self.of.get(syms[j], self.unknown))
            syms[i], syms[j] = p, None
            right[i] = right[j]
            if right[i] < len(text):
                left[right[i]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [self.of.get(s, self.unknown) for s in syms if s is not None], parts

    def _joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that a and b make, or a very large number."""
        key = a * (self.size + 1) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.rank[self.pair_piece[at]], 1 << 40)

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b, side by side, stay as they are: no merge across their border comes before those that made them.

        Goes back in time from the finished pieces, undoing the later merge of the two each time. A pair that stood side
        by side up to the turn of some rank would have been merged if their own merge ranks before it."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        n, m = self.n_marks[a], self.n_marks[b]
        ok = self.marks_apart[n, m] | (n == 0) | (m == 0)
        todo = np.flatnonzero((n == 0) | (m == 0))
        a, b = a[todo], b[todo]
        until = np.full(len(todo), 1 << 39)  # the pair stood side by side until this rank's turn
        while len(todo):
            clash = self._joins(a, b) < until
            ok[todo[clash]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~clash & ((ra > 0) | (rb > 0))
            todo, a, b, ra, rb = todo[go], a[go], b[go], ra[go], rb[go]
            undo_a = ra > rb  # of equal merges the left one came first, so the right one is undone first
            # before b's merge, one across the border of equal rank would have come first, as it lies to the left
            until = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_apart() through a direct-mapped cache."""
        key = a * (self.size + 1) + b
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        ok, hit = self.cache_ok[slot], self.cache_key[slot] == key
        if not hit.all():
            new, back = np.unique(key[~hit], return_inverse=True)
            got = self._apart(new // (self.size + 1), new % (self.size + 1))
            ok[~hit] = got[back]
            self.cache_key[slot[~hit]], self.cache_ok[slot[~hit]] = key[~hit], got[back]
            # of keys that share a slot the last one written stays, in both arrays: numpy assigns in order
        return ok

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, index of the piece) of every occurrence of every piece in the codes, from the suffix array."""
        n = len(codes)
        c = np.concatenate([codes, np.zeros(16, np.uint16)]).astype(np.uint64)
        w = c[:-3] << np.uint64(48) | c[1:-2] << np.uint64(32) | c[2:-1] << np.uint64(16) | c[3:]
        u4, r4 = np.unique(w, return_inverse=True)
        m4 = np.int64(len(u4) + 1)
        k8 = r4[: n + 8] * m4 + r4[4 : n + 12] if len(r4) >= n + 12 else r4[: n + 8] * m4 + np.concatenate([r4[4:], np.zeros(n + 12 - len(r4), np.int64)])[: n + 8]
        u8, r8 = np.unique(k8, return_inverse=True)
        m8 = np.int64(len(u8) + 1)
        k16 = r8[:n] * m8 + r8[8 : n + 8]
        suffixes = np.argsort(k16)
        s4, s8, s16 = r4[suffixes], k8[suffixes], k16[suffixes]

        def packed(p: np.ndarray, top: bool, length: np.ndarray) -> np.ndarray:
            """Four codes as one number; beyond the length filled with the least or, for the range's end, the greatest code."""
            p = np.where(np.arange(4) < length[:, None], p, np.uint64(0xFFFF if top else 0))
            return p[:, 0] << np.uint64(48) | p[:, 1] << np.uint64(32) | p[:, 2] << np.uint64(16) | p[:, 3]

        def range4(p, length):
            return np.searchsorted(u4, packed(p, False, length), "left"), np.searchsorted(u4, packed(p, True, length), "right")

        def range8(p, length):
            """The range of k8 values that begin with the codes."""
            lo, hi = range4(p[:, :4], np.minimum(length, 4))
            lo2, hi2 = range4(p[:, 4:8], np.maximum(length - 4, 0))
            long = length > 4
            there = hi > lo
            return np.where(long, np.where(there, lo * m4 + lo2, 0), lo * m4), np.where(long, np.where(there, lo * m4 + hi2, 0), hi * m4)

        p, size = self.codes, self.lengths
        lo, hi = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        for part, keys in ((size <= 4, s4), ((size > 4) & (size <= 8), s8), (size > 8, s16)):
            at = np.flatnonzero(part)
            if keys is s4:
                a, b = range4(p[at, :4], size[at])
            elif keys is s8:
                a, b = range8(p[at, :8], size[at])
            else:
                a, b = range8(p[at, :8], np.full(len(at), 8))
                first, there = np.searchsorted(u8, a, "left"), b > a
                there &= u8[np.minimum(first, len(u8) - 1)] < b
                a2, b2 = range8(p[at, 8:], size[at] - 8)
                a, b = first * m8 + np.searchsorted(u8, a2, "left"), first * m8 + np.searchsorted(u8, b2, "left")
                a, b = np.where(there, a, 0), np.where(there, b, 0)
            lo[at], hi[at] = np.searchsorted(keys, a, "left"), np.searchsorted(keys, b, "left")
        count = np.maximum(hi - lo, 0)
        ends = np.concatenate([[0], np.cumsum(count)])
        places = suffixes[np.repeat(lo - ends[:-1], count) + np.arange(ends[-1])]
        return places, np.repeat(np.arange(len(p)), count)

    def matched(self, items: list[str]) -> list[np.ndarray]:
        """The piece numbers of chunks, by matching and relaxing."""
        points = np.frombuffer("\0".join(items).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, items), np.int64, len(items))
        start = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)
        codes = self.code_table[points]
        border = start[1:] - 1
        codes[border] = 0
        n = len(codes)
        at, piece = self.occurrences(codes)
        strange = np.flatnonzero(codes == 1)
        begin = np.concatenate([at, strange])
        number = np.concatenate([self.ids[piece], np.full(len(strange), self.unknown)])
        end = np.concatenate([at + self.lengths[piece], strange + 1])
        # positions count from their chunk's start, so that all chunks are relaxed together, end by end
        base = np.repeat(start, np.append(size[:-1] + 1, size[-1]))
        local = end - base[begin]
        order = np.lexsort((end, local))
        begin, number, end, local = begin[order], number[order], end[order], local[order]
        state, back = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)  # the piece that ends at a position, and where it begins
        fresh = np.zeros(n + 1, bool)
        fresh[start] = True
        # a chunk's end is the next one's border; its state is kept at that border's position
        cuts = np.flatnonzero(np.diff(local, prepend=-1, append=-1)) if len(local) else np.zeros(0, int)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            b, p, e = begin[lo:hi], number[lo:hi], end[lo:hi]
            first = fresh[b]
            prev = state[b]
            ok = first.copy()
            check = np.flatnonzero(~first & (prev >= 0))
            ok[check] = self.apart(prev[check], p[check])
            state[e[ok]], back[e[ok]] = p[ok], b[ok]
        # walk back from every chunk's end at once
        out, owner, at = [], [], start + size
        who = np.flatnonzero(size > 0)
        at = at[who]
        while len(who):
            out.append(state[at]), owner.append(who)
            at = back[at]
            on = at > start[who]
            if (at < 0).any():
                raise AssertionError("a chunk has no path")
            at, who = at[on], who[on]
        if not out:
            return [np.zeros(0, np.int64)] * len(items)
        number, owner = np.concatenate(out)[::-1], np.concatenate(owner)[::-1]
        by = np.argsort(owner, kind="stable")
        cuts = np.cumsum(np.bincount(owner, minlength=len(items)))[:-1]
        return np.split(number[by], cuts)

    def encoded(self, items: list[str]) -> list[bytes]:
        """The ids of chunks as little-endian 32-bit numbers."""
        out: list[bytes] = []
        for k, ids in enumerate(ids for part in chunks(items, MATCH_CHARS) for ids in self.matched(part)):
            if self.unknown in ids:
                at, parts = 0, []
                for i in ids.tolist():
                    if i == self.unknown:
                        parts += self.id_of_byte[list(items[k][at].encode("utf-8", "surrogatepass"))].tolist()
                        at += 1
                    else:
                        parts.append(i)
                        at += len(self.text[i])
                ids = np.array(parts)
            out.append(ids.astype("<u4").tobytes())
        return out


class Encoder:
    def __init__(self, path: str):
        self.model, self.known = Model(path), Table(np.dtype("<u4"))

    def encode(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and where each text's begin and end."""
        odd = [not t or "  " in t or t[0] == " " or t[-1] == " " or SPACE in t for t in docs]
        lists = pc.split_pattern(pa.array(["" if o else t for t, o in zip(docs, odd, strict=True)], pa.large_string()), " ")
        flat = pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), lists.flatten(), pa.scalar("", pa.large_string()))
        extra = [[m[0] for m in _CHUNK.finditer(SPACE + t.replace(" ", SPACE))] if o and t else [] for t, o in zip(docs, odd, strict=True)]
        n = len(flat)
        coded = pa.concat_arrays([flat, pa.array([c for x in extra for c in x], pa.large_string())]).cast(pa.large_string()).dictionary_encode()
        words = coded.dictionary.cast(pa.string())
        table, at = self.known, self.known.places(words)
        if (new := at < 0).any():
            missing = words.filter(pa.array(new)).to_pylist()
            at[new] = len(table.strings) + np.arange(len(missing))
            table = table.grown(missing, self.model.encoded(missing))
            if len(table.strings) <= KNOWN_CHUNKS:
                self.known = table
        codes = coded.indices.to_numpy()
        # an odd text's place in the lists is one lone mark, whose chunks are those found above
        rows, ends = at[codes[:n]], lists.offsets.to_numpy().astype(np.int64)
        if any(odd):
            own, parts, k = at[codes[n:]], [], 0
            cuts = [0]
            for i, (o, x) in enumerate(zip(odd, extra, strict=True)):
                part = own[k : k + len(x)] if o else rows[ends[i] : ends[i + 1]]
                k += len(x)
                parts.append(part)
                cuts.append(cuts[-1] + len(part))
            rows, ends = np.concatenate(parts) if parts else rows, np.array(cuts)
        ids, cut = gathered(table.ids, table.start, rows)
        return ids, cut[ends]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of id sequences that lie one after another."""
        m = self.model
        raw, cut = gathered(m.raw, m.raw_start, ids.astype(np.int64))
        data, at = raw.tobytes(), cut[ends].tolist()
        out = [data[at[i] : at[i + 1]].decode("utf-8", "replace") for i in range(len(ends) - 1)]
        return [t[1:] if t[:1] == " " else t for t in out]


@functools.lru_cache(2)
def encoder_for(path: str) -> Encoder:
    """The process's encoder: what one task has learned serves the worker's next."""
    return Encoder(path)


def encode_pieces(df: DataFrame, model: str, text: str = "text", out: str = "ids", check: str | None = None) -> DataFrame:
    """df with a column of ids (array<int>) for each row's text, in place of any column of that name.

    check: adds a column that says whether decoding the ids gives the text back."""
    small_batches(df.sparkSession)
    added = {out: F.array().cast("array<int>")} | ({check: F.lit(False)} if check else {})
    df = df.select(*(c for c in df.columns if c not in added), *(c.alias(n) for n, c in added.items()))
    names, kept = df.columns, len(df.columns) - len(added)

    def run(batches):
        e = encoder_for(model)
        for b in batches:
            at = 0
            for part in chunks(texts(b, text), BATCH_CHARS):
                ids, ends = e.encode(part)
                cols = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))]
                if check:
                    cols.append(pa.array([t.replace(SPACE, " ") == u for t, u in zip(part, e.decode(ids, ends), strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(at, len(part)) for k in range(kept)), *cols], names=names)
                at += len(part)

    return df.mapInArrow(tidy(run), df.schema)


def decode_pieces(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with a column of the text that each row's ids stand for, in place of any column of that name."""
    df = df.select(*(c for c in df.columns if c != out), F.lit(None).cast("string").alias(out))
    names = df.columns

    def run(batches):
        e = encoder_for(model)
        for b in batches:
            col = b.column(ids)
            lists = [np.array(x or [], np.int64) for x in col.to_pylist()] if col.null_count or col.offset else None
            flat = np.concatenate([np.zeros(0, np.int64), *lists]) if lists is not None else col.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64) if lists is not None else col.offsets.to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), pa.array(e.decode(flat, ends - ends[0]), pa.string())], names=names)

    return df.mapInArrow(tidy(run), df.schema)


def piece_table(df: DataFrame, model: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit numbers), decoded_sha256, round_trip."""
    small_batches(df.sparkSession)

    def run(batches):
        e = encoder_for(model)
        for b in batches:
            at = 0
            for part in chunks(texts(b), BATCH_CHARS):
                ids, ends = e.encode(part)
                back, raw, cut = e.decode(ids, ends), ids.tobytes(), (ends * 4).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(at, len(part)), pa.array(np.diff(ends)), pa.array([zlib.crc32(raw[i:j]) for i, j in zip(cut, cut[1:], strict=False)], pa.int64()),
                        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]), pa.array([t.replace(SPACE, " ") == u for t, u in zip(part, back, strict=True)], pa.bool_()),
                    ],
                    names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"],
                )
                at += len(part)

    src = df.select(df[id_col].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))
    return src.mapInArrow(tidy(run), "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
