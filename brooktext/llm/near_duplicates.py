"""MinHash near-duplicates with sequential Bayesian verification.

A text's set is its distinct runs of `n_words` words (A-Z lower-cased, words parted by ASCII white space), as 64-bit
hashes; with fewer words, the whole sequence is one run; without words the set is empty and linked with nothing.
Two documents are linked if their sets' Jaccard similarity is `num`/`den` or more; groups are connected components.

1. Equal sets are one class; its least id stands for it, and only classes go on.
2. `BANDS` x `ROWS` MinHash bands put classes into buckets. With 32 x 4, a pair at 0.8 shares none with a probability
   of 5e-8.
3. Each bucket's classes are paired with its least (a star, linear in its size).
4. Sequential verification compares the signatures in batches of `BATCH` hashes and drops a pair as soon as the posterior
   probability of a similarity at the threshold, under a uniform prior, is below `MISS`. Survivors' components are the
   first groups.
5. A bucket that still holds several groups may hide survivors between members other than its least. These are compared
   in blocks of about `BLOCK` by their signatures, and of the survivors as many are kept as connect the groups. No
   surviving pair of any bucket lies outside a group then.
6. A group's texts are dealt once, whatever the number of buckets that its members share, and its full sets compared: links come from there only.
7. Groups beyond `GROUP` aren't gathered: their kept pairs are verified on full sets, and members that this leaves in different
   components are compared in blocks again, by signatures first, on full sets where a partner survives.

No step lists all pairs of a group, and blocks and gathered groups are bounded: stars and joins grow with the rows. What step 5 compares grows with
the square of a bucket's members outside its least's group, 512 bytes each, and step 7 with that of a large group's members that its stars
don't link. Defined results: texts of any length are taken whole; a null text is empty; a row with a null id has a null component and is kept; rows that
share an id count as one document; extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, discard, persist, small_batches, texts, tidy

BANDS, ROWS, BATCH, MISS, BLOCK, FEW = 32, 4, 16, 1e-7, 256, 8
GROUP = 2 * BLOCK, 1 << 20  # members and shingles of a group that is compared in one piece
HASHES = BANDS * ROWS
_MULTIPLIERS = np.random.default_rng(20_240_310).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits depend on all input bits (the finaliser of a published generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(docs: list[str], n_words: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(docs, pa.large_string())))
    coded = lists.flatten().dictionary_encode()
    of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    empty = pc.index_in(pa.scalar("", pa.large_string()), value_set=coded.dictionary).as_py()
    codes, offsets = coded.indices.to_numpy(), lists.offsets.to_numpy()
    h, out = of_word[codes], []
    real = codes != empty if empty is not None else np.ones(len(codes), bool)
    for i in range(len(docs)):
        w = h[offsets[i] : offsets[i + 1]]
        if empty is not None:
            w = w[real[offsets[i] : offsets[i + 1]]]
        k = min(n_words, len(w))
        if not k:
            out.append(np.zeros(0, np.uint64))
            continue
        m = len(w) - k + 1
        s = np.full(m, k, np.uint64)
        for j in range(k):
            s = _mixed(s * _LANE + w[j : j + m])
        out.append(np.unique(s))
    return out


def signatures(sets: list[np.ndarray]) -> list[bytes]:
    """HASHES 32-bit minima of each set; empty sets have none."""
    full = [s for s in sets if len(s)]
    if not full:
        return [b""] * len(sets)
    sig = np.empty((len(full), HASHES), np.uint32)
    lo = 0
    while lo < len(full):
        hi, n = lo, 0
        while hi < len(full) and (hi == lo or n + len(full[hi]) <= 1 << 17):
            n, hi = n + len(full[hi]), hi + 1
        u = np.concatenate(full[lo:hi])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in full[lo : hi - 1]])]).astype(np.intp)
        buf = np.empty_like(u)
        for k in range(HASHES):
            np.multiply(u, _MULTIPLIERS[k], out=buf)
            sig[lo:hi, k] = np.minimum.reduceat(buf, starts) >> np.uint64(32)
        lo = hi
    got = iter(sig)
    return [next(got).tobytes() if len(s) else b"" for s in sets]


@functools.lru_cache(8)
def least_agreement(num: int, den: int, miss: float = MISS) -> tuple[int, ...]:
    """For each number of compared hashes, a multiple of BATCH, the fewest that must agree for the pair to go on.

    With m of n agreeing and a uniform prior, the similarity's posterior is Beta(m + 1, n - m + 1); P(similarity >= t)
    is then the probability of at most m successes in n + 1 tries at t."""
    t, out = num / den, []
    for n in range(BATCH, HASHES + 1, BATCH):
        p, total, m = (1 - t) ** (n + 1), 0.0, 0
        while True:
            total += p
            if total >= miss:
                break
            p *= (n + 1 - m) / (m + 1) * t / (1 - t)
            m += 1
        out.append(m)
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of signatures (rows of a and b), those that no batch prunes, and their agreement."""
    alive, agreed = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_agreement(num, den)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        agreed = agreed + (a[alive, part] == b[alive, part]).sum(axis=1)
        on = agreed >= least
        alive, agreed = alive[on], agreed[on]
    return alive, agreed


def _sigs(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, HASHES)


def _linked(x: bytes, y: bytes, num: int, den: int) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    c = np.concatenate([a, b])
    c.sort(kind="stable")
    both = int((c[1:] == c[:-1]).sum())
    return den * both >= num * (len(a) + len(b) - both)


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """a, b and a column of each of the two, x and y. Of the table only the rows of pairs' ends are dealt; there are far fewer b than a, as those are stars' centers."""

    def of(end: str, name: str) -> DataFrame:
        return table.select(F.col("id").alias(end), F.col(column).alias(name)).join(pairs.select(end).distinct(), end, "left_semi")

    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y")


def _probable(pairs: DataFrame, sigs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sequential verification of their signatures doesn't prune."""

    def run(batches):
        for b in batches:
            alive, _ = survivors(_sigs(b.column("x")), _sigs(b.column("y")), num, den) if b.num_rows else (np.zeros(0, int), None)
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(alive)), b.column("b").take(pa.array(alive))], names=["a", "b"])

    return _with_both(pairs, sigs, "sig").mapInArrow(tidy(run), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, linked: the pairs compared on their full sets."""

    def run(batches):
        for b in batches:
            ok = [_linked(x, y, num, den) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    return _with_both(pairs, sets, "hashes").mapInArrow(tidy(run), "a long, b long, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """id and label (the least id that is reachable) of every end of the edges (a, b), by alternating stars.

    Each step is a grouped minimum and a join, written out; a vertex of very many edges is summed up before the shuffle
    and split in the join."""
    e = persist(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    digest = F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    told = e.agg(*digest).first()
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = persist(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc")
        large = persist(both.where("b > a").join(first, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "cc")
        least = persist(large.groupBy("a").agg(F.min("b").alias("m")), "cc")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        new = persist(small.distinct(), "cc")
        before, told = told, new.agg(*digest).first()
        same = told == before
        discard(e, first, large, least)
        e = new
        if same:
            break
    out = persist(new.select(F.col("a").alias("id"), F.col("b").alias("label")).union(new.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()), "cc")
    discard(new)
    return out


def joining_links(side: np.ndarray, ids: np.ndarray, label: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that join the components of a block pair's members.

    side: 0 is compared with all, 1 with side 2 only. Members already of one component, by label or by a link found
    here, aren't compared. A few members are compared without signatures."""
    sig = np.frombuffer(b"".join(signatures(sets)), np.uint32).reshape(-1, HASHES) if len(sets) > FEW else None
    size = np.array([len(s) for s in sets])
    start = np.concatenate([[0], np.cumsum(size)])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(codes.max() + 1, bool)
    root, out = label.copy(), []
    for i in np.flatnonzero(side < 2).tolist():
        ok = (root != root[i]) & (np.minimum(size, size[i]) * den >= num * np.maximum(size, size[i]))
        at = np.flatnonzero(ok & ((side == 2) if side[i] else (np.arange(len(ids)) > i)))
        if len(at) and sig is not None:
            at = at[survivors(np.broadcast_to(sig[i], (len(at), HASHES)), sig[at], num, den)[0]]
        if not len(at):
            continue
        own = codes[start[i] : start[i + 1]]
        mark[own] = True
        ends = np.cumsum(size[at])
        both = np.add.reduceat(mark[codes[np.repeat(start[at] - ends + size[at], size[at]) + np.arange(ends[-1])]], ends - size[at], dtype=np.int64)
        mark[own] = False
        for j in at[den * both >= num * (size[i] + size[at] - both)].tolist():
            if root[j] != root[i]:
                out.append((max(int(ids[i]), int(ids[j])), min(int(ids[i]), int(ids[j]))))
                root[root == root[j]] = root[i]
    return out


def hopeful(side: np.ndarray, label: np.ndarray, size: np.ndarray, sig: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which members of a block pair have a partner of another label that sequential verification doesn't prune.

    Two members that are both marked already aren't compared: each goes on anyway."""
    out = np.zeros(len(side), bool)
    for i in np.flatnonzero(side < 2).tolist():
        ok = (label != label[i]) & (np.minimum(size, size[i]) * den >= num * np.maximum(size, size[i])) & ~(out & out[i])
        at = np.flatnonzero(ok & ((side == 2) if side[i] else (np.arange(len(side)) > i)))
        if len(at):
            at = at[survivors(np.broadcast_to(sig[i], (len(at), HASHES)), sig[at], num, den)[0]]
            out[at] = True
            out[i] |= len(at) > 0
    return out


def bridges(side: np.ndarray, ids: np.ndarray, label: np.ndarray, size: np.ndarray, sig: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Of a block pair's members, pairs that sequential verification doesn't prune: enough of them that the ends of every such pair are connected."""
    root, out = label.copy(), []
    for i in np.flatnonzero(side < 2).tolist():
        ok = (root != root[i]) & (np.minimum(size, size[i]) * den >= num * np.maximum(size, size[i]))
        at = np.flatnonzero(ok & ((side == 2) if side[i] else (np.arange(len(side)) > i)))
        for j in at[survivors(np.broadcast_to(sig[i], (len(at), HASHES)), sig[at], num, den)[0]].tolist() if len(at) else ():
            if root[j] != root[i]:
                out.append((max(int(ids[i]), int(ids[j])), min(int(ids[i]), int(ids[j]))))
                root[root == root[j]] = root[i]
    return out


def _in_block_pairs(rows: DataFrame, columns: tuple[str, ...], act, schema: str) -> DataFrame:
    """act(a block pair's key, its members' columns) -> output rows, over every block pair of two members or more. Only one block pair is held at a time."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int32() if x.endswith(" int") else pa.int64() for x in schema.split(", ")]

    def run(batches):
        key, group = None, []
        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in ("g1", "g2", *columns)), strict=True):
                if row[:2] != key:
                    out += act(key, zip(*group, strict=True)) if len(group) > 1 else []
                    key, group = row[:2], []
                group.append(row[2:])
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(types)], names=names)
        if len(group) > 1:
            out = act(key, zip(*group, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(types)], names=names)

    return rows.select("g1", "g2", *columns).repartition("g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(tidy(run), schema)


def _bridges(met: DataFrame, sigs: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: the bridges of every block pair. sigs: id, n, sig."""

    def act(key, columns):
        side, ids, label, size, sig = columns
        return bridges(np.array(side), np.array(ids), np.array(label), np.array(size), np.frombuffer(b"".join(sig), np.uint32).reshape(-1, HASHES), num, den)

    return _in_block_pairs(met.join(sigs, "id"), ("side", "id", "label", "n", "sig"), act, "a long, b long")


def _promising(met: DataFrame, sigs: DataFrame, num: int, den: int) -> DataFrame:
    """met's members that are hopeful in their block pair, by size and signature alone. sigs: id, n, sig."""

    def act(key, columns):
        side, ids, label, size, sig = columns
        on = hopeful(np.array(side), np.array(label), np.array(size), np.frombuffer(b"".join(sig), np.uint32).reshape(-1, HASHES), num, den)
        return [(*key, side[k], ids[k], label[k]) for k in np.flatnonzero(on).tolist()]

    return _in_block_pairs(met.join(sigs, "id"), ("side", "id", "label", "n", "sig"), act, "g1 long, g2 long, side int, id long, label long")


def _within(met: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: the joining links of every block pair, on the full sets."""

    def act(key, columns):
        side, ids, label, hashes = columns
        return joining_links(np.array(side), np.array(ids), np.array(label), [np.frombuffer(s, np.uint64) for s in hashes], num, den)

    return _in_block_pairs(met.join(sets, "id"), ("side", "id", "label", "hashes"), act, "a long, b long")


def _block_pairs(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The members of buckets that hold several labels, in pairs of blocks of about BLOCK members.

    A label with half a block of a bucket or more has blocks of its own, which needn't meet each other; the bucket's
    other members share blocks by label. Every pair of different labels meets in one block pair. Buckets of the same members, as near
    copies share several bands, count once: they are told by their members' number and hash sums. Also returns the tables written on the way."""
    used: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        used.append(persist(df, f"near-{name}"))
        return used[-1]

    m = kept(members.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label")), "members")
    whole = F.count("*").alias("c"), *(F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(38,0)")).alias(f"d{k}") for k in range(2))
    several = m.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), *whole).where("lo <> hi")
    mixed = kept(several.groupBy("c", "d0", "d1").agg(F.min("key").alias("key")).select("key"), "mixed")
    m = kept(m.join(mixed, "key"), "members")
    of_label = kept(m.groupBy("key", "label").agg(F.count("*").alias("c")), "sizes")
    rest = kept(of_label.groupBy("key").agg(F.sum(F.when(F.col("c") * 2 < BLOCK, F.col("c")).otherwise(0)).alias("rest")), "sizes")
    m = kept(m.join(of_label, ["key", "label"]), "members").join(rest, "key")
    own = F.col("c") * 2 >= BLOCK
    slot = F.when(own, F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / BLOCK))).otherwise(F.pmod(F.xxhash64("label"), F.greatest(F.ceil(F.col("rest") / BLOCK), F.lit(1))))
    whose = F.when(own, F.col("label"))
    m = kept(m.select("key", "id", "label", whose.alias("whose"), F.xxhash64("key", F.coalesce(whose, F.lit(-1)), own, slot).alias("block")), "members")
    blocks = kept(m.select("key", "block", "whose").distinct(), "blocks")
    other = blocks.select("key", F.col("block").alias("block2"), F.col("whose").alias("whose2"))
    pairs = blocks.join(other, "key").where("block <= block2 and (whose is null or whose2 is null or whose <> whose2)")
    first = pairs.select(F.col("block").alias("g1"), F.col("block2").alias("g2"), "block", F.when(F.col("block") == F.col("block2"), 0).otherwise(1).alias("side"))
    second = pairs.where("block < block2").select(F.col("block").alias("g1"), F.col("block2").alias("g2"), F.col("block2").alias("block"), F.lit(2).alias("side"))
    met = m.select("block", "id", "label").join(kept(first.union(second), "blocks"), "block").select("g1", "g2", "side", "id", "label")
    return kept(met, "met"), used


def _described(src: DataFrame, n_words: int) -> DataFrame:
    """doc_id, the set's size, its 128-bit digest and its signature. An empty set's digest is the row's own."""
    import xxhash

    def run(batches):
        for b in batches:
            ids, at = b.column("doc_id").to_pylist(), 0
            for part in chunks(texts(b), 4 << 20):
                sets = shingle_sets(part, n_words)
                digests = [divmod(xxhash.xxh3_128_intdigest(s.tobytes()) & (1 << 126) - 1, 1 << 63) if len(s) else (ids[at + k] or 0, -1) for k, s in enumerate(sets)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(at, len(part)), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(signatures(sets), pa.binary()),
                    ],
                    names=["doc_id", "n", "h1", "h2", "sig"],
                )
                at += len(part)

    return src.mapInArrow(tidy(run), "doc_id long, n long, h1 long, h2 long, sig binary")


def _full_sets(src: DataFrame, ids: DataFrame, n_words: int) -> DataFrame:
    """id and hashes (the sorted set) of the given documents."""

    def run(batches):
        last, seen = None, set()
        for b in batches:
            i, rows = b.column("id").to_pylist(), []
            t = texts(b)
            for k, (x, y) in enumerate(zip(i, t, strict=True)):  # repeated rows come one after another
                if x != last:
                    last, seen = x, set()
                if hash(y) not in seen:
                    seen.add(hash(y))
                    rows.append(k)
            at = 0
            for part in chunks([t[k] for k in rows], 4 << 20):
                sets = shingle_sets(part, n_words)
                yield pa.RecordBatch.from_arrays([pa.array([i[k] for k in rows[at : at + len(part)]], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "hashes"])
                at += len(part)

    return src.withColumnRenamed("doc_id", "id").join(ids, "id").select("id", "text").mapInArrow(tidy(run), "id long, hashes binary")


def _of_groups(src: DataFrame, groups: DataFrame, n_words: int, num: int, den: int) -> DataFrame:
    """id and label of whole groups (id, g), by the links within each. A group's texts come to one task once and are compared there on their full sets."""

    def labels(group: dict[tuple[int, int], np.ndarray]) -> list[tuple[int, int]]:
        ids = np.array([i for i, _ in group], np.int64)
        label = ids.copy()
        for a, b in joining_links(np.zeros(len(ids), int), ids, ids, list(group.values()), num, den) if len(ids) > 1 else ():
            x, y = label[ids == a][0], label[ids == b][0]
            label[(label == x) | (label == y)] = min(x, y)
        return sorted(set(zip(ids.tolist(), label.tolist(), strict=True)))

    def run(batches):
        key, group = None, {}
        for b in batches:
            g, ids, t, out, at = b.column("g").to_pylist(), b.column("id").to_pylist(), texts(b), [], 0
            for part in chunks(t, 4 << 20):
                for s in shingle_sets(part, n_words):
                    if g[at] != key:
                        out += labels(group)
                        key, group = g[at], {}
                    if len(s):
                        group.setdefault((ids[at], hash(s.tobytes())), s)  # ids may repeat
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(2)], names=["id", "label"])
        out = labels(group)
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(2)], names=["id", "label"])

    rows = src.withColumnRenamed("doc_id", "id").join(groups, "id").select("g", "id", "text")
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(tidy(run), "id long, label long")


def near_duplicates(df: DataFrame, n_words: int = 5, num: int = 4, den: int = 5, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. Linked: den * |A & B| >= num * |A | B|."""
    small_batches(df.sparkSession)
    src = df.select(df[id_col].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))
    base = persist(_described(src, n_words), "near-base")
    reps = persist(base.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "near-reps")
    keys = F.array(*(F.xxhash64(F.lit(k), F.substring("sig", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)))
    bands = reps.select("id", F.explode(keys).alias("key"))
    buckets = persist(bands.groupBy("key").agg(F.min("id").alias("center"), F.count("*").alias("c")).where("c > 1").select("key", "center"), "near-buckets")
    members = persist(bands.join(buckets, "key"), "near-members")
    stars = persist(members.where("id <> center").select(F.col("id").alias("a"), F.col("center").alias("b")).distinct(), "near-stars")
    ids = persist(members.select("id").distinct(), "near-ids")
    sigs = persist(reps.select("id", "n", "sig").join(ids, "id", "left_semi"), "near-sigs")  # what shares a bucket with another
    probable = persist(_probable(stars, sigs, num, den), "near-probable")
    center = persist(probable.groupBy("a").agg(F.min("b").alias("b")), "near-centers")
    own = center.join(center.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").select(F.col("a").alias("id"), F.coalesce("c", "b").alias("label"))
    met, used = _block_pairs(members.where("id <> center").select("key", "id"), own)
    near = persist(probable.union(_bridges(met, sigs, num, den)), "near-pairs")
    discard(*used, probable, center)
    alike = components(near)
    whole = alike.join(sigs.select("id", "n"), "id").groupBy("label").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    groups = persist(alike.join(whole.select("label", (F.col("c") > GROUP[0]) | (F.col("n") > GROUP[1]) & (F.col("c") > 2)).toDF("label", "large"), "label").select("id", F.col("label").alias("g"), "large"), "near-groups")
    labels = persist(_of_groups(src, groups.where("not large").select("id", "g"), n_words, num, den), "near-labels")
    used = [reps, buckets, members, stars, ids, sigs, near, alike, groups, labels]
    large = groups.where("large").select("id", "g")
    if not large.isEmpty():
        sets = persist(_full_sets(src, large.select("id"), n_words), "near-sets")
        found = persist(_verified(near.join(large.select(F.col("id").alias("a")), "a", "left_semi"), sets, num, den).where("linked").select("a", "b"), "near-links")
        of_large = components(found)
        met, more = _block_pairs(large.select(F.col("g").alias("key"), "id"), of_large)
        hope = persist(_promising(met, sigs, num, den), "near-hope")
        within = persist(_within(hope, sets, num, den), "near-links")
        used += [sets, found, *more, hope, within, of_large]
        if not within.isEmpty():
            of_large = components(found.union(within))
            used.append(of_large)
        labels = labels.union(of_large)
    # several sets of one id, if ids repeat, are one document
    of_set = persist(reps.select("h1", "h2", "id").join(labels, "id", "left").select("h1", "h2", F.coalesce("label", "id").alias("label")), "near-classes")
    discard(*used)
    out = base.select("doc_id", "n", "h1", "h2").join(of_set, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    out.reads = (base, of_set)  # the tables that it reads, for callers that are done with it
    return out


def drop_near_duplicates(df: DataFrame, n_words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """df's rows, with all their columns, of one document of each group: that of the least doc_id. Null ids stay."""
    found = near_duplicates(df, n_words, num, den)
    gone = persist(found.where("not kept").select("doc_id").distinct(), "near-gone")
    discard(*found.reads)
    return df.join(gone, "doc_id", "left_anti").select(df.columns)
