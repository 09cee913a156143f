import random
import re

import numpy as np
import pytest

from brooktext.llm import near_duplicates as module
from brooktext.llm.near_duplicates import HASHES, components, drop_near_duplicates, hopeful, joining_links, least_agreement, near_duplicates, shingle_sets, signatures


def brute(rows, n):
    """doc_id -> (set size, least id of the component), comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        k = min(n, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for p, i in enumerate(ids):
        for j in ids[p + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    x, y = sorted((find(i), find(j)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def planted(seed):
    """Copies of a few texts with more and more words changed, so that similarities lie on both sides of the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    out = []
    for _ in range(6):
        base = [word() for _ in range(rng.randint(20, 120))]
        for k in range(25):
            new = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 9))):
                new[rng.randrange(len(new))] = word()
            out.append(" ".join(new).upper() if k % 7 == 0 else "\t".join(new))
    return [(i, t) for i, t in enumerate(rng.sample(out, len(out)))]


@pytest.mark.parametrize("n", [2, 5])
def test_like_brute_force(spark, docs, n):
    rows = planted(n) + [(1000 + r.doc_id, r.text) for r in docs.collect()]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n).collect()
    want = brute(rows, n)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_small_blocks_like_brute_force(spark, monkeypatch):
    """With blocks of four, most components have blocks of their own and most pairs of members meet across blocks."""
    monkeypatch.setattr(module, "BLOCK", 4)
    rows = planted(8)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 5)


def test_every_two_labels_of_a_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 8)
    label = {i: 0 if i < 40 else 100 if i < 50 else i for i in range(80)}  # two labels with blocks of their own, thirty without
    members = [(1, i) for i in label] + [(2, i) for i in range(30)]  # the second bucket holds one label only
    met, used = module._block_pairs(spark.createDataFrame(members, "key long, id long"), spark.createDataFrame(list(label.items()), "id long, label long"))
    groups, compared = {}, {}
    for r in met.collect():
        groups.setdefault((r.g1, r.g2), []).append((r.side, r.id))
    for g in groups.values():
        assert len(g) <= 5 * module.BLOCK
        for k, (s, i) in enumerate(g):
            for t, j in g[k + 1 :]:
                if {s, t} in ({0}, {1, 2}) and label[i] != label[j]:
                    compared[frozenset((i, j))] = compared.get(frozenset((i, j)), 0) + 1
    assert set(compared) == {frozenset((i, j)) for i in label for j in label if label[i] != label[j]} and set(compared.values()) == {1}
    own = [g for g in groups.values() if {label[i] for _, i in g} <= {0}]
    assert not any(len({s for s, _ in g}) == 2 for g in own)  # blocks of one label never meet each other
    module.discard(*used)


def test_buckets_of_the_same_members_meet_once(spark):
    members = [(k, i) for k in range(5) for i in (1, 2, 3)] + [(9, 2), (9, 3), (10, 2), (10, 4)]  # near copies share several bands
    met, used = module._block_pairs(spark.createDataFrame(members, "key long, id long"), spark.createDataFrame([(2, 1), (1, 1), (3, 3)], "id long, label long"))
    groups = {}
    for r in met.collect():
        groups.setdefault((r.g1, r.g2), set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [2, 3], [2, 4]]
    module.discard(*used)


def test_pairs_get_both_columns(spark):
    pairs, table = spark.createDataFrame([(2, 1), (3, 1)], "a long, b long"), spark.createDataFrame([(i, f"s{i}") for i in range(6)], "id long, sig string")
    out = module._with_both(pairs, table, "sig")
    assert sorted(map(tuple, out.collect())) == [(2, 1, "s2", "s1"), (3, 1, "s3", "s1")]


def test_hopeful_members_are_those_with_a_survivor(docs):
    rng = np.random.default_rng(9)
    base = [np.unique(rng.integers(0, 1 << 63, 150).astype(np.uint64)) for _ in range(5)]
    sets = [np.sort(np.concatenate([b[: 150 - k * 6], rng.integers(0, 1 << 63, k * 6).astype(np.uint64)])) for b in base for k in range(8)] + [base[0][:20]]
    size, sig = np.array([len(s) for s in sets]), np.frombuffer(b"".join(signatures(sets)), np.uint32).reshape(-1, HASHES)
    label = rng.integers(0, 12, len(sets))
    for side in (np.zeros(len(sets), int), rng.integers(1, 3, len(sets))):
        want = np.zeros(len(sets), bool)
        for i in range(len(sets)):
            for j in range(len(sets)):
                if label[i] != label[j] and {side[i], side[j]} in ({0}, {1, 2}) and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j]):
                    want[i] |= len(module.survivors(sig[i : i + 1], sig[j : j + 1], 4, 5)[0]) > 0
        assert (hopeful(side, label, size, sig, 4, 5) == want).all() and 5 < want.sum() < len(sets)


def test_a_group_is_dealt_once(spark, monkeypatch):
    """Near copies share many buckets; nothing of theirs is dealt for each of these."""
    rng, dealt, whole = random.Random(3), [], module._in_block_pairs
    base = [f"w{k}" for k in range(150)]
    rows = [(i, " ".join(rng.choice("xyz") + str(i) if rng.random() < 0.05 else w for w in base)) for i in range(120)]
    monkeypatch.setattr(module, "_in_block_pairs", lambda rows, *rest: dealt.append(rows.count()) or whole(rows, *rest))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    want = brute(rows, 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and 10 < len({c for _, c in want.values()})
    assert sum(dealt) <= 4 * len(rows)


@pytest.mark.parametrize("group", [(4, 1 << 20), (1 << 20, 200)])
def test_large_groups_like_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(module, "GROUP", group)
    monkeypatch.setattr(module, "BLOCK", 4)
    rows = planted(9)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 2)


def test_repeated_ids_with_an_empty_text(spark):
    a = " ".join(f"w{k}" for k in range(40))
    rows = [(1, a), (2, a + " x"), (2, None), (2, a + " x"), (3, a + " y"), (3, "quite different")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {(1, 39, 1), (2, 40, 1), (2, 0, 2), (3, 40, 1), (3, 1, 1)}


def test_bridges_connect_what_survives():
    rng = np.random.default_rng(9)
    base = [np.unique(rng.integers(0, 1 << 63, 150).astype(np.uint64)) for _ in range(5)]
    sets = [np.sort(np.concatenate([b[: 150 - k * 6], rng.integers(0, 1 << 63, k * 6).astype(np.uint64)])) for b in base for k in range(8)]
    size, sig, ids = np.array([len(s) for s in sets]), np.frombuffer(b"".join(signatures(sets)), np.uint32).reshape(-1, HASHES), np.arange(40)
    for side in (np.zeros(40, int), np.arange(40) % 2 + 1):
        found = module.bridges(side, ids, ids, size, sig, 4, 5)
        root = ids.copy()
        for x, y in found:
            assert root[x] != root[y]  # none is superfluous
            root[root == root[x]] = root[y]
        for i in range(40):
            for j in range(i):
                if {side[i], side[j]} in ({0}, {1, 2}) and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j]) and len(module.survivors(sig[i : i + 1], sig[j : j + 1], 4, 5)[0]):
                    assert root[i] == root[j]


def test_odd_rows(odd, empty):
    assert near_duplicates(empty, 2).count() == 0
    got = near_duplicates(odd, 2).collect()
    assert len(got) == odd.count()
    of = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (8, 7, 8, True), (9, 7, 8, False), (None, 3 - 1, None, True), (5, 1, 5, True)} <= of
    kept = drop_near_duplicates(odd, 2)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1


def test_sets_and_signatures():
    a, b, c, d = shingle_sets(["Ab  cd\nEF", "ab cd ef", "", "x"], 2)
    assert (a == b).all() and len(a) == 2 and len(c) == 0 and len(d) == 1
    assert len(shingle_sets(["É A"], 2)[0]) == 1 and (shingle_sets(["É"], 2)[0] != shingle_sets(["é"], 2)[0]).all()
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8):
        both = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
        x, y = both[: int(len(both) * (1 + share) / 2)], both[int(len(both) * (1 - share) / 2) :]
        p, q = (np.frombuffer(s, np.uint32) for s in signatures([x, y]))
        assert abs((p == q).mean() - len(np.intersect1d(x, y)) / len(both)) < 4 * (0.25 / HASHES) ** 0.5
    assert signatures([c]) == [b""]


def test_pruning_keeps_what_is_similar():
    least = least_agreement(4, 5)
    rng = np.random.default_rng(4)
    agree = rng.random((20000, HASHES)) < 0.8  # pairs at the threshold
    sums = agree.cumsum(axis=1)[:, 15::16]
    assert (sums >= np.array(least)).all(axis=1).mean() > 0.9999
    assert ((rng.random((2000, HASHES)) < 0.3).cumsum(axis=1)[:, 15::16] >= np.array(least)).all(axis=1).mean() < 0.01


def test_joining_links_span_components():
    base = np.sort(np.random.default_rng(5).integers(0, 1 << 63, 200).astype(np.uint64))
    sets = [base, base[:-5], base[5:], base[:100], np.sort(base[100:])]
    ids = np.array([5, 4, 3, 2, 1])
    found = joining_links(np.zeros(5, int), ids, ids.copy(), sets, 4, 5)
    assert len(found) == 2 and {x for p in found for x in p} == {5, 4, 3}
    assert joining_links(np.zeros(5, int), ids, np.array([1, 1, 1, 2, 3]), sets, 4, 5) == []


def test_components(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: v for x, v in label.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
