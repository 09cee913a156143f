import random

import numpy as np

from brooktext.llm import decontamination
from brooktext.llm.decontamination import Index, _letters, benchmark_matches, blocks_of, drop_contaminated, nearest, plain


def brute(p, t):
    """The least edit distance of p to any stretch of t."""
    before = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        now = [i]
        for j, y in enumerate(t, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return min(before)


def edited(rng, t, rate):
    out = []
    for c in t:
        r = rng.random() / rate
        out.append("" if r < 1 / 3 else rng.choice("abcdefghij ") if r < 2 / 3 else c + rng.choice("abcdefghij ") if r < 1 else c)
    return "".join(out)


def items_of(spark):
    return tuple((r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect())


def test_nearest_like_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        p, t = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, n))) for n in (20, 50))
        got = nearest(p, t, 100)
        assert got[0] == brute(p, t) and brute(p, t[got[1] : got[2]]) == got[0]
    assert nearest("abc", "xyz", 2) is None


def test_recall(spark, docs):
    """Changed copies that are near enough by brute force are found; unchanged ones always."""
    rng, items = random.Random(7), items_of(spark)
    index, fill = Index(items), [r.text for r in docs.collect()]
    for rate, least in ((0, 1.0), (0.02, 0.99), (0.05, 0.97), (0.1, 0.92)):
        cases = []
        for k, (_, t) in enumerate(index.texts):
            new = edited(rng, t, rate) if rate else t
            if brute(t[:120], new[:140]) >= 0 and nearest(t, new, len(t) // 5):
                cases.append((k, rng.choice(fill)[: rng.randint(0, 90)] + " " + new.upper() + "\n" + rng.choice(fill)[:80]))
        got = index.matches([t for _, t in cases])
        assert sum(any(f[0] == k for f in found) for (k, _), found in zip(cases, got, strict=True)) >= least * len(cases), rate


def test_recall_by_length_and_rate(docs):
    """Up to the threshold, for items of each length class."""
    rng, fill = random.Random(11), [r.text for r in docs.collect() if r.text]
    words = " ".join(fill).split()
    for shortest, longest in ((20, 39), (40, 79), (80, 149), (150, 400)):
        items = []
        while len(items) < 120:
            at = rng.randrange(len(words) - 120)
            t = " ".join(words[at : at + 120])[: rng.randint(shortest, longest)].strip()
            items += [(len(items), t)] if shortest <= len(plain(t).encode()) <= longest else []
        index = Index(tuple(items))
        for rate in (0.1, 0.15, 0.2):
            new = [(k, edited(rng, t, rate)) for k, (_, t) in enumerate(index.texts)]
            cases = [(k, rng.choice(fill)[: rng.randint(0, 90)] + " " + t + " " + rng.choice(fill)[:80]) for k, t in new if nearest(index.texts[k][1], t, len(index.texts[k][1]) // 5)]
            got = index.matches([t for _, t in cases])
            found = sum(any(f[0] == k for f in m) for (k, _), m in zip(cases, got, strict=True))
            assert len(cases) > 30 and found >= 0.95 * len(cases), (shortest, rate, found, len(cases))


def test_short_items_are_found_exactly():
    """Items of 1 to 19 bytes: every stretch within the similarity is found, at its least distance, and nothing else, at any similarity."""
    rng = random.Random(8)
    for similarity in (0.8, 0.7, 0.5, 0.0):
        items = tuple((i, "".join(rng.choice("abc é") for _ in range(rng.randint(1, 17)))) for i in range(60))
        items = tuple((i, t) for i, t in items if len(t.encode()) < 20)
        index = Index(items)
        for _ in range(40):
            doc = "".join(rng.choice("abcd é") for _ in range(rng.randint(0, 90))) + edited(rng, rng.choice(items)[1], 0.25)
            got = {index.texts[k][0]: (n, a, b) for k, n, a, b in index.matches([doc], similarity)[0]}
            for i, t in items:
                most = int(len(t) * (1 - similarity) + 1e-9)
                least = brute(t, doc)
                assert (i in got) == (least <= most), (t, doc)
                if i in got:
                    n, a, b = got[i]
                    assert n == least == brute_whole(t, doc[a:b])


def brute_whole(p, t):
    before = list(range(len(t) + 1))
    for i, x in enumerate(p, 1):
        now = [i]
        for j, y in enumerate(t, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_bound_drops_nothing_near():
    rng = random.Random(12)
    items = tuple((n, "".join(rng.choice("abcdé ") for _ in range(n))) for n in (20, 63, 64, 65, 128, 150, 300) for _ in range(8))
    index = Index(items)
    for k, (_, t) in enumerate(index.texts):
        for rate in (0.05, 0.15, 0.2):
            lead = "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 90)))
            text, about = lead + edited(rng, t, rate) + "abc" * 9, max(0, len(lead) + rng.randint(-8, 8))
            if index.verified(k, text, about, 0.8):
                assert index.bound.near(_letters(text), *(np.array([x]) for x in (0, len(text), about, k)), 0.8)[0]


def test_bound_is_the_pieces_distance():
    """Pieces of any length, at stretches of unequal length, cost what brute force says."""
    rng = random.Random(13)
    items = tuple((n, "".join(rng.choice("abc ") for _ in range(n))) for n in (20, 63, 64, 65, 129, 300))
    bound, text = Index(items).bound, "".join(rng.choice("abc ") for _ in range(400))
    k, piece = (np.array(x) for x in zip(*((k, p) for k in range(len(items)) for p in range(bound.pieces[k])), strict=True))
    assert all("".join(t[bound.cut(k, p) : bound.cut(k, p + 1)] for p in range(bound.pieces[k])) == t for k, (_, t) in enumerate(items))
    a = np.array([rng.randint(0, 200) for _ in k])
    b = a + np.array([rng.randint(0, 150) for _ in k])
    got = bound.least(_letters(text), a, b, bound.first[k] + piece, bound.cut(k, piece + 1) - bound.cut(k, piece))
    assert got.tolist() == [brute(items[i][1][bound.cut(i, p) : bound.cut(i, p + 1)], text[x:y]) for i, p, x, y in zip(k, piece, a, b, strict=True)]


def test_work_of_a_text(spark, docs, monkeypatch):
    """A window and an item's window are compared once in each walk, whatever samplings they share, and the bound takes few columns."""
    seen, columns = [], [0]
    agreement, least = decontamination._Class.agreement, decontamination._Bound.least

    def compared(self, walk, data, at, rows):
        seen.extend(zip([self.step] * len(at), [walk] * len(at), at.tolist(), rows.tolist(), strict=True))
        return agreement(self, walk, data, at, rows)

    def bounded(self, data, a, b, *rest):
        columns[0] += int((b - a).max()) * len(a)
        return least(self, data, a, b, *rest)

    monkeypatch.setattr(decontamination._Class, "agreement", compared)
    monkeypatch.setattr(decontamination._Bound, "least", bounded)
    texts = [r.text for r in docs.collect() if r.text]
    Index(items_of(spark)).matches(texts)
    assert seen and len(set(seen)) == len(seen)
    assert 0 < columns[0] < 5 * sum(map(len, texts))


def test_recall_of_middle_items(docs):
    """Items of 80 to 149 bytes, the class that finds least: 0.98 up to the threshold."""
    rng, words = random.Random(14), " ".join(r.text for r in docs.collect() if r.text).split()
    items = tuple((k, " ".join(words[at : at + 60])[: rng.randint(82, 145)].strip()) for k, at in enumerate(rng.sample(range(len(words) - 60), 200)))
    index = Index(tuple((k, t) for k, t in items if 80 <= len(t.encode()) < 150))
    cases = [(k, new) for k, (_, t) in enumerate(index.texts) for _ in range(4) if nearest(t, new := edited(rng, t, 0.2), len(t) // 5)]
    got = index.matches(["qz " * 9 + t + " zq" * 9 for _, t in cases])
    assert len(cases) > 300 and sum(any(f[0] == k for f in m) for (k, _), m in zip(cases, got, strict=True)) >= 0.98 * len(cases)


def test_spans_and_no_others(spark, docs):
    items = items_of(spark)
    index = Index(items)
    clean = [r.text for r in docs.collect()]
    held = [[k for k, (_, t) in enumerate(index.texts) if t in plain(d)] for d in clean]
    assert [[f[0] for f in m if f[1] == 0] for m in index.matches(clean)] == held
    text = "é" * 30 + clean[0][:77] + items[3][1] + clean[1][:50]
    (k, distance, start, end), *_ = [f for f in index.matches([text])[0] if index.texts[f[0]][0] == items[3][0]]
    assert distance == 0 and text[start:end] == items[3][1]


def test_size_classes(spark):
    rng = random.Random(8)
    items = tuple((n, "".join(rng.choice("abcdefgh ") for _ in range(n))) for n in (5, 21, 30, 45, 79, 80, 200, 900))
    index = Index(items)
    assert len(index.classes) == 3
    for n, t in items:
        for lead in range(20):
            assert any(index.texts[f[0]][0] == n for f in index.matches(["z" * lead + t + "y" * 7])[0]), (n, lead)


def test_tables(spark, odd, empty, docs):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    marked = benchmark.withColumnRenamed("text", "item").selectExpr("item_id", "item as text", "1 as doc_id")
    assert benchmark_matches(empty, marked).count() == 0 and benchmark_matches(odd, benchmark).count() == 0
    assert benchmark_matches(docs, benchmark.limit(0)).count() == 0 and drop_contaminated(docs, benchmark.limit(0)).count() == docs.count()
    found = {r.doc_id for r in benchmark_matches(docs, marked).collect()}
    texts = [r.text for r in benchmark.collect()]
    assert {r.doc_id for r in docs.collect() if any(t in r.text for t in texts)} <= found
    kept = drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - found
    key = lambda r: repr(r)
    assert sorted(map(tuple, drop_contaminated(odd, benchmark).collect()), key=key) == sorted(map(tuple, odd.collect()), key=key)
    assert len(blocks_of(benchmark, "text", "item_id", 1000)) > 3
    odd_items = spark.createDataFrame([(1, None), (2, ""), (None, "the same words in a text of two")], "item_id long, text string")
    assert {r.doc_id for r in benchmark_matches(odd, odd_items).collect()} == {8, 9}
