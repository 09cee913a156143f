"""Readers against Spark's whole-file readers and plain Python, in one task and in many."""

import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from brooktext.operators import tables as T
from brooktext.sources import files as S
from brooktext.sources.arrays import json_elements


@pytest.fixture(params=["one task", "many tasks"])
def blocks(spark, request):
    """The same with a file in one block and in many."""
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"} if request.param == "many tasks" else {}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield bool(names)
    for k, v in old.items():
        spark.conf.set(k, v)


def nasty(rng):
    """A value whose text holds brackets, quotes, escapes and halves of surrogate pairs as escapes."""
    text = lambda: "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "a", "好", "😀", "\n", " ", "batches", " "]) for _ in range(rng.randint(0, 12)))
    kind = rng.randrange(6)
    if kind == 0:
        return [nasty(rng) for _ in range(rng.randint(0, 3))]
    if kind == 1:
        return {text(): nasty(rng) for _ in range(rng.randint(0, 3))}
    return [text(), rng.randint(-9, 9), None, True][kind - 2]


@pytest.mark.parametrize("seed", range(6))
def test_array_elements(spark, tmp_path, blocks, seed):
    rng = random.Random(seed)
    items = [nasty(rng) for _ in range(60)]
    how = {"ensure_ascii": seed % 2 == 0, "indent": [None, 1, 3][seed % 3]}
    (tmp_path / "a.json").write_text(json.dumps(items, **how), encoding="utf-8")
    got = json_elements(spark, str(tmp_path / "a.json")).orderBy("block", "at").collect()
    assert [json.loads(r.json) for r in got] == items
    root = {"x": nasty(rng), "batches_": [1], "y": {"batches": [2, [3]]}, "batches": items, "z": ["batches", [4]], "end": nasty(rng)}
    (tmp_path / "b.json").write_text(" \n" + json.dumps(root, **how) + "\n", encoding="utf-8")
    got = json_elements(spark, str(tmp_path / "b.json"), "batches").orderBy("block", "at").collect()
    assert [json.loads(r.json) for r in got] == items
    if blocks:
        assert len({r.block for r in got}) > 3


def test_arrays_without_elements(spark, tmp_path, blocks):
    for text, key in (("[]", None), (" [ ] ", None), ("", None), ('{"batches": []}', "batches"), ('{"x": [1]}', "batches"), ('{"x": {"batches": [1]}}', "batches")):
        (tmp_path / "a.json").write_text(text)
        assert json_elements(spark, str(tmp_path / "a.json"), key).collect() == [], text


def test_corpus_like_the_whole_file_reader(spark, tmp_path, blocks):
    rng = random.Random(7)
    rows = [{"other": nasty(rng), "original_sentence": json.dumps(nasty(rng), ensure_ascii=False) if k % 9 else None} for k in range(80)]
    for name, how in (("a", {}), ("b", {"ensure_ascii": False, "indent": 2})):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, **how), encoding="utf-8")
    want = spark.read.schema("original_sentence string").option("multiLine", True).json(str(tmp_path))
    assert sorted(map(repr, S.read_corpus(spark, str(tmp_path)).collect())) == sorted(map(repr, want.collect()))


def test_judge_pairs(spark, tmp_path, blocks):
    rng = random.Random(3)
    lists = [[json.dumps(nasty(rng)) for _ in range(rng.randint(0, 5))] for _ in range(40)]
    pairs = list(zip(lists[::2], lists[1::2], strict=True))
    (tmp_path / "p.json").write_text(json.dumps({"batch_size": 4, "total_batches": 20, "batches": [{"batch_original_sentence": a, "responses": b} for a, b in pairs]}))
    got = sorted(map(tuple, S.read_judge_pairs(spark, str(tmp_path / "p.json")).collect()))
    assert got == [(i, k, x, y) for i, (a, b) in enumerate(pairs) for k, (x, y) in enumerate(zip(a, b, strict=False))]


def test_dictionary_in_blocks(spark, tmp_path, blocks):
    """The last of equal words counts, whatever task read it."""
    rng = random.Random(5)
    lines = [{"word": rng.choice("甲乙丙丁"), "meaning": [f"～{k}", "x\n}"]} for k in range(200)]
    (tmp_path / "words.jsonl").write_text("\n".join(json.dumps(e, ensure_ascii=k % 2 == 0) + ("\r" if k % 5 == 0 else "") + ("\n \t" if k % 7 == 0 else "") for k, e in enumerate(lines)), encoding="utf-8")
    entries = S.read_dictionary(spark, str(tmp_path / "words.jsonl"))
    want = {e["word"]: [m.replace("～", e["word"]) for m in e["meaning"]] for e in lines}
    assert {r.word: r.meaning for r in S.vocabulary_of(entries, *S.LINE_ORDER).collect()} == want
    assert entries.count() == 200 and (entries.rdd.getNumPartitions() > 3) == blocks


@pytest.mark.parametrize("bad", ['{"word":', '{"meaning":[]}', "null", "[1", '{"word":"a","meaning":5'])
def test_bad_lines_tell_their_place(spark, tmp_path, blocks, bad):
    (tmp_path / "bad.jsonl").write_text('{"word":"fine"}\n' * 20 + bad + "\n")
    with pytest.raises(Exception, match=r"in file:\S+bad\.jsonl, block from byte \d+"):
        S.read_dictionary(spark, str(tmp_path / "bad.jsonl")).collect()


def test_snapshot(spark, tmp_path):
    source, snapshot = tmp_path / "words.jsonl", str(tmp_path / "snapshot")
    words = lambda: sorted(r.word for r in S.load_vocabulary(spark, str(source), snapshot).collect())
    source.write_text('{"word":"a"}\n')
    assert words() == ["a"]
    first = S.load_vocabulary(spark, str(source), snapshot)  # read again later, after others were made
    os.utime(source, (1_700_000_000, 1_700_000_000))
    source_time = os.stat(source).st_mtime_ns
    source.write_text('{"word":"a"}\n{"word":"b"}\n')
    assert words() == ["a", "b"] and os.stat(source).st_mtime_ns != source_time
    made = T.versions(spark, snapshot)
    assert words() == ["a", "b"] and T.versions(spark, snapshot) == made  # unchanged: not made again
    assert [r.word for r in first.collect()] == ["a"]
    source.write_text('{"word":\n')
    with pytest.raises(Exception, match="no dictionary entry"):
        words()
    assert T.versions(spark, snapshot) == made and T.newest(spark, snapshot).count() == 2  # a failed one is never seen
    source.unlink()
    assert words() == ["a", "b"]


def test_readers_see_whole_versions(spark, tmp_path):
    """While versions are published, each read gives all rows of one of them."""
    folder, seen = str(tmp_path / "v"), []
    T.publish(spark.range(100).withColumn("v", F.lit(0)), folder)

    def read():
        for _ in range(12):
            rows = T.newest(spark, folder).collect()
            seen.append((len(rows), len({r.v for r in rows})))

    reader = threading.Thread(target=read)
    reader.start()
    for v in range(1, 5):
        T.publish(spark.range(100).withColumn("v", F.lit(v)), folder, keep=100)
    reader.join()
    assert set(seen) == {(100, 1)} and len(seen) == 12
    T.publish(spark.range(7), folder, keep=2)
    assert len(T.versions(spark, folder)) == 2 and len([p for p in os.listdir(folder) if p.startswith("data-")]) == 2


def test_names_and_times(spark, tmp_path):
    assert S.names_in(spark, str(tmp_path / "none")).collect() == [] and S.modified(spark, str(tmp_path / "none")) is None
    (tmp_path / "d" / "checkpoint-5" / "deep").mkdir(parents=True)
    (tmp_path / "d" / "checkpoint-5" / "deep" / "f").write_text("x")
    (tmp_path / "d" / "file with blanks%20").write_text("y")
    os.utime(tmp_path / "d" / "file with blanks%20", (5, 5))
    os.utime(tmp_path / "d" / "checkpoint-5" / "deep" / "f", (9, 9))
    got = {r.name: r.path for r in S.names_in(spark, str(tmp_path / "d")).collect()}
    assert set(got) == {"checkpoint-5", "file with blanks%20"} and got["checkpoint-5"].endswith("/d/checkpoint-5")
    assert S.modified(spark, str(tmp_path / "d")) == 9.0 and S.modified(spark, str(tmp_path / "d" / "file with blanks%20")) == 5.0
