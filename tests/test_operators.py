import itertools
import json
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from brooktext.operators import batches as B
from brooktext.operators import checkpoints as C
from brooktext.operators import judging as J
from brooktext.operators import vocabulary as V
from brooktext.operators.metrics import SERIES, scalar_series, step_log, write_series
from brooktext.operators.models import batched, precomputed, segmented
from brooktext.operators.segmentation import automaton, best_path, by_dictionary, costs
from brooktext.plans.config import Settings
from brooktext.plans.run import commits, run, scored_so_far, totals
from brooktext.plans.scoring import polled_filter, polled_judge, scored_responses, step_statistics, stored_pair_scores
from brooktext.sources import files as S
from brooktext.streaming.scoring import read_responses, start_scoring


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_coverage(spark):
    docs = spark.createDataFrame([(1, "他 叫 张三 ， 在"), (2, "他 他 x"), (3, "don't stop"), (4, " "), (5, "，。"), (6, None)], "doc_id long, text string")
    vocabulary = spark.createDataFrame([("他",), ("在",)], "word string")
    out = V.coverage(docs, vocabulary)
    assert rows(out) == [(1, 4, 2, 0.5), (2, 2, 1, 0.5), (3, 3, 0, 0.0), (4, 0, 0, 0.0), (5, 0, 0, 0.0), (6, 0, 0, 0.0)]
    assert "BroadcastHashJoin" in plan(out) and "Cartesian" not in plan(out)
    assert rows(V.matched_words(docs, vocabulary)) == [(1, ["他", "在"] if "他" < "在" else ["在", "他"]), (2, ["他"])]
    assert rows(V.membership(spark.createDataFrame([("他",), ("x",)], "word string"), vocabulary)) == [("x", False), ("他", True)]
    assert rows(V.coverage(docs.limit(0), vocabulary)) == []


def test_rows_that_share_an_id_are_kept_apart(spark):
    vocabulary = spark.createDataFrame([("甲",)], "word string")
    docs = spark.createDataFrame([(1, "甲 b"), (1, "甲 b"), (1, "甲"), (None, "b"), (None, ""), (None, None)], "doc_id int, text string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_matched, r.coverage) for r in V.coverage(docs, vocabulary).collect())
    assert got == [(0, 0, 0, 0.0), (0, 0, 0, 0.0), (0, 1, 0, 0.0), (1, 1, 1, 1.0), (1, 2, 1, 0.5), (1, 2, 1, 0.5)]
    assert [(r.doc_id, r.words) for r in V.matched_words(docs, vocabulary).collect()] == [(1, ["甲"])] * 3


def test_model_steps_run_once_a_row(spark, tmp_path):
    vocabulary = spark.createDataFrame([("甲",)], "word string")
    responses = spark.createDataFrame([(0, 1, "1. 改写：x 2. 分词：甲 b"), (0, 1, "1. 改写：x 2. 分词：甲 b"), (0, None, "甲")], "batch_id int, id int, response string")

    def counted(name):
        def load():
            def model(prompts):
                for p in prompts:
                    (tmp_path / name / uuid.uuid4().hex).touch()
                    yield p if name == "words" else 1.0

            return model

        (tmp_path / name).mkdir()
        return load

    word_filter = lambda df: batched(counted("words"), "words", "kept")(df).drop("words").withColumnRenamed("kept", "words")
    judge = batched(counted("expression"), "rewrite", "expression", "double")
    out = scored_responses(responses, vocabulary, judge, word_filter).collect()
    assert sorted((r.id or 0, r.coverage) for r in out) == [(0, 1.0), (1, 0.5), (1, 0.5)]
    assert len(list((tmp_path / "words").iterdir())) == len(list((tmp_path / "expression").iterdir())) == 3


def test_a_large_vocabulary_is_not_broadcast(spark):
    vocabulary = spark.range(30).select(F.col("id").cast("string").alias("word"))
    assert "broadcast" not in V.bounded(vocabulary, 29)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" in V.bounded(vocabulary, 30)._jdf.queryExecution().logical().toString().lower()


def test_batches(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    out = B.fixed_batches(df, F.col("k").cast("string"), 4)
    got = out.collect()
    assert len(got) == 8 and {r.batch_id for r in got} == {0, 1} and sorted((r.batch_id, r.pos) for r in got) == [(b, p) for b in (0, 1) for p in range(4)]
    assert len(B.fixed_batches(df, F.col("k").cast("string"), 4, drop_last=False).collect()) == 10
    assert [len(r.k) for r in B.collated(out, "k").collect()] == [4, 4]
    assert B.fixed_batches(df.limit(0), F.lit("x"), 4).collect() == []
    assert B.epoch_batches(df.limit(0), F.lit("x"), 4, 2).collect() == []
    assert [r.step for r in B.every(spark.createDataFrame([(s,) for s in range(1, 7)], "step int"), "step", 3).orderBy("step").collect()] == [3, 6]


def test_epochs_are_permutations(spark, monkeypatch):
    df = spark.range(1000).withColumnRenamed("id", "k")
    for bucket in (100_000, 3):  # one digit of buckets, and three
        monkeypatch.setattr(B, "BUCKET", bucket)
        got = B.epoch_batches(df, F.col("k").cast("string"), 7, 3).collect()
        orders = [[r.k for r in sorted(got, key=lambda r: r.step * 7 + r.pos) if r.epoch == e] for e in range(3)]
        assert all(len(o) == len(set(o)) == 994 for o in orders) and orders[0] != orders[1] != orders[2]
        assert sorted({r.step for r in got}) == list(range(1, 427)) and {(r.step - 1) // 142 for r in got if r.epoch == 2} == {2}
    assert sorted(map(tuple, got)) == sorted(map(tuple, B.epoch_batches(df.repartition(5), F.col("k").cast("string"), 7, 3).collect()))


def test_turn_pairs(spark):
    m = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "system", "s")], "conv_id long, turn long, role string, text string")
    assert rows(B.turn_pairs(m)) == [(1, 0, "a", "b")]


def attempts(spark, data):
    return spark.createDataFrame(data, "batch_id long, task_id string, attempt long, status string, content string")


def test_polled_scores(spark):
    data = [(0, "a", 1, "PROCESSING", None), (0, "a", 2, "SUCCESS", "0.6"), (0, "b", 1, "FAILED", None), (0, "c", 1, "ERROR", "boom"), (0, "c", 2, "SUCCESS", "1"), (0, "e", 41, "SUCCESS", "1")]
    data += [(0, "d", k, "PROCESSING", None) for k in range(1, 41)]
    got = {r.task_id: (r.status, r.score) for r in J.polled_scores(attempts(spark, data)).collect()}
    assert got == {"a": ("SUCCESS", 0.6), "b": ("FAILED", 0.0), "c": ("ERROR", 0.0), "d": ("UNRESOLVED", 0.01), "e": ("UNRESOLVED", 0.01)}
    three = spark.createDataFrame([(0, p, 0.5) for p in range(3)], "batch_id long, pos int, score double")
    assert [r.score for r in J.padded(three, 4).orderBy("pos").collect()] == [0.5, 0.5, 0.5, 0.01]


def test_polled_texts(spark):
    data = [(0, "a", 1, "SUCCESS", " x \n"), (0, "b", 1, "FAILED", None), (0, "c", 1, "ERROR", "boom")]
    # d: an empty success is asked again while e is pending; f ends only after the batch has stopped
    data += [(1, "d", 1, "SUCCESS", ""), (1, "d", 2, "SUCCESS", "late"), (1, "e", 1, "PROCESSING", None), (1, "e", 2, "SUCCESS", "y")]
    data += [(2, "f", 1, "SUCCESS", ""), (2, "f", 2, "SUCCESS", "never seen"), (2, "g", 1, "SUCCESS", "z")]
    got = {r.task_id: r.result for r in J.polled_texts(attempts(spark, data)).collect()}
    assert got == {"a": "x", "b": "Error processing b", "c": "API Error: boom", "d": "late", "e": "y", "f": "", "g": "z"}
    assert rows(J.all_done(attempts(spark, data))) == [(0, 1, True), (1, 1, False), (1, 2, True), (2, 1, True), (2, 2, True)]


def test_metrics(spark):
    steps = spark.createDataFrame([(1, {"custom/reward": 0.5}), (2, None)], "step long, stats map<string,double>")
    got = rows(scalar_series(steps))
    assert len(got) == 2 * len(SERIES) and (1, "Reward/Average", 0.5) in got and sum(v for *_, v in got) == 0.5


def test_a_step_that_is_written_again_is_replaced(spark, tmp_path):
    path = str(tmp_path / "series")
    steps = lambda *rows: spark.createDataFrame([(s, {"custom/reward": v}) for s, v in rows], "step long, stats map<string,double>")
    write_series(steps((1, 0.1), (2, 0.2), (5000, 0.5)), path)
    write_series(steps((2, 0.3), (3, 0.4)), path)
    write_series(steps((2, 0.3), (3, 0.4)), path)
    got = spark.read.parquet(path)
    assert got.count() == 4 * len(SERIES)
    assert rows(got.where("tag = 'Reward/Average'").select("step", "value")) == [(1, 0.1), (2, 0.3), (3, 0.4), (5000, 0.5)]


def test_logs(tmp_path):
    for _ in range(2):  # a second call adds no second handler
        log = step_log(str(tmp_path / "train.log"))
    log.info("step 1")
    assert (tmp_path / "train.log").read_text().count("step 1") == 1


def test_checkpoints(spark, tmp_path):
    names = spark.createDataFrame([("checkpoint-50",), ("checkpoint-400",), ("checkpoint-100",), ("checkpoint-x",), ("model-900",)], "name string")
    assert tuple(C.latest(names).first()) == ("checkpoint-400", 400)
    assert C.latest(spark.createDataFrame([("old-checkpoint-3",)], "name string")).first().step == 3
    assert tuple(C.latest(names.limit(0)).first()) == (None, 0)
    assert C.load(spark, str(tmp_path / "none")) == (None, 0)
    for step in (9, 10):
        C.save(spark.range(step), str(tmp_path), step)
    table, step = C.load(spark, str(tmp_path))
    assert step == 10 and table.count() == 10


def test_prompt_files(spark, tmp_path):
    (tmp_path / "prompt.txt").write_text("a\nb\n")
    assert S.read_prompt(spark, str(tmp_path / "prompt.txt")).first().value == "a\nb\n"


def test_model_steps(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    assert rows(batched(lambda: lambda ts: [t.upper() for t in ts], "text", "out")(df)) == [(1, "ab", "AB"), (2, None, "")]
    assert rows(precomputed(spark.createDataFrame([(1, 0.5)], "id long, e double"), ["id"], "e")(df)) == [(1, "ab", 0.5), (2, None, None)]
    assert [r.segmented for r in segmented(list)(df).orderBy("id").collect()] == ["a b", ""]
    assert [r.segmented for r in segmented(None)(df).orderBy("id").collect()] == ["ab", ""]
    assert Settings().save_every == 50 and Settings().sampling is not Settings().sampling


def test_scoring_plan(spark):
    responses = spark.createDataFrame([(0, 1, "1. 改写：甲乙\n2. 分词：甲 乙"), (0, 2, "丙")], "batch_id long, id long, response string")
    vocabulary = spark.createDataFrame([("甲",)], "word string")
    out = scored_responses(responses, vocabulary, lambda df: df.withColumn("expression", F.lit(1.0)))
    got = {r.id: (r.rewrite, r.words, r.coverage, r.reward) for r in out.collect()}
    assert got == {1: ("甲乙", "甲 乙", 0.5, 0.7), 2: ("", "丙", 0.0, 0.4)}
    assert step_statistics(out).first().stats["custom/wordbank"] == 0.25


def judged(spark, attempts_of):
    """An asked service: attempts_of(prompt) gives a prompt's (status, content) rounds. Counts how often each prompt is sent."""
    sent = []

    def ask(prompted):
        rows = prompted.select("batch_id", "row_key", "prompt").collect()
        sent.extend(r.prompt for r in rows)
        data = [(r.batch_id, r.row_key, k, status, content) for r in rows for k, (status, content) in enumerate(attempts_of(r.prompt), 1)]
        return spark.createDataFrame(data, "batch_id long, row_key long, attempt long, status string, content string")

    return ask, sent


def test_rows_of_one_id_are_judged_each_for_itself(spark):
    responses = [(0, 1, "1. 改写：x 2. 分词：甲 b"), (0, 1, "1. 改写：y 2. 分词：甲"), (0, None, "1. 改写：z 2. 分词：甲 乙"), (0, 1, "1. 改写：y 2. 分词：甲"), (1, 2, "1. 改写：w 2. 分词：甲")]
    frame = spark.createDataFrame(responses, "batch_id long, id long, response string")
    vocabulary = spark.createDataFrame([("甲",)], "word string")
    ask_score, sent = judged(spark, lambda p: {"x": [("PROCESSING", None), ("SUCCESS", "0.9")], "y": [("SUCCESS", "0.2")], "z": [("FAILED", None)]}.get(p[0], [("PROCESSING", None)] * 41))
    ask_words, words_sent = judged(spark, lambda p: [("PROCESSING", None)] * 2 + [("SUCCESS", " 甲 \n")] if p.startswith("甲 b") else [("SUCCESS", p.removesuffix("!"))] if "乙" not in p else [("ERROR", "boom")])
    out = scored_responses(frame, vocabulary, polled_judge(ask_score, "?", "rewrite"), polled_filter(ask_words, "!")).collect()
    got = sorted((r.id or 0, r.rewrite, r.words, r.coverage, r.expression, r.reward) for r in out)
    assert got == [(0, "z", "API Error: boom", 0.0, 0.0, 0.0), (1, "x", "甲", 1.0, 0.9, 0.96), (1, "y", "甲", 1.0, 0.2, 0.68), (1, "y", "甲", 1.0, 0.2, 0.68), (2, "w", "甲", 1.0, 0.01, 0.604)]
    assert sorted(sent) == ["w?", "x?", "y?", "y?", "z?"] and sorted(words_sent) == ["甲 b!", "甲 乙!", "甲!", "甲!", "甲!"]
    assert "row_key" not in out[0].asDict()


def test_stored_pairs_are_asked_once(spark):
    pairs = spark.createDataFrame([(0, 0, "a", "b"), (0, 1, "c", "d"), (1, 0, None, "e")], "batch_id long, pos int, original string, response string")
    sent = []

    def ask(prompts):
        sent.extend(r.prompt for r in prompts.collect())
        return prompts.where("prompt <> 'cd?'").select("batch_id", "pos", F.lit(1).cast("long").alias("attempt"), F.lit("SUCCESS").alias("status"), F.lit("0.5").alias("content"))

    got = rows(stored_pair_scores(pairs, ask, "?", 2).select("batch_id", "pos", "score"))
    assert got == [(0, 0, 0.5), (0, 1, 0.01), (1, 0, 0.5), (1, 1, 0.01)] and sorted(sent) == ["ab?", "cd?", "e?"]


def generated(df):
    return df.withColumn("response", F.concat(F.lit("1. 改写：r 2. 分词：甲 "), F.col("k").cast("string")))


def test_a_run_that_was_killed_goes_on(spark, tmp_path):
    """A run that dies in each of its phases ends with the tables of one that didn't, and no committed step is run twice."""
    sentences, vocabulary = spark.range(22).withColumnRenamed("id", "k"), spark.createDataFrame([("甲",), ("7",)], "word string")
    settings, seen = Settings(batch_size=2, epochs=2, save_every=4), []

    def judge(df, fail=None):
        steps = sorted({r.step for r in df.select("step").collect()})
        seen.append((steps[0], steps[-1]))
        if fail and steps[0] >= fail:
            raise RuntimeError("killed")
        return df.withColumn("expression", F.lit(0.5) + F.pmod("k", F.lit(2)) / 2)

    def go(folder, **how):
        return run(sentences, "k", generated, vocabulary, how.pop("judge", judge), str(tmp_path / folder), settings, log_file=str(tmp_path / f"{folder}.log"), **how)

    assert go("whole") == 22 and seen == [(1, 4), (5, 8), (9, 12), (13, 16), (17, 20), (21, 22)]
    seen.clear()
    with pytest.raises(RuntimeError):
        go("parts", judge=lambda df: judge(df, 5))
    assert sorted(commits(spark, str(tmp_path / "parts"))) == [4]

    def dies(state, scored):
        raise RuntimeError("killed after scoring")

    with pytest.raises(RuntimeError):
        go("parts", learn=dies)  # the second chunk is scored and its series written, but not committed
    assert go("parts") == 22 and go("parts") == 22
    assert seen == [(1, 4), (5, 8), (5, 8), (5, 8), (9, 12), (13, 16), (17, 20), (21, 22)]
    for name in ("scored", "series"):
        read = (lambda f: scored_so_far(spark, f)) if name == "scored" else (lambda f: spark.read.parquet(f"{f}/series"))
        one, two = (read(str(tmp_path / f)) for f in ("whole", "parts"))
        assert rows(one) == rows(two.select(one.columns)) and one.count() == {"scored": 44, "series": 22 * len(SERIES)}[name]
    state = [C.load(spark, str(tmp_path / f / "state")) for f in ("whole", "parts")]
    assert state[0][1] == state[1][1] == 22 and [tuple(round(x, 9) for x in s.first()) for s, _ in state] == [(44, 23.0, 33.0, 27.0)] * 2
    log = (tmp_path / "whole.log").read_text()
    assert "Epoch 0 Step 1:" in log and "Epoch 1 Step 22:" in log


def test_a_run_reads_its_sentences_once_a_pass(spark, tmp_path):
    """However many chunks there are. Chunks that are scored together are learned from and committed one by one, and end in the same tables."""
    read = spark.sparkContext.accumulator(0)

    def counted(k):
        read.add(1)
        return k

    sentences = spark.range(22).withColumnRenamed("id", "k").withColumn("n", F.udf(counted, "long")("k"))
    vocabulary, settings, learned = spark.createDataFrame([("甲",), ("7",)], "word string"), Settings(batch_size=2, epochs=2, save_every=1), []

    def learn(state, scored, fail=None):
        step = scored.first().step
        if step == fail:
            raise RuntimeError("killed")
        learned.append(step)
        return totals(state, scored)

    def go(folder, **how):
        judge = lambda df: df.withColumn("expression", F.lit(0.5) + F.pmod("n", F.lit(2)) / 2)
        return run(sentences, "k", generated, vocabulary, judge, str(tmp_path / folder), settings, **{"learn": learn} | how)

    assert go("alone") == 22 and read.value == 44 and learned == [*range(1, 23)]
    learned.clear()
    with pytest.raises(RuntimeError):
        go("ahead", ahead=4, learn=lambda state, scored: learn(state, scored, 7))
    assert sorted(commits(spark, str(tmp_path / "ahead"))) == learned == [*range(1, 7)]
    assert go("ahead", ahead=4) == 22 and learned == [*range(1, 23)]
    for name in (scored_so_far, lambda spark, f: spark.read.parquet(f"{f}/series"), lambda spark, f: C.load(spark, f"{f}/state")[0]):
        one, two = (name(spark, str(tmp_path / f)) for f in ("alone", "ahead"))
        assert one.count() and rows(one) == rows(two.select(one.columns))


def cheapest(text, words, lone):
    """The best path by trying every way to cut the text, ties as stated: at each place the longest last word."""
    best = {0: (0, [])}
    for end in range(1, len(text) + 1):
        ways = [(best[end - 1][0] + lone, -1, best[end - 1][1] + [text[end - 1]])]
        ways += [(best[end - n][0] + words[text[end - n : end]], -n, best[end - n][1] + [text[end - n : end]]) for n in range(1, end + 1) if text[end - n : end] in words]
        best[end] = min(ways)[::2]
    every = min(sum(words.get(w, lone) if len(w) > 1 else min(lone, words.get(w, lone)) for w in cut) for cut in cuts(text, words)) if len(text) <= 9 else best[len(text)][0]
    assert best[len(text)][0] == every
    return best[len(text)][1]


def cuts(text, words):
    for marks in itertools.product([0, 1], repeat=max(0, len(text) - 1)):
        at = [0, *(i + 1 for i, m in enumerate(marks) if m), len(text)]
        parts = [text[a:b] for a, b in zip(at, at[1:], strict=False) if a < b]
        if all(len(p) == 1 or p in words for p in parts):
            yield parts


def test_segmentation_like_every_cut(spark):
    rng = random.Random(4)
    data = [("".join(rng.choice("甲乙ab😀") for _ in range(rng.randint(1, 4))), rng.randint(1, 50)) for _ in range(40)]
    words, lone = costs(spark.createDataFrame([*data, ("", 5), (data[0][0], 3)], "word string, weight long"))
    total = sum(w for _, w in data) + 3
    assert dict(words)[data[1][0]] == math.floor(1000 * math.log(total / sum(w for x, w in data if x == data[1][0]))) or data[1][0] == data[0][0]
    found = automaton(words)
    for n in [0, 1, *(rng.randint(2, 9) for _ in range(60)), 200]:
        t = "".join(rng.choice("甲乙ab😀c") for _ in range(n))
        assert best_path(t, found, lone) == cheapest(t, dict(words), lone)
    df = spark.createDataFrame([("甲乙 ab\n",), (None,), (" ",)], "text string")
    got = [r.segmented for r in by_dictionary(spark.createDataFrame([("甲乙", 5), ("b", 1)], "word string, weight long"))(df).collect()]
    assert got == ["甲乙 a b", "", ""]
    assert [r.segmented for r in by_dictionary(spark.createDataFrame([], "word string, weight long"))(df).collect()] == ["甲 乙 a b", "", ""]


def test_stream_keeps_rows_apart(spark, tmp_path):
    """Rows of one id, and without one, each with its own words; a micro-batch's series once, also if it is repeated."""
    (tmp_path / "in").mkdir()
    data = [{"id": 1, "response": "1. 改写：a 2. 分词：甲"}, {"id": 1, "response": "1. 改写：b 2. 分词：甲 乙"}, {"response": "1. 改写：c 2. 分词：乙"}, {"id": 1, "response": "1. 改写：a 2. 分词：甲"}]
    (tmp_path / "in" / "0.json").write_text("\n".join(map(json.dumps, data)) + "\n")
    vocabulary = spark.createDataFrame([("甲",)], "word string")
    for k in range(2):  # the second stream has lost its checkpoint and repeats the micro-batch
        start_scoring(read_responses(spark, str(tmp_path / "in")), vocabulary, str(tmp_path / "out"), str(tmp_path / f"ck{k}"), series=str(tmp_path / "series")).awaitTermination(120)
    got = sorted((r.id or 0, r.rewrite, r.coverage) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, "c", 0.0), (1, "a", 1.0), (1, "a", 1.0), (1, "b", 0.5)]
    series = spark.read.parquet(str(tmp_path / "series"))
    assert series.count() == len(SERIES) and series.where("tag = 'Reward/Wordbank'").first().value == 0.625


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    vocabulary = spark.createDataFrame([("甲",)], "word string")
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"id": k, "response": "1. 改写：甲\n2. 分词：甲 乙"}) + "\n")
        query = start_scoring(read_responses(spark, str(tmp_path / "in")), vocabulary, str(tmp_path / "out"), str(tmp_path / "ck"))
        query.awaitTermination(120)
    assert [(r.id, r.coverage) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()] == [(0, 0.5), (1, 0.5)]
