from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from brooktext.llm.pii import detect
from brooktext.llm.shared import persist
from test_near_duplicates import brute

DATA = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "pieces"]
    before, frames = docs, {}
    for name, stage in pipeline.STAGES:
        before = persist(stage(spark, before, DATA), name)
        frames[name] = {r.doc_id: r for r in before.collect()}
        assert name == "pieces" or before.columns == docs.columns
    good = frames["quality"]
    known = [(i in good, q) for i, q in labels.items()]
    assert sum(kept == q for kept, q in known) > 0.98 * len(known) and sum(kept for kept, q in known if q) > 0.99 * sum(q for _, q in known)
    groups = brute([(i, r.text) for i, r in good.items()], 5)
    assert set(frames["near_duplicates"]) == {i for i, (_, c) in groups.items() if i == c}
    assert not any(t in r.text for r in frames["decontamination"].values() for t in items)
    assert set(frames["decontamination"]) >= {i for i, r in frames["near_duplicates"].items() if not any(t[:40] in r.text for t in items)}
    for i, r in frames["pii"].items():
        old = frames["decontamination"][i].text
        assert (r.text == old) == (not detect(old)) and r.n_chars == len(r.text)
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in frames["pieces"].values()) and set(frames["pieces"]) == set(frames["pii"])


def test_run(spark):
    got = pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and {"doc_id", "text", "lang", "source", "n_chars", "ids"} <= set(got.columns)


def test_odd_rows(spark, odd):
    df = odd.select("doc_id", "text", "lang", "source", "n_chars", F.lit("own").alias("score"), F.lit(7).alias("Kinds"), F.lit("k").alias("pii_row"))
    before = {(r.source, r.text, r.score, r.Kinds, r.pii_row) for r in df.collect()}
    for name, stage in pipeline.STAGES:
        out = persist(stage(spark, df, "/root/testdata/sf0.001"), name)
        assert name == "pieces" or out.columns == df.columns
        rows = {(r.source, r.text, r.score, r.Kinds, r.pii_row) for r in out.collect()}
        assert rows <= before and out.count() == len(rows), name
        if name == "near_duplicates":
            texts = {r.doc_id: r.text for r in out.collect()}
            assert 9 not in texts or 8 not in texts
        if name in ("near_duplicates", "decontamination", "pii", "pieces"):  # texts without words stay
            assert {r for r in before if not (r[1] or "").split()} == {r for r in rows if not (r[1] or "").split()}, name
        df, before = out, rows
    assert {"ids", "round_trip", "n_pieces"} <= set(df.columns)
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in df.collect())


def test_empty_tables(spark, empty):
    df = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in pipeline.STAGES:
        df = persist(stage(spark, df, "/root/testdata/sf0.001"), name)
        assert df.count() == 0, name


def test_only_the_last_table_stays(spark):
    from pathlib import Path

    from brooktext.llm.shared import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in folder.glob("pipeline-*")}
    pipeline.run(spark, "/root/testdata/sf0.001")
    left = {p.name for p in folder.glob("pipeline-*")} - before
    assert [n.rsplit("-", 1)[0] for n in left] == ["pipeline-pii"]
