"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "benchmark", "labels", "conversations", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .chat import REPLY, link_tool_calls, turns_as_calls

    out = link_tool_calls(*turns_as_calls(table(spark, sf_dir, "conversations")), REPLY)
    absent = {c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("turn", "result_turn", "level")}  # -1 for none
    return out.withColumns(absent | {"canonical": F.sha2("canonical", 256), "valid": F.coalesce("valid", F.lit(False)), "errors": F.coalesce("errors", F.lit(""))}).withColumnRenamed("canonical", "canonical_sha256")


OP1_SQL = """
WITH m AS (SELECT conv_id, turn, lower(role) AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, turn, text, turn - 2 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m WHERE role = 'user'),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS level FROM c),
r AS (SELECT conv_id, turn, text FROM m WHERE role = 'assistant'),
j AS (
  SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, coalesce(l.turn, r.turn - 1) AS asked, l.turn AS turn, l.level AS level, l.text AS question, r.turn AS result_turn, r.text AS answer
  FROM l FULL OUTER JOIN r ON l.conv_id = r.conv_id AND l.turn = r.turn - 1
),
e AS (
  SELECT *, CASE WHEN turn IS NULL THEN NULL WHEN length(question) < 1 THEN '$.text: shorter than 1' WHEN length(question) > 400 THEN '$.text: longer than 400' ELSE '' END AS errors FROM j
)
SELECT conv_id, 'call_' || asked AS call_id, CASE WHEN turn IS NOT NULL THEN 'reply' END AS name, coalesce(turn, -1) AS turn, coalesce(result_turn, -1) AS result_turn,
  CASE WHEN result_turn IS NULL THEN 0 ELSE 1 END::BIGINT AS n_results, 0::BIGINT AS n_missing,
  CASE WHEN turn IS NULL THEN 'orphan' WHEN result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  coalesce(level, -1)::BIGINT AS level, coalesce(errors = '', FALSE) AS valid, coalesce(errors, '') AS errors,
  sha256(CASE WHEN turn IS NULL THEN '{"id":"call_' || asked || '","result":' || to_json(answer)::VARCHAR || '}'
    ELSE '{"arguments":{"text":' || to_json(question)::VARCHAR || ',"turn":' || turn || '},"id":"call_' || asked || '","name":"reply"'
      || CASE WHEN result_turn IS NULL THEN '' ELSE ',"result":' || to_json(answer)::VARCHAR END || '}' END) AS canonical_sha256
FROM e
"""


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_table

    return media_table(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import key_of, replace_pii

    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark), kinds_column="kinds")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import token_table

    return token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import piece_table

    return piece_table(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import benchmark_matches

    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n_words=2)


def op11_ball_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import clustered

    return clustered(table(spark, sf_dir, "embeddings"))


def _op11_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """The same by comparing every vector with every centroid, a table for each round."""
    nearest = "SELECT v.row, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, arg_min(c.k, (c.d, c.k)) AS k, min(c.d) AS d FROM v, LATERAL (SELECT k, list_sum(list_transform(list_zip(v.x, x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM c{0}) c GROUP BY v.row"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1)::INTEGER AS k, x FROM v ORDER BY sha256('3:' || vec_id), x LIMIT {k})",
    ]
    for i in range(rounds):
        steps += [
            f"a{i} AS MATERIALIZED ({nearest.format(i)})",
            f"p{i} AS (SELECT k, unnest(x) AS value, unnest(range({dims})) AS place FROM a{i})",
            f"s{i} AS (SELECT k, place, sum(value)::BIGINT AS total, count(*) AS n FROM p{i} GROUP BY k, place)",
            f"m{i} AS (SELECT k, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY place) AS x FROM s{i} GROUP BY k)",
            f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.k = c.k)",
        ]
    steps += [f"f AS MATERIALIZED ({nearest.format(rounds)})", f"h AS (SELECT k, sha256(array_to_string(x, ',')) AS centroid_sha256 FROM c{rounds})"]
    return f"WITH {', '.join(steps)} SELECT f.vec_id, f.k AS cluster, f.d AS distance, (sum(f.d) OVER (PARTITION BY f.k))::BIGINT AS cluster_inertia, (sum(f.d) OVER ())::BIGINT AS inertia, h.centroid_sha256 FROM f JOIN h ON h.k = f.k"


OP11_SQL = _op11_sql()


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
t AS (SELECT sum(CASE WHEN len(ts) > 0 THEN 1 ELSE 0 END)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d),
p AS (SELECT row, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM d),
f AS (SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY row, term),
w AS (SELECT term, floor(1000.0::DOUBLE * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, t GROUP BY term, n_docs),
s AS (
  SELECT q.item_id, f.row, any_value(f.doc_id) AS doc_id, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (50 + (50 * f.n * t.n_docs) // t.n_terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term), t GROUP BY q.item_id, f.row
),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, row))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_tool_calls": op1_tool_calls,
        "op2_media": op2_media,
        "op3_quality": op3_quality,
        "op4_pii": op4_pii,
        "op5_token_files": op5_token_files,
        "op6_pieces": op6_pieces,
        "op7_toxicity": op7_toxicity,
        "op8_decontamination": op8_decontamination,
        "op9_secrets": op9_secrets,
        "op10_near_duplicates": op10_near_duplicates,
        "op11_ball_trees": op11_ball_trees,
        "op12_mixing": op12_mixing,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_tool_calls": OP1_SQL, "op11_ball_trees": OP11_SQL, "op13_lexical_search": OP13_SQL}
