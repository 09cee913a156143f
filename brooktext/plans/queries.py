"""The registered queries of the library's own operators, and their SQL.

Each query reads whole tables. Texts of the two-label form are built from table texts, on both sides alike, as the
tables hold none. Doubles are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions.responses import REWRITE_LABEL, WORDS_LABEL, parsed, score
from ..functions.rounding import exact_round3, exact_round3_sql
from ..functions.text import before_end_mark, punctuation_class, split_white, text, tokens, unsegmented, words
from ..operators import batches as B
from ..operators import judging as J
from ..operators import vocabulary as V
from ..operators.checkpoints import latest
from ..operators.metrics import SERIES, scalar_series
from ..operators.models import precomputed
from ..operators.reward import batch_means, blended, half_up
from ..operators.segmentation import by_dictionary
from ..operators.similarity import paired_similarity
from ..operators.tables import new_folder, written_once
from ..sources.files import LINE_ORDER, read_corpus, read_dictionary, vocabulary_of
from .config import Settings
from .run import run
from .scoring import polled_filter, polled_judge, scored_responses, step_statistics, stored_pair_scores

BATCH, SALT, SETTINGS = 4, "epoch-1", Settings()
#: Words that `membership` asks for.
ASKED = ("the", "and", "of", "est", "und", "que", "absent-word", "Der", "la", "in", "is", "")
INSTRUCTIONS = {"similarity": "\nScore how alike the two are, from -1 to 1.", "expression": "\n1.0 if literal, 0.0 if figurative.", "vocabulary": "\nLeave out names and punctuation."}
MODELS = ("base", "tuned")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of documents, dealt over the cores."""
    return V.spread(_read(spark, sf_dir, "documents").select(*columns))


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.words_of(_read(spark, sf_dir, "benchmark"))


def _six(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# SQL that several queries share. PUNCTUATION and white space are as in functions.text; the tables have no white space
# but blanks, tabs and newlines.
def sql_words(column: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(coalesce({column}, ''), '{punctuation_class()}', ' ', 'g'), '\\s+'), lambda w: w <> '')"


def sql_tokens(column: str) -> str:
    return f"list_distinct({sql_words(column)})"


SQL_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
SQL_VOCABULARY = f"vocabulary AS (SELECT DISTINCT unnest({sql_tokens('text')}) AS word FROM benchmark)"
SQL_COVERAGE = f"""
toks AS (SELECT doc_id, {sql_tokens('text')} AS ts FROM documents),
hits AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(ts) AS word FROM toks) JOIN vocabulary USING (word) GROUP BY doc_id),
coverage AS (
  SELECT doc_id, len(ts)::BIGINT AS n_tokens, coalesce(n, 0)::BIGINT AS n_matched,
    CASE WHEN len(ts) > 0 THEN coalesce(n, 0)::DOUBLE / len(ts) ELSE 0.0 END AS coverage
  FROM toks LEFT JOIN hits USING (doc_id)
)"""


def vocab_build(spark, sf_dir):
    rows = _read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(words(text("text"))).alias("pos", "word"))
    entries = rows.withColumn("meaning", F.array(F.concat(F.lit("～ of item "), F.col("item_id").cast("string")), F.concat(F.lit("place "), F.col("pos").cast("string"))))
    return vocabulary_of(entries, "item_id", "pos").select("word", F.array_join("meaning", "; ").alias("meaning"))


VOCAB_BUILD = f"""
WITH w AS (SELECT item_id, {sql_words('text')} AS ws FROM benchmark),
e AS (SELECT item_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM w)
SELECT word, arg_max(replace('～ of item ' || item_id, '～', word) || '; place ' || pos, (item_id, pos)) AS meaning FROM e GROUP BY word
"""


def token_extract(spark, sf_dir):
    found = _texts(spark, sf_dir, "doc_id", "text").select("doc_id", F.array_sort(tokens(text("text"))).alias("ts"))
    return found.select("doc_id", F.size("ts").cast("long").alias("n_tokens"), F.md5(F.array_join("ts", " ")).alias("tokens_md5"))


TOKEN_EXTRACT = f"SELECT doc_id, len(ts)::BIGINT AS n_tokens, md5(array_to_string(list_sort(ts), ' ')) AS tokens_md5 FROM (SELECT doc_id, {sql_tokens('text')} AS ts FROM documents)"


def token_cap(spark, sf_dir):
    """The first tokens of each text, up to the cap of a prompt."""
    parts = F.filter(split_white(text("text")), lambda w: w != "")
    return _texts(spark, sf_dir, "doc_id", "text").select("doc_id", F.slice(parts, 1, SETTINGS.prompt_tokens).alias("ts")).select("doc_id", F.size("ts").cast("long").alias("n_kept"), F.md5(F.array_join("ts", " ")).alias("kept_md5"))


TOKEN_CAP = f"SELECT doc_id, len(ts)::BIGINT AS n_kept, md5(array_to_string(ts, ' ')) AS kept_md5 FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')[1:{SETTINGS.prompt_tokens}] AS ts FROM documents)"


def vocab_coverage(spark, sf_dir):
    out = V.coverage(_texts(spark, sf_dir, "doc_id", "text"), _vocabulary(spark, sf_dir))
    return out.withColumn("coverage", _six("coverage"))


VOCAB_COVERAGE = f"WITH {SQL_VOCABULARY}, {SQL_COVERAGE} SELECT doc_id, n_tokens, n_matched, round(coverage, 6) AS coverage FROM coverage"


def match_words(spark, sf_dir):
    out = V.matched_words(_texts(spark, sf_dir, "doc_id", "text"), _vocabulary(spark, sf_dir))
    return out.select("doc_id", F.array_join("words", " ").alias("words"))


MATCH_WORDS = f"WITH {SQL_VOCABULARY} SELECT doc_id, string_agg(word, ' ' ORDER BY word) AS words FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS word FROM documents) JOIN vocabulary USING (word) GROUP BY doc_id"


def membership(spark, sf_dir):
    return V.membership(spark.createDataFrame([(w,) for w in ASKED], "word string"), _vocabulary(spark, sf_dir))


MEMBERSHIP = f"WITH {SQL_VOCABULARY} SELECT w.word, v.word IS NOT NULL AS present FROM (VALUES {', '.join(f'({w!r})' for w in ASKED)}) w(word) LEFT JOIN vocabulary v ON w.word = v.word"


def _neighbours(spark, sf_dir):
    """Each vector with the one of the next id: all of the table, in pairs."""
    e = _read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")


SQL_NEIGHBOURS = "p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), s AS (SELECT vec_id, CASE WHEN list_dot_product(x, x) = 0 OR list_dot_product(y, y) = 0 THEN NULL ELSE list_cosine_similarity(x, y) END AS c FROM p)"


def cosine_normalized(spark, sf_dir):
    return paired_similarity(_neighbours(spark, sf_dir)).select("vec_id", _six("score").alias("score"))


COSINE_NORMALIZED = f"WITH {SQL_NEIGHBOURS} SELECT vec_id, round(coalesce((c + 1) / 2, 0), 6) AS score FROM s"


def cosine_raw(spark, sf_dir):
    return paired_similarity(_neighbours(spark, sf_dir)).select("vec_id", _six("cosine").alias("cosine"))


COSINE_RAW = f"WITH {SQL_NEIGHBOURS} SELECT vec_id, round(coalesce(c, 0), 6) AS cosine FROM s"


def response_parse(spark, sf_dir):
    t, k = text("text"), F.pmod(F.col("turn"), F.lit(4))
    both = F.concat(F.lit(f"1. {REWRITE_LABEL}："), t, F.lit(f"\n2. {WORDS_LABEL}：  "), t, F.lit(" \n"))
    made = F.when(k == 0, both).when(k == 1, F.concat(F.lit(" "), t, F.lit("\nlast words\n"))).when(k == 2, F.concat(F.lit(f"1.{REWRITE_LABEL}: "), t)).otherwise(F.concat(F.lit(f"2. {WORDS_LABEL}："), t))
    rewrite, words = parsed(made)
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", rewrite.alias("rewrite"), words.alias("words"))


RESPONSE_PARSE = rf"""
WITH m AS (
  SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '1. {REWRITE_LABEL}：' || t || chr(10) || '2. {WORDS_LABEL}：  ' || t || ' ' || chr(10) WHEN 1 THEN ' ' || t || chr(10) || 'last words' || chr(10)
    WHEN 2 THEN '1.{REWRITE_LABEL}: ' || t ELSE '2. {WORDS_LABEL}：' || t END AS r
  FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)
),
f AS (SELECT *, {SQL_STRIP.format('r')} AS whole, regexp_replace(regexp_extract(r, '(?s)1\.\s*{REWRITE_LABEL}[：:\s]*(.*?)(?:\s*2\.|\s*{WORDS_LABEL}|$)', 1), '^\s+|\s+$', '', 'g') AS a,
  regexp_replace(regexp_extract(r, '(?s)2\.\s*{WORDS_LABEL}[：:\s]*(.*)', 1), '^\s+|\s+$', '', 'g') AS b FROM m),
g AS (SELECT *, CASE WHEN b = '' THEN regexp_replace(string_split(whole, chr(10))[-1], '^\s+|\s+$', '', 'g') ELSE b END AS words FROM f)
SELECT conv_id, turn, CASE WHEN a <> '' THEN a WHEN words <> '' THEN regexp_replace(replace(whole, words, ''), '^\s+|\s+$', '', 'g') ELSE whole END AS rewrite, words FROM g
"""


def _reply() -> Column:
    k, d = F.pmod("event_id", F.lit(8)), F.pmod("event_id", F.lit(10)).cast("string")
    return (
        F.when(k == 0, F.concat(F.lit("0."), d)).when(k == 1, F.concat(F.lit("score: -0."), d, d)).when(k == 2, F.concat(F.lit("1"), d, F.lit("0")))
        .when(k == 3, F.concat(F.lit("item 1: 0."), d)).when(k == 4, F.col("props")).when(k == 5, F.lit("1:0")).when(k == 6, F.lit("-1.0, surely")).otherwise(F.concat(F.lit("."), d))
    )


SQL_REPLY = "CASE event_id % 8 WHEN 0 THEN '0.' || event_id % 10 WHEN 1 THEN 'score: -0.' || event_id % 10 || event_id % 10 WHEN 2 THEN '1' || event_id % 10 || '0' WHEN 3 THEN 'item 1: 0.' || event_id % 10 WHEN 4 THEN props WHEN 5 THEN '1:0' WHEN 6 THEN '-1.0, surely' ELSE '.' || event_id % 10 END"
SQL_SCORE = r"greatest(-1.0::DOUBLE, least(1.0::DOUBLE, coalesce(try_cast(trim(replace(regexp_extract({0}, '-?0\.[0-9]|-?1(?:.0)?|0', 0), '_', '')) AS DOUBLE), 0.0)))"


def score_parse(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", _six(score(_reply())).alias("score"))


SCORE_PARSE = f"SELECT event_id, round({SQL_SCORE.format(SQL_REPLY)}, 6) AS score FROM events"


def _attempts(spark, sf_dir, content: Column | None = None) -> DataFrame:
    """Events as attempts of a task for each user; few events end a task. content: what comes back, a judge's reply by default."""
    ended = F.when((F.col("event_type") == "purchase") & (F.col("value") > 150), "SUCCESS").when((F.col("event_type") == "error") & (F.col("value") > 220), "FAILED").when((F.col("event_type") == "signup") & (F.col("value") > 250), "ERROR")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.floor(F.col("user_id") / 4).alias("batch_id"), order.cast("long").alias("attempt"), F.coalesce(ended, F.lit("PROCESSING")).alias("status"), F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit(" ")).otherwise(_reply() if content is None else content).alias("content"))


SQL_ATTEMPTS = f"""
attempts AS (
  SELECT user_id AS task_id, user_id // 4 AS batch_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt,
    CASE WHEN event_type = 'purchase' AND value > 150 THEN 'SUCCESS' WHEN event_type = 'error' AND value > 220 THEN 'FAILED' WHEN event_type = 'signup' AND value > 250 THEN 'ERROR' ELSE 'PROCESSING' END AS status,
    CASE WHEN event_id % 3 = 0 THEN ' ' ELSE {SQL_REPLY} END AS content
  FROM events
),
polls AS (SELECT * FROM attempts WHERE attempt <= 40)"""


def poll_scores(spark, sf_dir):
    return J.polled_scores(_attempts(spark, sf_dir)).withColumn("score", _six("score"))


POLL_SCORES = f"""
WITH {SQL_ATTEMPTS},
f AS (SELECT task_id, arg_min(status, attempt) AS status, min(attempt) AS attempt, arg_min(content, attempt) AS content FROM polls WHERE status <> 'PROCESSING' GROUP BY task_id)
SELECT t.task_id, coalesce(f.status, 'UNRESOLVED') AS status, coalesce(f.attempt, 0)::BIGINT AS attempt,
  round(CASE WHEN f.status IS NULL THEN 0.01 WHEN f.status = 'SUCCESS' THEN {SQL_SCORE.format('f.content')} ELSE 0.0 END, 6) AS score
FROM (SELECT DISTINCT task_id FROM attempts) t LEFT JOIN f USING (task_id)
"""


def poll_text(spark, sf_dir):
    return J.polled_texts(_attempts(spark, sf_dir))


POLL_TEXT = f"""
WITH {SQL_ATTEMPTS},
told AS (SELECT *, CASE status WHEN 'SUCCESS' THEN {SQL_STRIP.format('content')} WHEN 'FAILED' THEN 'Error processing ' || task_id WHEN 'ERROR' THEN 'API Error: ' || content ELSE '' END AS told FROM polls),
first AS (SELECT batch_id, task_id, min(attempt) AS at, arg_min(status, attempt) AS status, arg_min(told, attempt) AS told FROM told WHERE told <> '' GROUP BY ALL),
waiting AS (SELECT DISTINCT p.batch_id, p.attempt FROM polls p LEFT JOIN first f USING (batch_id, task_id) WHERE p.status = 'PROCESSING' AND (f.at IS NULL OR p.attempt < f.at)),
run AS (SELECT batch_id, max(attempt) + 1 AS last FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY attempt) AS n FROM waiting) WHERE attempt = n GROUP BY batch_id)
SELECT t.batch_id, t.task_id, CASE WHEN f.at <= coalesce(r.last, 1) THEN f.status ELSE 'UNRESOLVED' END AS status, CASE WHEN f.at <= coalesce(r.last, 1) THEN f.told ELSE '' END AS result
FROM (SELECT DISTINCT batch_id, task_id FROM attempts) t LEFT JOIN first f USING (batch_id, task_id) LEFT JOIN run r USING (batch_id)
"""


def poll_rounds(spark, sf_dir):
    return J.all_done(_attempts(spark, sf_dir)).select("batch_id", "attempt", "done")


POLL_ROUNDS = f"WITH {SQL_ATTEMPTS} SELECT batch_id, attempt, bool_and(status <> 'PROCESSING') AS done FROM attempts GROUP BY batch_id, attempt"


def _blend(spark, sf_dir, **how) -> DataFrame:
    judged = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("expression"))
    rows = V.coverage(_texts(spark, sf_dir, "doc_id", "text"), _vocabulary(spark, sf_dir)).select("doc_id", "coverage").join(judged, "doc_id")
    return rows.withColumn("reward", blended(F.col("coverage"), F.col("expression"), **how))


SQL_BLEND = f"WITH {SQL_VOCABULARY}, {SQL_COVERAGE}, blend AS (SELECT doc_id, coverage, quality::DOUBLE AS expression, round(round(coverage, 3) * 0.6::DOUBLE + round(quality::DOUBLE, 3) * 0.4::DOUBLE, 3) AS reward FROM coverage JOIN labels USING (doc_id))"


def reward_blend(spark, sf_dir):
    return _blend(spark, sf_dir, rounded=half_up).select("doc_id", F.round("coverage", 3).alias("wb"), F.round("expression", 3).alias("expr"), "reward")


REWARD_BLEND = f"{SQL_BLEND} SELECT doc_id, round(coverage, 3) AS wb, round(expression, 3) AS expr, reward FROM blend"


def reward_blend_exact(spark, sf_dir):
    """The reward by exact rounding, and what it rounds: coverage, expression, and sixteenths, half of which lie on ties."""
    rows = _blend(spark, sf_dir).withColumn("tie", F.pmod("doc_id", F.lit(64)) / 16.0)
    return rows.select("doc_id", exact_round3(F.col("coverage")).alias("wb"), exact_round3(F.col("expression")).alias("expr"), exact_round3(F.col("tie")).alias("tie"), "reward")


SQL_EXACT = {c: exact_round3_sql(c) for c in ("coverage", "expression", "(doc_id % 64) / 16.0::DOUBLE")}
REWARD_BLEND_EXACT = f"""
{SQL_BLEND}, e AS (SELECT doc_id, {SQL_EXACT['coverage']} AS wb, {SQL_EXACT['expression']} AS expr, {SQL_EXACT['(doc_id % 64) / 16.0::DOUBLE']} AS tie FROM blend)
SELECT doc_id, wb, expr, tie, round(wb * 0.6::DOUBLE + expr * 0.4::DOUBLE, 3) AS reward FROM e
"""


def batch_mean(spark, sf_dir):
    ids = _read(spark, sf_dir, "documents").select("doc_id").join(_read(spark, sf_dir, "labels").select("doc_id"), "doc_id")  # what is dealt into batches needs no text
    batches = B.fixed_batches(ids, F.concat(F.col("doc_id").cast("string"), F.lit(SALT)), BATCH).select("doc_id", "batch_id")
    rows = _blend(spark, sf_dir, rounded=half_up).join(batches, "doc_id")
    return batch_means(rows).select("batch_id", *(_six(c).alias(c) for c in ("avg_coverage", "avg_expression", "avg_reward")), "n")


BATCH_MEANS = f"""
{SQL_BLEND}, o AS (SELECT *, (row_number() OVER (ORDER BY md5(doc_id || '{SALT}')) - 1) // {BATCH} AS batch_id FROM blend)
SELECT batch_id, round(avg(coverage), 6) AS avg_coverage, round(avg(expression), 6) AS avg_expression, round(avg(reward), 6) AS avg_reward, count(*) AS n FROM o GROUP BY batch_id HAVING count(*) = {BATCH}
"""


def _turn_key() -> Column:
    return F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.lit(SALT))


SQL_BATCHES = f"b AS (SELECT *, row_number() OVER (ORDER BY md5(conv_id || '-' || turn || '-{SALT}')) - 1 AS idx FROM conversations), c AS (SELECT *, idx // {BATCH} AS batch_id, idx % {BATCH} AS pos, idx // {BATCH} + 1 AS step FROM b WHERE idx // {BATCH} < (SELECT count(*) FROM conversations) // {BATCH})"


def fixed_batches(spark, sf_dir):
    return B.fixed_batches(_read(spark, sf_dir, "conversations"), _turn_key(), BATCH).select("conv_id", "turn", "batch_id", "pos", "step")


FIXED_BATCHES = f"WITH {SQL_BATCHES} SELECT conv_id, turn, batch_id, pos, step FROM c"


def collate(spark, sf_dir):
    rows = B.fixed_batches(_read(spark, sf_dir, "conversations").withColumn("text", text("text")), _turn_key(), BATCH)
    out = B.collated(rows, "role", "text")
    return out.select("batch_id", F.array_join("role", ",").alias("roles"), F.md5(F.array_join("text", "|")).alias("texts_md5"), F.size("text").cast("long").alias("n"))


COLLATE = f"WITH {SQL_BATCHES} SELECT batch_id, string_agg(role, ',' ORDER BY pos) AS roles, md5(string_agg(coalesce(text, ''), '|' ORDER BY pos)) AS texts_md5, count(*) AS n FROM c GROUP BY batch_id"


def logged_steps(spark, sf_dir):
    """The batches after which a checkpoint is due."""
    rows = B.fixed_batches(_read(spark, sf_dir, "conversations"), _turn_key(), BATCH)
    return B.every(rows.select("step").distinct(), "step", SETTINGS.save_every)


LOGGED_STEPS = f"WITH {SQL_BATCHES} SELECT DISTINCT step FROM c WHERE step % {SETTINGS.save_every} = 0"


def pair_zip(spark, sf_dir):
    return B.turn_pairs(_read(spark, sf_dir, "conversations"))


SQL_PAIRS = "p AS (SELECT u.conv_id, u.turn, u.text AS original, a.text AS response FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"
PAIR_ZIP = f"WITH {SQL_PAIRS} SELECT * FROM p"


def chat_render(spark, sf_dir):
    """A conversation's messages in their order as one text; the text is what is asked for, so its messages meet."""
    rows = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", text("text").alias("content")))).alias("ms"))
    return rows.select("conv_id", P.rendered_chat(F.col("ms")).alias("rendered"))


CHAT_RENDER = "SELECT conv_id, '[gMASK]<sop>' || string_agg(CASE WHEN coalesce(text, '') = '' THEN '' ELSE '<|' || role || '|>' || chr(10) || text END, '' ORDER BY turn) || '<|assistant|>' AS rendered FROM conversations GROUP BY conv_id"


def chat_pair(spark, sf_dir):
    """System and user message of a request, rendered."""
    c = P.chat(F.lit(INSTRUCTIONS["vocabulary"].strip()), F.col("text"))
    return _read(spark, sf_dir, "benchmark").select("item_id", F.size(c).cast("long").alias("n"), P.rendered_chat(c).alias("rendered"))


CHAT_PAIR = f"SELECT item_id, 2::BIGINT AS n, '[gMASK]<sop><|system|>' || chr(10) || '{INSTRUCTIONS['vocabulary'].strip()}' || CASE WHEN coalesce(text, '') = '' THEN '' ELSE '<|user|>' || chr(10) || text END || '<|assistant|>' AS rendered FROM benchmark"


def judge_prompts(spark, sf_dir):
    o, r = F.col("original"), F.col("response")
    return B.turn_pairs(_read(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", P.judge_prompt(INSTRUCTIONS["similarity"], o, r).alias("similarity"), P.judge_prompt(INSTRUCTIONS["expression"], r).alias("expression"),
        P.judge_prompt(INSTRUCTIONS["vocabulary"], F.array_join(tokens(text(r)), " ")).alias("vocabulary"),
    )


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


JUDGE_PROMPTS = f"""
WITH {SQL_PAIRS}
SELECT conv_id, turn, coalesce(original, '') || coalesce(response, '') || {_sql_text(INSTRUCTIONS['similarity'])} AS similarity, coalesce(response, '') || {_sql_text(INSTRUCTIONS['expression'])} AS expression,
  (SELECT coalesce(string_agg(w, ' ' ORDER BY i), '') FROM (SELECT w, min(i) AS i FROM (SELECT unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT {sql_words('response')} AS ws)) GROUP BY w)) || {_sql_text(INSTRUCTIONS['vocabulary'])} AS vocabulary
FROM p
"""
_STATISTIC_OF = {"click": "ppo/loss/policy", "view": "ppo/loss/value", "error": "objective/kl", "purchase": "custom/reward", "signup": "custom/wordbank"}


def metrics_unpivot(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 50).alias("step"), "event_type").agg(F.avg("value").alias("v"))
    name = F.create_map(*(F.lit(x) for kv in _STATISTIC_OF.items() for x in kv))
    named = rows.select("step", F.try_element_at(name, F.col("event_type")).alias("k"), "v").where("k is not null")
    stats = named.groupBy("step").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("stats"))
    return scalar_series(stats).withColumn("value", _six("value"))


METRICS_UNPIVOT = f"""
WITH a AS (SELECT event_id // 50 AS step, event_type, avg(value) AS v FROM events GROUP BY ALL),
n(event_type, k) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _STATISTIC_OF.items())}),
t(tag, k) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in SERIES.items())}),
s AS (SELECT step, k, v FROM a JOIN n USING (event_type))
SELECT d.step, t.tag, round(coalesce(s.v, 0.0), 6) AS value FROM (SELECT DISTINCT step FROM s) d CROSS JOIN t LEFT JOIN s ON s.step = d.step AND s.k = t.k
"""


def latest_checkpoint(spark, sf_dir):
    k, i = F.pmod("event_id", F.lit(5)), F.col("event_id").cast("string")
    name = F.when(k == 0, F.concat(F.lit("old-checkpoint-"), i)).when(k == 1, F.concat(F.lit("checkpoint-"), i, F.lit("-final"))).when(k == 2, F.concat(F.lit("model-"), i)).otherwise(F.concat(F.lit("checkpoint-"), i))
    return latest(_read(spark, sf_dir, "events").select(name.alias("name")))


LATEST_CHECKPOINT = """
WITH n AS (SELECT CASE event_id % 5 WHEN 0 THEN 'old-checkpoint-' || event_id WHEN 1 THEN 'checkpoint-' || event_id || '-final' WHEN 2 THEN 'model-' || event_id ELSE 'checkpoint-' || event_id END AS name FROM events),
s AS (SELECT name, try_cast(string_split(name, '-')[-1] AS BIGINT) AS step FROM n WHERE contains(name, 'checkpoint-'))
SELECT arg_max(name, (step, name)) AS name, coalesce(max(step), 0) AS step FROM s WHERE step IS NOT NULL
"""


def ab_cross(spark, sf_dir):
    """Every item under every model: prompt, and the answer cut out of a recorded output. The models are a constant few."""
    models = F.explode(F.array(*map(F.lit, MODELS))).alias("model")
    answer = before_end_mark(F.concat(F.lit(" \n"), F.col("model"), F.lit(": "), text("text"), F.lit(" </s> more</s>")))
    return _read(spark, sf_dir, "benchmark").select("item_id", "text", models).select("item_id", "model", F.md5(P.inference_prompt(F.col("text"))).alias("prompt_md5"), answer.alias("answer"))


AB_CROSS = f"""
SELECT item_id, model, md5({_sql_text(f"{chr(10)}<|system|>{chr(10)}{P.INNER_PROMPT}{chr(10)}<|user|>{chr(10)}用户输入：")} || coalesce(text, '') || {_sql_text(f"{chr(10)}<|assistant|>{chr(10)}输出：{chr(10)}")}) AS prompt_md5,
  {SQL_STRIP.format("string_split(' ' || chr(10) || model || ': ' || coalesce(text, '') || ' </s> more</s>', '</s>')[1]")} AS answer
FROM benchmark CROSS JOIN (VALUES {', '.join(f"('{m}')" for m in MODELS)}) m(model)
"""


def _response(id_col: str = "doc_id") -> Column:
    return F.concat(F.lit(f"1. {REWRITE_LABEL}："), F.col(id_col).cast("string"), F.lit(f"\n2. {WORDS_LABEL}："), text("text"))


def _recorded_judge(spark, sf_dir, key: str):
    """A stub that reads labels, 0.01 where there is none."""
    judged = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias(key), F.col("quality").cast("double").alias("expression"))
    return lambda df: precomputed(judged, [key], "expression")(df).withColumn("expression", F.coalesce("expression", F.lit(0.01)))


def scoring_loop(spark, sf_dir):
    """The whole loop on recorded responses: parse, cover, judge (a stub that reads labels), blend, batch, unpivot. What is dealt into batches is ids: no text is shuffled."""
    docs = _texts(spark, sf_dir, "doc_id", "text")
    batches = B.fixed_batches(_read(spark, sf_dir, "documents").select("doc_id"), F.concat(F.col("doc_id").cast("string"), F.lit(SALT)), BATCH).select(F.col("doc_id").alias("id"), "batch_id")
    scored = scored_responses(docs.select(F.col("doc_id").alias("id"), _response().alias("response")), _vocabulary(spark, sf_dir), _recorded_judge(spark, sf_dir, "id"), rounded=half_up, key="id")
    rows = scored.select("id", "coverage", "expression", "reward").join(batches, "id")
    return scalar_series(step_statistics(rows)).withColumn("value", _six("value"))


SCORING_LOOP = f"""
WITH {SQL_VOCABULARY},
o AS (SELECT doc_id, (row_number() OVER (ORDER BY md5(doc_id || '{SALT}')) - 1) // {BATCH} AS batch_id, CASE WHEN {SQL_STRIP.format("coalesce(text, '')")} = '' THEN '2. {WORDS_LABEL}：' ELSE text END AS text FROM documents),
k AS (SELECT * FROM o WHERE batch_id < (SELECT count(*) FROM documents) // {BATCH}),
toks AS (SELECT doc_id, batch_id, {sql_tokens('text')} AS ts FROM k),
hits AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(ts) AS word FROM toks) JOIN vocabulary USING (word) GROUP BY doc_id),
c AS (SELECT batch_id, CASE WHEN len(ts) > 0 THEN coalesce(n, 0)::DOUBLE / len(ts) ELSE 0.0 END AS coverage, coalesce(quality::DOUBLE, 0.01) AS expression FROM toks LEFT JOIN hits USING (doc_id) LEFT JOIN labels USING (doc_id)),
m AS (SELECT batch_id + 1 AS step, avg(coverage) AS w, avg(expression) AS e, avg(round(round(coverage, 3) * 0.6::DOUBLE + round(expression, 3) * 0.4::DOUBLE, 3)) AS r FROM c GROUP BY batch_id)
SELECT step, tag, round(CASE tag WHEN 'Reward/Average' THEN r WHEN 'Reward/Wordbank' THEN w WHEN 'Reward/Expression' THEN e ELSE 0.0 END, 6) AS value FROM m CROSS JOIN (VALUES {', '.join(f"('{t}')" for t in SERIES)}) t(tag)
"""


def judge_loop(spark, sf_dir):
    """Responses judged by a service for their likeness to the text: parse, cover, prompts, polled attempts (events stand in for the service), blend."""
    responses = _texts(spark, sf_dir, "doc_id", "text").select(F.col("doc_id").alias("id"), "text", _response().alias("response"))
    recorded = _attempts(spark, sf_dir).withColumnRenamed("task_id", "id")
    judge = polled_judge(lambda prompts: recorded.join(prompts.select("id"), "id", "left_semi"), INSTRUCTIONS["similarity"], "text", "rewrite", key="id")
    scored = scored_responses(responses, _vocabulary(spark, sf_dir), judge, rounded=half_up, key="id")
    return scored.select("id", F.round("coverage", 3).alias("wb"), _six("expression").alias("expr"), "reward")


JUDGE_LOOP = f"""
WITH {SQL_ATTEMPTS},
f AS (SELECT task_id, arg_min(status, attempt) AS status, arg_min(content, attempt) AS content FROM polls WHERE status <> 'PROCESSING' GROUP BY task_id),
{SQL_VOCABULARY},
o AS (SELECT doc_id, CASE WHEN {SQL_STRIP.format("coalesce(text, '')")} = '' THEN '2. {WORDS_LABEL}：' ELSE text END AS text FROM documents),
toks AS (SELECT doc_id, {sql_tokens('text')} AS ts FROM o),
hits AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(ts) AS word FROM toks) JOIN vocabulary USING (word) GROUP BY doc_id),
c AS (
  SELECT doc_id AS id, CASE WHEN len(ts) > 0 THEN coalesce(n, 0)::DOUBLE / len(ts) ELSE 0.0 END AS w,
    CASE WHEN f.status IS NULL THEN 0.01::DOUBLE WHEN f.status = 'SUCCESS' THEN {SQL_SCORE.format('f.content')} ELSE 0.0::DOUBLE END AS e
  FROM toks LEFT JOIN hits USING (doc_id) LEFT JOIN f ON f.task_id = doc_id
)
SELECT id, round(w, 3) AS wb, round(e, 6) AS expr, round(round(w, 3) * 0.6::DOUBLE + round(e, 3) * 0.4::DOUBLE, 3) AS reward FROM c
"""


def _kept_words() -> Column:
    return F.concat(F.lit("The of und, x"), F.pmod("event_id", F.lit(7)).cast("string"), F.lit(" est "))


#: Users whose events stand in for the service: a document asks the one of its number, modulo this.
ASKED_USERS = 100


def reward_loop(spark, sf_dir):
    """The training loop's own scoring: the judge filters each response's words, what it leaves is covered, it scores the rewrite's expression, and the
    exactly rounded scores are blended. Events stand in for the service, of one user for the filter and of the next for the scores."""
    docs = _texts(spark, sf_dir, "doc_id", "text").select(F.col("doc_id").alias("id"), _response().alias("response"))
    batches = B.fixed_batches(_read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), F.concat(F.col("id").cast("string"), F.lit(SALT)), BATCH).select("id", "batch_id")

    def service(recorded: DataFrame, shift: int):
        one = lambda prompts: F.pmod(F.col("id") + shift, F.lit(ASKED_USERS)).alias("user")
        return lambda prompts: prompts.select("id", "batch_id", one(prompts)).join(recorded.drop("batch_id").withColumnRenamed("task_id", "user"), "user")

    keep = polled_filter(service(_attempts(spark, sf_dir, _kept_words()), 0), INSTRUCTIONS["vocabulary"], key="id")
    judge = polled_judge(service(_attempts(spark, sf_dir), 1), INSTRUCTIONS["expression"], "rewrite", key="id")
    scored = scored_responses(docs.join(batches, "id"), _vocabulary(spark, sf_dir), judge, keep, key="id")
    return scored.select("id", "batch_id", F.md5("words").alias("words_md5"), _six("coverage").alias("coverage"), _six("expression").alias("expression"), "reward")


REWARD_LOOP = f"""
WITH {SQL_ATTEMPTS}, {SQL_VOCABULARY},
o AS (SELECT doc_id AS id, (row_number() OVER (ORDER BY md5(doc_id || '{SALT}')) - 1) // {BATCH} AS batch_id FROM documents),
k AS (SELECT * FROM o WHERE batch_id < (SELECT count(*) FROM documents) // {BATCH}),
said AS (
  SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt,
    CASE WHEN event_type = 'purchase' AND value > 150 THEN 'SUCCESS' WHEN event_type = 'error' AND value > 220 THEN 'FAILED' WHEN event_type = 'signup' AND value > 250 THEN 'ERROR' ELSE 'PROCESSING' END AS status,
    CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'The of und, x' || event_id % 7 || ' est ' END AS content
  FROM events
),
told AS (
  SELECT k.id, k.batch_id, attempt, status, CASE status WHEN 'SUCCESS' THEN {SQL_STRIP.format('content')} WHEN 'FAILED' THEN 'Error processing ' || k.id WHEN 'ERROR' THEN 'API Error: ' || content ELSE '' END AS told
  FROM k JOIN said ON said.task_id = k.id % {ASKED_USERS} WHERE attempt <= 40
),
first AS (SELECT batch_id, id, min(attempt) AS at, arg_min(told, attempt) AS told FROM told WHERE told <> '' GROUP BY ALL),
waiting AS (SELECT DISTINCT p.batch_id, p.attempt FROM told p LEFT JOIN first f USING (batch_id, id) WHERE p.status = 'PROCESSING' AND (f.at IS NULL OR p.attempt < f.at)),
run AS (SELECT batch_id, max(attempt) + 1 AS last FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY attempt) AS n FROM waiting) WHERE attempt = n GROUP BY batch_id),
w AS (SELECT k.id, k.batch_id, CASE WHEN f.at <= coalesce(r.last, 1) THEN f.told ELSE '' END AS words FROM k LEFT JOIN first f USING (batch_id, id) LEFT JOIN run r USING (batch_id)),
toks AS (SELECT id, {sql_tokens('words')} AS ts FROM w),
hits AS (SELECT id, count(*) AS n FROM (SELECT id, unnest(ts) AS word FROM toks) JOIN vocabulary USING (word) GROUP BY id),
ended AS (SELECT task_id, arg_min(status, attempt) AS status, arg_min(content, attempt) AS content FROM polls WHERE status <> 'PROCESSING' GROUP BY task_id),
c AS (
  SELECT w.id, w.batch_id, md5(w.words) AS words_md5, CASE WHEN len(ts) > 0 THEN coalesce(n, 0)::DOUBLE / len(ts) ELSE 0.0 END AS coverage,
    CASE WHEN e.status IS NULL THEN 0.01::DOUBLE WHEN e.status = 'SUCCESS' THEN {SQL_SCORE.format('e.content')} ELSE 0.0::DOUBLE END AS expression
  FROM w JOIN toks USING (id) LEFT JOIN hits USING (id) LEFT JOIN ended e ON e.task_id = (w.id + 1) % {ASKED_USERS}
),
d AS (SELECT *, {exact_round3_sql('coverage')} AS wb, {exact_round3_sql('expression')} AS expr FROM c)
SELECT id, batch_id, words_md5, round(coverage, 6) AS coverage, round(expression, 6) AS expression, round(wb * 0.6::DOUBLE + expr * 0.4::DOUBLE, 3) AS reward FROM d
"""


def epoch_batches(spark, sf_dir):
    ids = _read(spark, sf_dir, "conversations").select("conv_id", "turn")
    return B.epoch_batches(ids, F.concat_ws("-", "conv_id", "turn"), BATCH, SETTINGS.epochs).select("conv_id", "turn", "epoch", "batch_id", "pos", "step")


EPOCH_BATCHES = f"""
WITH e AS (SELECT conv_id, turn, epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5(conv_id || '-' || turn || 'epoch-' || epoch)) - 1 AS idx FROM conversations, range({SETTINGS.epochs}) r(epoch)),
n AS (SELECT count(*) // {BATCH} AS whole FROM conversations)
SELECT conv_id, turn, epoch::INTEGER AS epoch, idx // {BATCH} AS batch_id, idx % {BATCH} AS pos, epoch * whole + idx // {BATCH} + 1 AS step FROM e, n WHERE idx // {BATCH} < whole
"""

#: Batches of 40, whose mean rewards have six digits at most; the recorded steps learn nothing, so that chunks may be scored together.
RUN, AHEAD = Settings(batch_size=40, epochs=2), 50


def resumable_run(spark, sf_dir):
    """The series that a run over two epochs leaves: batches dealt anew in each, chunks of `save_every` steps committed one by one."""
    docs, folder = _texts(spark, sf_dir, "doc_id", "text"), new_folder(spark, "run")
    run(docs, "doc_id", lambda df: df.withColumn("response", _response()), _vocabulary(spark, sf_dir), _recorded_judge(spark, sf_dir, "doc_id"), folder, RUN, ahead=AHEAD)
    return spark.read.parquet(f"{folder}/series").select("step", "tag", _six("value").alias("value"))


RESUMABLE_RUN = f"""
WITH {SQL_VOCABULARY},
e AS (SELECT doc_id, epoch, CASE WHEN {SQL_STRIP.format("coalesce(text, '')")} = '' THEN '2. {WORDS_LABEL}：' ELSE text END AS text, row_number() OVER (PARTITION BY epoch ORDER BY md5(doc_id || 'epoch-' || epoch)) - 1 AS idx FROM documents, range({RUN.epochs}) r(epoch)),
n AS (SELECT count(*) // {RUN.batch_size} AS whole FROM documents),
toks AS (SELECT doc_id, epoch, epoch * whole + idx // {RUN.batch_size} + 1 AS step, {sql_tokens('text')} AS ts FROM e, n WHERE idx // {RUN.batch_size} < whole),
hits AS (SELECT doc_id, epoch, count(*) AS n FROM (SELECT doc_id, epoch, unnest(ts) AS word FROM toks) JOIN vocabulary USING (word) GROUP BY ALL),
c AS (SELECT step, CASE WHEN len(ts) > 0 THEN coalesce(n, 0)::DOUBLE / len(ts) ELSE 0.0 END AS coverage, coalesce(quality::DOUBLE, 0.01) AS expression FROM toks LEFT JOIN hits USING (doc_id, epoch) LEFT JOIN labels USING (doc_id)),
d AS (SELECT *, {exact_round3_sql('coverage')} AS wb, {exact_round3_sql('expression')} AS expr FROM c),
m AS (SELECT step, avg(coverage) AS w, avg(expression) AS e, avg(round(wb * 0.6::DOUBLE + expr * 0.4::DOUBLE, 3)) AS r FROM d GROUP BY step)
SELECT step, tag, round(CASE tag WHEN 'Reward/Average' THEN r WHEN 'Reward/Wordbank' THEN w WHEN 'Reward/Expression' THEN e ELSE 0.0 END, 6) AS value FROM m CROSS JOIN (VALUES {', '.join(f"('{t}')" for t in SERIES)}) t(tag)
"""


def segmented_coverage(spark, sf_dir):
    """Turns without blanks and punctuation, cut into words by a dictionary of the benchmark's words and their counts; the share of their words that it has."""
    rows = _read(spark, sf_dir, "benchmark").select(F.explode(words(text("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("weight"))
    dictionary = written_once(rows, "dictionary")
    turns = V.spread(_read(spark, sf_dir, "conversations").select("conv_id", "turn", unsegmented(text("text")).alias("text")))
    cut = written_once(by_dictionary(dictionary)(turns).withColumn("key", F.concat_ws("-", "conv_id", "turn")), "segmented")
    found = V.coverage(cut, dictionary, "key", "segmented")
    return cut.join(found, "key").select("conv_id", "turn", F.md5("segmented").alias("words_md5"), "n_tokens", "n_matched", _six("coverage").alias("coverage"))


# The cheapest path as a recursion over places: of each turn the costs and last words of all places so far. cost and length are one number, so that
# the least one is the cheapest with the longest last word.
SEGMENTED_COVERAGE = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT word, count(*) AS weight FROM (SELECT unnest({sql_words('text')}) AS word FROM benchmark) GROUP BY word),
k AS MATERIALIZED (SELECT word, floor(1000.0::DOUBLE * ln((SELECT sum(weight) FROM d)::DOUBLE / weight))::BIGINT AS cost, length(word) AS n FROM d),
lone AS MATERIALIZED (SELECT floor(1000.0::DOUBLE * ln(sum(weight)::DOUBLE))::BIGINT AS cost FROM d),
t AS MATERIALIZED (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '{punctuation_class()}|\\s', '', 'g') AS s FROM conversations),
p AS (SELECT conv_id, turn, s, unnest(range(1, length(s) + 1)) AS i FROM t),
e AS MATERIALIZED (SELECT conv_id, turn, i, list((k.n, k.cost)) AS edges FROM p, (SELECT DISTINCT n FROM k) l JOIN k ON k.n = l.n AND k.word = substr(p.s, p.i - l.n + 1, l.n) WHERE l.n <= p.i GROUP BY ALL),
lattice AS MATERIALIZED (SELECT p.conv_id, p.turn, p.i, coalesce(e.edges, []) AS edges FROM p LEFT JOIN e USING (conv_id, turn, i)),
r AS (
  SELECT conv_id, turn, 0::BIGINT AS i, [0::BIGINT] AS best, [0::BIGINT] AS last FROM t
  UNION ALL
  SELECT conv_id, turn, i, list_append(best, v // 1024), list_append(last, 1023 - v % 1024) FROM (
    SELECT r.conv_id, r.turn, l.i, r.best, r.last, list_min(list_append(list_transform(l.edges, lambda x: (r.best[l.i - x[1] + 1] + x[2]) * 1024 + 1023 - x[1]), (r.best[l.i] + (SELECT cost FROM lone)) * 1024 + 1022)) AS v
    FROM r JOIN lattice l ON l.conv_id = r.conv_id AND l.turn = r.turn AND l.i = r.i + 1
  )
),
b AS (
  SELECT r.conv_id, r.turn, r.i AS place, r.last, t.s, []::VARCHAR[] AS ws FROM r JOIN t USING (conv_id, turn) WHERE r.i = length(t.s)
  UNION ALL
  SELECT conv_id, turn, place - last[place + 1], last, s, list_prepend(substr(s, place - last[place + 1] + 1, last[place + 1]), ws) FROM b WHERE place > 0
),
w AS (SELECT conv_id, turn, ws, list_distinct(ws) AS ts FROM b WHERE place = 0),
h AS (SELECT conv_id, turn, count(*) AS n FROM (SELECT conv_id, turn, unnest(ts) AS word FROM w) JOIN d USING (word) GROUP BY ALL)
SELECT conv_id, turn, md5(array_to_string(ws, ' ')) AS words_md5, len(ts)::BIGINT AS n_tokens, coalesce(n, 0)::BIGINT AS n_matched,
  round(CASE WHEN len(ts) > 0 THEN coalesce(n, 0)::DOUBLE / len(ts) ELSE 0.0 END, 6) AS coverage
FROM w LEFT JOIN h USING (conv_id, turn)
"""


def dictionary_files(spark, sf_dir):
    """The benchmark's words as dictionary lines in files, read back in blocks: the last line of a word counts."""
    rows = _read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(words(text("text"))).alias("pos", "word"))
    lines = rows.withColumn("meaning", F.array(F.concat(F.lit("～ of item "), F.col("item_id").cast("string")), F.concat(F.lit("place "), F.col("pos").cast("string"))))
    path = new_folder(spark, "dictionary-lines")
    lines.repartitionByRange("item_id", "pos").sortWithinPartitions("item_id", "pos").select("word", "meaning").write.json(path)  # files are named in this order
    return vocabulary_of(read_dictionary(spark, path), *LINE_ORDER).select("word", F.array_join("meaning", "; ").alias("meaning"))


def corpus_files(spark, sf_dir):
    """Turns as JSON arrays in files, of about a thousand turns each, read back by element."""
    rows = _read(spark, sf_dir, "conversations").select(F.to_json(F.struct(text("text").alias("original_sentence"), "role")).alias("json"), F.xxhash64("conv_id", "turn").alias("h"))
    files = max(1, rows.count() // 1000)
    arrays = rows.groupBy(F.pmod("h", F.lit(files)).alias("file")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("json"), ",\n "), F.lit("]")).alias("value"))
    path = new_folder(spark, "corpus-arrays")
    arrays.repartition(files, "file").select("value").write.option("lineSep", "\n\n").text(path)
    return read_corpus(spark, path).groupBy(F.md5("original_sentence").alias("sentence_md5")).agg(F.count("*").alias("n"))


CORPUS_FILES = "SELECT md5(coalesce(text, '')) AS sentence_md5, count(*) AS n FROM conversations GROUP BY 1"


def _slot(conv: Column, turn: Column) -> list[Column]:
    return [F.concat(conv.cast("string"), F.lit("-"), F.floor(turn / BATCH).cast("string")).alias("batch_id"), F.pmod(turn, F.lit(BATCH)).cast("int").alias("pos")]


def stored_pairs(spark, sf_dir):
    """Stored pairs of turns, `BATCH` turns of a conversation to a batch, scored: prompts, polled attempts, slots at 0.01."""
    pairs = B.turn_pairs(_read(spark, sf_dir, "conversations")).select(*_slot(F.col("conv_id"), F.col("turn")), "original", "response")
    recorded = _attempts(spark, sf_dir).select(*_slot(F.floor(F.col("task_id") / 4), F.pmod("task_id", F.lit(4)) * 2), "attempt", "status", "content")
    scores = stored_pair_scores(pairs, lambda prompts: recorded.join(prompts.select("batch_id", "pos"), ["batch_id", "pos"], "left_semi"), INSTRUCTIONS["similarity"], BATCH)
    return scores.select("batch_id", F.col("pos").cast("long").alias("pos"), _six("score").alias("score"))


STORED_PAIRS = f"""
WITH {SQL_ATTEMPTS}, {SQL_PAIRS},
f AS (SELECT task_id, arg_min(status, attempt) AS status, arg_min(content, attempt) AS content FROM polls WHERE status <> 'PROCESSING' GROUP BY task_id),
k AS (SELECT DISTINCT conv_id, turn, conv_id || '-' || turn // {BATCH} AS batch_id, turn % {BATCH} AS pos FROM p),
b AS (SELECT DISTINCT batch_id FROM k),
s AS (
  SELECT batch_id, pos, CASE WHEN f.status IS NULL THEN 0.01::DOUBLE WHEN f.status = 'SUCCESS' THEN {SQL_SCORE.format('f.content')} ELSE 0.0::DOUBLE END AS score
  FROM k LEFT JOIN f ON f.task_id // 4 = conv_id AND f.task_id % 4 * 2 = turn
)
SELECT b.batch_id, g.pos::BIGINT AS pos, round(coalesce(s.score, 0.01::DOUBLE), 6) AS score
FROM b CROSS JOIN (SELECT unnest(range({BATCH})) AS pos) g LEFT JOIN s ON s.batch_id = b.batch_id AND s.pos = g.pos
"""

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "vocab_build": (vocab_build, VOCAB_BUILD),
    "token_extract": (token_extract, TOKEN_EXTRACT),
    "token_cap": (token_cap, TOKEN_CAP),
    "vocab_coverage": (vocab_coverage, VOCAB_COVERAGE),
    "match_words": (match_words, MATCH_WORDS),
    "membership": (membership, MEMBERSHIP),
    "cosine_normalized": (cosine_normalized, COSINE_NORMALIZED),
    "cosine_raw": (cosine_raw, COSINE_RAW),
    "response_parse": (response_parse, RESPONSE_PARSE),
    "score_parse": (score_parse, SCORE_PARSE),
    "poll_scores": (poll_scores, POLL_SCORES),
    "poll_text": (poll_text, POLL_TEXT),
    "poll_rounds": (poll_rounds, POLL_ROUNDS),
    "reward_blend": (reward_blend, REWARD_BLEND),
    "reward_blend_exact": (reward_blend_exact, REWARD_BLEND_EXACT),
    "batch_means": (batch_mean, BATCH_MEANS),
    "fixed_batches": (fixed_batches, FIXED_BATCHES),
    "collate": (collate, COLLATE),
    "logged_steps": (logged_steps, LOGGED_STEPS),
    "pair_zip": (pair_zip, PAIR_ZIP),
    "chat_render": (chat_render, CHAT_RENDER),
    "chat_pair": (chat_pair, CHAT_PAIR),
    "judge_prompts": (judge_prompts, JUDGE_PROMPTS),
    "metrics_unpivot": (metrics_unpivot, METRICS_UNPIVOT),
    "latest_checkpoint": (latest_checkpoint, LATEST_CHECKPOINT),
    "ab_cross": (ab_cross, AB_CROSS),
    "scoring_loop": (scoring_loop, SCORING_LOOP),
    "judge_loop": (judge_loop, JUDGE_LOOP),
    "stored_pairs": (stored_pairs, STORED_PAIRS),
    "reward_loop": (reward_loop, REWARD_LOOP),
    "resumable_run": (resumable_run, RESUMABLE_RUN),
    "epoch_batches": (epoch_batches, EPOCH_BATCHES),
    "segmented_coverage": (segmented_coverage, SEGMENTED_COVERAGE),
    "dictionary_files": (dictionary_files, VOCAB_BUILD),
    "corpus_files": (corpus_files, CORPUS_FILES),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
