import json
import random

import pytest

from brooktext.llm.chat import REPLY, canonical, errors_of, levels, link_tool_calls, turns_as_calls

CALLS = "conv_id long, call_id string, name string, arguments string, needs array<string>, turn long"
RESULTS = "conv_id long, call_id string, content string, turn long"
SCHEMAS = {"add": {"type": "object", "properties": {"x": {"type": "number", "minimum": 0}, "tags": {"type": "array", "items": {"enum": ["a", "b"]}, "maxItems": 2}}, "required": ["x"], "additionalProperties": False}}


def test_canonical():
    assert canonical({"b": [1.0, 1e21, 1e-7, 0.1, -0.0, True, None], "a": "é\n\"/", "€": 1, "\U0001f600": 2}) == '{"a":"é\\n\\"/","b":[1,1e+21,1e-7,0.1,0,true,null],"€":1,"\U0001f600":2}'
    assert canonical({"x": 1e-5}) == '{"x":0.00001}' and canonical(1.5e300) == "1.5e+300"
    rng = random.Random(1)
    for _ in range(500):
        x = rng.choice([rng.random(), rng.random() * 10 ** rng.randint(-12, 25), rng.randint(-(10**9), 10**9)])
        assert json.loads(canonical(x)) == x
    with pytest.raises(ValueError):
        canonical(float("nan"))


def test_errors():
    s = SCHEMAS["add"]
    assert errors_of({"x": 1}, s) == [] and errors_of([], s) == ["$: not of type object"]
    assert errors_of({"x": -1, "y": 1, "tags": ["a", "c", "b"]}, s) == ["$.tags: more than 2", "$.tags[1]: not an allowed value", "$.x: below 0", "$: y isn't allowed"]
    assert errors_of({}, s) == ["$: lacks x"] and errors_of({"x": True}, s) == ["$.x: not of type number"]


def test_levels():
    assert levels(["a", "b", "c", "d"], [[], ["a"], ["a", "b", "zz"], ["c", "c"]]) == [0, 1, 2, 3]
    assert levels(["a", "b", "c", "d"], [["b"], ["a"], ["b"], []]) == [None, None, None, 0]


@pytest.mark.parametrize("together", [1000, 1])
def test_links(spark, together):
    calls = [(1, "a", "add", '{"x":1}', [], 0), (1, "b", "add", '{"x":"1"}', ["a"], 1), (1, "c", "nope", "{}", ["b", "gone"], 2), (1, "d", "add", "{", ["e"], 3), (1, "e", "add", "[1]", ["d"], 4), (1, "a", "add", '{"x":9}', [], 7), (2, "a", "add", '{"x":2}', None, 0), (2, None, "add", "{}", [], 1)]
    results = [(1, "a", "late", 6), (1, "a", "first", 5), (1, "c", None, 5), (1, "zz", "lost", 5), (2, "b", "other", 1), (None, "a", "x", 1)]
    out = link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS, together)
    rows = out.collect()
    assert sorted((repr(r.conv_id), repr(r.call_id), r.status, r.level) for r in rows if None in (r.conv_id, r.call_id)) == [("2", "None", "unanswered", 0), ("None", "'a'", "orphan", None)]
    got = {(r.conv_id, r.call_id): r for r in rows if None not in (r.conv_id, r.call_id)}
    assert {k: (r.status, r.level, r.valid, r.n_results, r.n_missing) for k, r in got.items()} == {
        (1, "a"): ("linked", 0, True, 2, 0), (1, "b"): ("unanswered", 1, False, 0, 0), (1, "c"): ("linked", 2, False, 1, 1), (1, "d"): ("unanswered", None, False, 0, 0),
        (1, "e"): ("unanswered", None, False, 0, 0), (2, "a"): ("unanswered", 0, True, 0, 0), (1, "zz"): ("orphan", None, None, 1, 0), (2, "b"): ("orphan", None, None, 1, 0),
    }
    assert got[1, "a"].canonical == '{"arguments":{"x":1},"id":"a","name":"add","result":"first"}' and got[1, "a"].result_turn == 5
    assert got[1, "c"].errors == "$: no schema for this tool" and got[1, "d"].errors == "$: not JSON" and got[1, "e"].errors == "$: not of type object"


def brute(calls):
    """(conv_id, call_id) -> level, by going over all calls again and again."""
    needs = {}
    for c, i, *_, n, _ in calls:
        needs.setdefault((c, i), [(c, x) for x in n])
    level, more = {}, True
    while more:
        more = False
        for k, ns in needs.items():
            ns = [n for n in ns if n in needs]
            if k not in level and all(n in level for n in ns):
                level[k], more = 1 + max((level[n] for n in ns), default=-1), True
    return level


def test_levels_by_rounds_like_brute_force(spark):
    rng = random.Random(3)
    calls = []
    for conv in range(6):
        for k in range(60):  # chains, joins of several, cycles and calls behind them
            needs = [] if k == 0 else [f"c{rng.randrange(max(0, k - 6), k)}" for _ in range(rng.choice([0, 1, 1, 1, 1, 2, 3]))]
            if conv > 3 and rng.random() < 0.3:
                needs.append(f"c{rng.randrange(60)}")
            calls.append((conv, f"c{k}", "add", "{}", needs, k))
    df = spark.createDataFrame(calls, CALLS).repartition(3)
    want = brute(calls)
    assert 0 < len(want) < len(calls)
    for together in (1, 10_000):
        got = link_tool_calls(df, spark.createDataFrame([], RESULTS), SCHEMAS, together).collect()
        assert {(r.conv_id, r.call_id): r.level for r in got} == {(c, i): want.get((c, i)) for c, i, *_ in calls}


def test_a_very_long_chain_takes_few_rounds(spark):
    n = 30_000
    calls = spark.range(n).selectExpr("7L conv_id", "concat('c', id) call_id", "'add' name", "'{}' arguments", "if(id = 0, array(), array(concat('c', id - 1))) needs", "id turn")
    got = link_tool_calls(calls, spark.createDataFrame([], RESULTS), SCHEMAS)
    assert got.count() == n and got.where("level is null or level <> turn").count() == 0


def test_calls_and_results_are_hash_joined(spark):
    from brooktext.llm import chat

    seen, real = [], chat.persist
    chat.persist = lambda df, name, by=None: (seen.append((name, df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString())), real(df, name, by))[1]
    try:
        link_tool_calls(spark.createDataFrame([(1, "a", "add", "{}", [], 0)], CALLS), spark.createDataFrame([(1, "a", "x", 1)], RESULTS), SCHEMAS)
    finally:
        chat.persist = real
    plan = next(p for name, _, p in seen if name == "chat-linked")
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_odd_arguments(spark):
    loose = {"any": {"type": "object"}, "odd": {"type": "any"}, "ref": {"type": "object", "properties": {"x": {"$ref": "#/x"}}}}
    texts = {"deep": "[" * 60_000, "deep2": '{"a":' * 900 + "1" + "}" * 900, "half": '{"text":"\\ud800"}', "long": '{"n":' + "7" * 5000 + "}", "big": '{"n":1e999}', "quoted": '{"s":"' + "[" * 500 + '"}', "half-key": '{"\\udc00":1}'}
    calls = [(1, k, "any", t, [], i) for i, (k, t) in enumerate(texts.items())] + [(1, "kind", "odd", "{}", [], 90), (1, "ref", "ref", '{"x":1}', [], 91)]
    got = {r.call_id: r for r in link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), loose).collect()}
    assert got["deep"].errors == got["deep2"].errors == "$: nested more than 200 deep"
    assert got["half"].errors == got["half-key"].errors == "$: holds half a surrogate pair" and json.loads(got["half"].canonical)["arguments"] == texts["half"]
    assert got["long"].valid and ("7" * 5000) in got["long"].canonical and got["quoted"].valid
    assert got["big"].errors == "$: holds what isn't a JSON number"
    assert got["kind"].errors == "$: schema type any isn't supported" and got["ref"].errors == "$.x: schema keyword $ref isn't supported"


def test_more_keywords():
    assert errors_of(True, {"enum": [1, 0]}) == ["$: not an allowed value"] and errors_of(1.0, {"const": 1}) == []
    assert errors_of([1, 1.0], {"uniqueItems": True}) == ["$: repeated items"] and errors_of([1, True], {"uniqueItems": True}) == []
    assert errors_of(3, {"exclusiveMinimum": 3}) == ["$: not above 3"] and errors_of(0.3, {"multipleOf": 0.1}) == [] and errors_of(7, {"multipleOf": 2}) == ["$: not a multiple of 2"]
    assert errors_of(1, {"anyOf": [{"type": "string"}, {"minimum": 2}]}) == ["$: doesn't match anyOf"] and errors_of("a", {"oneOf": [{"type": "string"}, {"minLength": 1}]}) == ["$: doesn't match oneOf"]
    assert errors_of({}, {"minProperties": 1, "not": {"type": "object"}}) == ["$: fewer than 1 members", "$: matches what it must not"]
    assert errors_of("x", {"pattern": "y", "title": "t"}) == ["$: schema keyword pattern isn't supported"] and errors_of(1, False) == ["$: nothing is allowed here"]


def test_conversations(spark):
    m = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", None), (1, 3, "user", "x" * 500), (2, 0, "assistant", "alone"), (None, 0, "user", "u"), (3, 0, "USER", None)]
    df = spark.createDataFrame([(*r, 9) for r in m], "conv_id long, turn long, role string, text string, call_id int")
    got = {(r.conv_id, r.call_id): r for r in link_tool_calls(*turns_as_calls(df), REPLY).collect()}
    assert {k: (r.status, r.level, r.errors) for k, r in got.items()} == {(None, "call_0"): ("unanswered", 0, ""), (1, "call_1"): ("linked", 0, ""), (1, "call_3"): ("unanswered", 1, "$.text: longer than 400"), (2, "call_-1"): ("orphan", None, None), (3, "call_0"): ("unanswered", 0, "$.text: shorter than 1")}
    assert link_tool_calls(*turns_as_calls(df.limit(0)), REPLY).count() == 0


def test_like_sql(spark):
    import duckdb

    from brooktext.llm.queries import OP1_SQL, op1_tool_calls

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    cursor = con.execute(OP1_SQL)
    names = sorted(x[0] for x in cursor.description)
    rows = [dict(zip([x[0] for x in cursor.description], r, strict=True)) for r in cursor.fetchall()]
    got = op1_tool_calls(spark, d)
    assert sorted(got.columns) == names
    assert sorted(repr([r[c] for c in names]) for r in got.collect()) == sorted(repr([r[c] for c in names]) for r in rows)
