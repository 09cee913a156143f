"""Chat formatting: tool calls are linked to their results, ordered, validated and serialised as canonical JSON.

Calls and results are hash-joined by (conversation, identifier): both sides are aggregated by that key first, and the
join hashes the results of a partition (`shuffle_hash`). A call depends on the calls that it names; its level is one more
than the highest level among these, so that ordering by (level, turn) is a topological order. Arguments are validated
against the tool's schema (the part of JSON Schema in `errors_of`; other keywords are errors), and call and result are
written as canonical JSON: sorted keys, no white space, shortest numbers, no needless escapes.

A conversation of up to `TOGETHER` calls is ordered by one task as its rows stream by. Larger ones are never gathered:
chains of calls that need one other call each are shortened by path doubling, in as many rounds of joins as the longest
chain has binary digits; what is left, calls that need several others, takes a round for each of their levels
(`level_rounds`).

Defined results: of several results for one call the earliest counts (then the least content), `n_results` tells how many
there are; a call without a result is "unanswered", a result without a call "orphan" (a row of its own); repeated call
identifiers in a conversation are one call, the earliest; dependencies on calls that don't exist are ignored and counted
in `n_missing`; calls on or behind a cycle have a null level. A row with a null identifier or conversation links with
nothing and stays a row of its own, unanswered or orphaned; nothing can depend on it, and in a null conversation it
depends on nothing. Arguments that aren't JSON objects, that are nested more than `MAX_DEPTH` deep or hold half a
surrogate pair, and tools without a schema, are invalid with that error; the arguments are then written as the text that
they are where they have no canonical form. Null texts are empty; texts of any length are whole; empty tables give none;
other columns, whatever their names, are left out.
"""

from __future__ import annotations

import json
import re
from collections import deque
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, persist, small_batches, tidy

TOGETHER, MAX_DEPTH, SHORT_DIGITS = 20_000, 200, 4_000
#: The schema of the one tool that turns of a conversation are read as calls of.
REPLY = {"reply": {"type": "object", "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 400}, "turn": {"type": "integer", "minimum": 0}}, "required": ["text", "turn"], "additionalProperties": False}}
_OUT = "conv_id long, call_id string, name string, turn long, result_turn long, n_results long, n_missing long, status string, level long, valid boolean, errors string, canonical string"


def canonical(x) -> str:
    """Canonical JSON: keys in the order of their UTF-16 units, numbers in their shortest form."""
    if isinstance(x, dict):
        return "{" + ",".join(f"{canonical(str(k))}:{canonical(x[k])}" for k in sorted(x, key=lambda k: str(k).encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(canonical, x)) + "]"
    if isinstance(x, Decimal):  # a whole number of very many digits
        return str(x)
    if isinstance(x, float):
        if x != x or x in (float("inf"), float("-inf")):
            raise ValueError("JSON has no such number")
        if x == int(x) and abs(x) < 1e21:
            return str(int(x))
        digits, _, power = repr(x).partition("e")
        if not power:
            return digits
        n = int(power)
        if -7 < n < 0:
            return f"{x:.{len(digits.replace('.', '').lstrip('-')) - 1 - n}f}"
        return f"{digits.removesuffix('.0')}e{'+' if n > 0 else '-'}{abs(n)}"
    return json.dumps(x, ensure_ascii=False)


_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*"?|([\[{])|([\]}])', re.S)


def depth(text: str) -> int:
    """How deep the text's brackets are nested, outside strings."""
    if text.count("[") + text.count("{") <= MAX_DEPTH:
        return 0
    now = most = 0
    for m in _BRACKETS.finditer(text):
        now += (m[1] is not None) - (m[2] is not None)
        most = max(most, now)
    return most


def parsed(text: str):
    """The JSON value of a text; ValueError if it is none or nested too deeply. Whole numbers keep all their digits."""
    if depth(text) > MAX_DEPTH:
        raise ValueError(f"nested more than {MAX_DEPTH} deep")
    try:
        return json.loads(text, parse_int=lambda d: int(d) if len(d) <= SHORT_DIGITS else Decimal(d))
    except ValueError:
        raise ValueError("not JSON") from None


_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}
#: Keywords that say nothing about validity.
_NOTES = frozenset("title description default examples deprecated readOnly writeOnly format $schema $id $comment".split())
_KNOWN = frozenset("type enum const minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength minItems maxItems uniqueItems items required properties additionalProperties minProperties maxProperties allOf anyOf oneOf not".split())


def _is(x, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(x, (int, Decimal)) and not isinstance(x, bool) or isinstance(x, float) and (kind == "number" or x.is_integer())
    return isinstance(x, _TYPES[kind])


def _key(x):
    """Equal for JSON values that are equal: numbers by their value, never a boolean and a number."""
    if isinstance(x, dict):
        return "o", frozenset((k, _key(v)) for k, v in x.items())
    if isinstance(x, list):
        return "a", tuple(map(_key, x))
    return "b" if isinstance(x, bool) else "n" if _is(x, "number") else "s", x


def errors_of(x, schema: dict | bool, at: str = "$") -> list[str]:
    """What in x breaks the schema, by the keywords in `_KNOWN`. Keywords and types that aren't known are errors themselves, as they can't be checked."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: nothing is allowed here"]
    out = [f"{at}: schema keyword {k} isn't supported" for k in sorted(schema) if k not in _KNOWN and k not in _NOTES]
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    out += [f"{at}: schema type {k} isn't supported" for k in kinds if k not in _TYPES and k not in ("integer", "number")]
    if out:
        return out
    if kinds and not any(_is(x, k) for k in kinds):
        return [f"{at}: not of type {'|'.join(kinds)}"]
    if "enum" in schema and _key(x) not in map(_key, schema["enum"]) or "const" in schema and _key(x) != _key(schema["const"]):
        out.append(f"{at}: not an allowed value")
    if _is(x, "number"):
        out += [f"{at}: below {schema['minimum']}"] if x < schema.get("minimum", x) else []
        out += [f"{at}: above {schema['maximum']}"] if x > schema.get("maximum", x) else []
        out += [f"{at}: not above {schema['exclusiveMinimum']}"] if "exclusiveMinimum" in schema and not x > schema["exclusiveMinimum"] else []
        out += [f"{at}: not below {schema['exclusiveMaximum']}"] if "exclusiveMaximum" in schema and not x < schema["exclusiveMaximum"] else []
        if "multipleOf" in schema and x == x and abs(x) != float("inf"):
            step, n = Decimal(repr(schema["multipleOf"])), x if isinstance(x, Decimal) else Decimal(repr(x))
            whole = (n.as_integer_ratio()[0] * step.as_integer_ratio()[1]) % (n.as_integer_ratio()[1] * step.as_integer_ratio()[0]) == 0
            out += [] if whole else [f"{at}: not a multiple of {schema['multipleOf']}"]
    if isinstance(x, str):
        out += [f"{at}: shorter than {schema['minLength']}"] if len(x) < schema.get("minLength", 0) else []
        out += [f"{at}: longer than {schema['maxLength']}"] if len(x) > schema.get("maxLength", len(x)) else []
    if isinstance(x, list):
        out += [f"{at}: fewer than {schema['minItems']}"] if len(x) < schema.get("minItems", 0) else []
        out += [f"{at}: more than {schema['maxItems']}"] if len(x) > schema.get("maxItems", len(x)) else []
        out += [f"{at}: repeated items"] if schema.get("uniqueItems") and len(set(map(_key, x))) < len(x) else []
        if "items" in schema:
            out += [e for k, y in enumerate(x) for e in errors_of(y, schema["items"], f"{at}[{k}]")]
    if isinstance(x, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}: fewer than {schema['minProperties']} members"] if len(x) < schema.get("minProperties", 0) else []
        out += [f"{at}: more than {schema['maxProperties']} members"] if len(x) > schema.get("maxProperties", len(x)) else []
        out += [f"{at}: lacks {k}" for k in sorted(schema.get("required", [])) if k not in x]
        for k in sorted(x):
            if k in known:
                out += errors_of(x[k], known[k], f"{at}.{k}")
            elif more is False:
                out.append(f"{at}: {k} isn't allowed")
            else:
                out += errors_of(x[k], more, f"{at}.{k}")
    for part in schema.get("allOf", []):
        out += errors_of(x, part, at)
    for word, right in (("anyOf", lambda n: n > 0), ("oneOf", lambda n: n == 1)):
        if word in schema and not right(sum(not errors_of(x, part, at) for part in schema[word])):
            out.append(f"{at}: doesn't match {word}")
    if "not" in schema and not errors_of(x, schema["not"], at):
        out.append(f"{at}: matches what it must not")
    return out


def levels(calls: list[str | None], needs: list[list[str]]) -> list[int | None]:
    """One more than the highest level among a call's needs; None on or behind a cycle. Unknown needs are ignored, and no need is a call without a name."""
    place = {c: k for k, c in enumerate(calls) if c is not None}
    after: list[list[int]] = [[] for _ in calls]
    waits = [0] * len(calls)
    for k, ns in enumerate(needs):
        for n in set(ns):
            if n in place:
                after[place[n]].append(k)
                waits[k] += 1
    out: list[int | None] = [None] * len(calls)
    reach = [0] * len(calls)
    ready = deque(k for k, w in enumerate(waits) if not w)
    while ready:
        k = ready.popleft()
        out[k] = reach[k]
        for a in after[k]:
            reach[a] = max(reach[a], reach[k] + 1)
            waits[a] -= 1
            if not waits[a]:
                ready.append(a)
    return out


def level_rounds(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of calls (conv_id, call_id, needs); those on or behind a cycle are left out.

    A call with one need points to it, at a distance of 1. Path doubling replaces what a call points to by what that
    points to, adding distances, so that after k rounds 2 ** k steps of a chain are one. Each then points to a call
    without needs, whose level is 0, or to one with several, and only the latter are left to be ordered: in rounds, each
    of which frees those whose needs are all ordered. Each round's tables are deleted once the next one's are written."""
    key = ["conv_id", "call_id"]
    known = calls.select(*key)
    edges = calls.select(*key, F.explode(F.array_distinct("needs")).alias("need"))
    edges = persist(edges.join(known.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_semi"), "chat-edges")
    counted = persist(edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("need").alias("to")), "chat-counted")
    roots = known.join(counted, key, "left_anti").withColumn("level", F.lit(0).cast("long"))
    rounds = max(1, counted.where("n = 1").count()).bit_length() + 1
    paths = persist(counted.where("n = 1").select(*key, "to", F.lit(1).cast("long").alias("far")), "chat-paths")
    for _ in range(rounds):
        ahead = paths.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        longer = paths.join(ahead, ["conv_id", "to"], "left").select(*key, F.coalesce("next", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("next").isNotNull().alias("moved"))
        longer = persist(longer, "chat-paths")
        discard(paths)
        paths, moved = longer.drop("moved"), longer.where("moved")
        paths.persisted_at = longer.persisted_at
        if moved.isEmpty():
            break
    # whoever points to a call with one need even now is on or behind a cycle of such calls
    ended = paths.join(counted.where("n = 1").select("conv_id", F.col("call_id").alias("to")), ["conv_id", "to"], "left_anti")
    done = persist(roots.select(*key, "level"), "chat-levels")
    several = edges.join(counted.where("n > 1").select(*key), key, "left_semi").withColumnRenamed("need", "to")
    via = ended.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("end"), "far")
    through = paths.select("conv_id", F.col("call_id").alias("to")).withColumn("path", F.lit(True))
    left = several.join(via, ["conv_id", "to"], "left").join(through, ["conv_id", "to"], "left")
    # a need on or behind a cycle has no end: its edge leads to itself, and is never freed
    left = persist(left.select(*key, F.when(F.col("path") & F.col("end").isNull(), F.col("call_id")).otherwise(F.coalesce("end", "to")).alias("to"), (F.coalesce("far", F.lit(0)) + 1).alias("far")), "chat-left")
    reach = persist(left.select(*key, F.lit(0).cast("long").alias("level")).limit(0), "chat-reach")
    fresh, parts = done, [done]
    while True:
        hit = left.join(fresh.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("below")), ["conv_id", "to"])
        now = persist(reach.union(hit.select(*key, (F.col("below") + F.col("far")).alias("level"))).groupBy(*key).agg(F.max("level").alias("level")), "chat-reach")
        rest = persist(left.join(fresh.select("conv_id", F.col("call_id").alias("to")), ["conv_id", "to"], "left_anti"), "chat-left")
        discard(left, reach)
        left, reach = rest, now
        waiting = rest.select(*key).distinct()
        fresh = persist(now.join(waiting, key, "left_anti"), "chat-levels")
        if fresh.isEmpty():
            discard(fresh)
            break
        parts.append(fresh)
        kept = persist(now.join(waiting, key, "left_semi"), "chat-reach")
        discard(reach)
        reach = kept
    ordered = parts[0]
    for part in parts[1:]:
        ordered = ordered.union(part)
    chained = ended.join(ordered.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("below")), ["conv_id", "to"])
    out = persist(ordered.union(chained.select(*key, (F.col("below") + F.col("far")).alias("level"))), "chat-levels")
    discard(left, reach, paths, counted, edges, *parts)
    return out


def _row(call: dict, level: int | None, missing: int, schemas: dict) -> list:
    """An output row: validated, serialised."""
    if call["turn"] is None:
        return [call["conv_id"], call["call_id"], None, None, call["result_turn"], call["n_results"], 0, "orphan", None, None, None, canonical({"id": call["call_id"], "result": call["content"] or ""})]
    name, errors = call["name"], []
    try:
        args = parsed(call["arguments"] or "")
    except ValueError as e:
        args, errors = call["arguments"], [f"$: {e}"]
    if not errors:
        errors = errors_of(args, schemas[name]) if name in schemas else ["$: no schema for this tool"]
        errors = errors if isinstance(args, dict) else errors or ["$: not of type object"]
    answered = call["result_turn"] is not None
    whole = {"arguments": args, "id": call["call_id"], "name": name} | ({"result": call["content"] or ""} if answered else {})
    try:
        text = canonical(whole)
        text.encode()
    except ValueError as e:
        what = "holds half a surrogate pair" if isinstance(e, UnicodeEncodeError) else "holds what isn't a JSON number"
        text, errors = canonical(whole | {"arguments": call["arguments"]}), [*errors, f"$: {what}"]
    said = "; ".join(errors).encode("utf-8", "backslashreplace").decode()
    return [call["conv_id"], call["call_id"], name, call["turn"], call["result_turn"], call["n_results"], missing, "linked" if answered else "unanswered", level, not errors, said, text]


def _record(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
    names = [x.split()[0] for x in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], together: int = TOGETHER) -> DataFrame:
    """calls: conv_id, call_id, name, arguments (JSON), needs (array<string>), turn. results: conv_id, call_id, content, turn.

    A row for each call, and one for each identifier of orphaned results."""
    small_batches(calls.sparkSession)
    first = F.min(F.struct("turn", "arguments", "name", "needs")).alias("c")
    every = calls.select(F.col("conv_id").cast("long").alias("conv_id"), "call_id", "name", "arguments", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"))
    c = every.where("call_id is not null and conv_id is not null").groupBy("conv_id", "call_id").agg(first).select("conv_id", "call_id", "c.*")
    told = results.select(F.col("conv_id").cast("long").alias("conv_id"), "call_id", F.coalesce("content", F.lit("")).alias("content"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"))
    r = told.where("call_id is not null and conv_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    r = persist(r.select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results"), "chat-results")
    names = ["conv_id", "call_id", "name", "arguments", "needs", "turn", "result_turn", "content", "n_results"]
    # the hash join's table holds identifiers, turns and counts only; results' contents come by a join that can spill
    linked = persist(c.join(r.drop("content").hint("shuffle_hash"), ["conv_id", "call_id"], "full_outer"), "chat-linked")
    whole = linked.join(r.select("conv_id", "call_id", "content").hint("merge"), ["conv_id", "call_id"], "left").withColumn("n_results", F.coalesce("n_results", F.lit(0).cast("long")))
    # rows that can't be linked keep beside the join, so that no null key gathers them
    none = F.lit(None)
    lone = every.where("call_id is null or conv_id is null").select(*names[:6], none.cast("long").alias("result_turn"), none.cast("string").alias("content"), F.lit(0).cast("long").alias("n_results"))
    lost = told.where("call_id is null or conv_id is null").select("conv_id", "call_id", none.cast("string").alias("name"), none.cast("string").alias("arguments"), none.cast("array<string>").alias("needs"), none.cast("long").alias("turn"), F.col("turn").alias("result_turn"), "content", F.lit(1).cast("long").alias("n_results"))
    both = persist(whole.select(names).union(lone).union(lost), "chat-rows")
    discard(r, linked)

    def ordered(group: list[dict]) -> list[list]:
        known = [x for x in group if x["turn"] is not None]
        ids = {x["call_id"] for x in known}
        level = iter(levels([x["call_id"] for x in known], [x["needs"] or [] for x in known]))
        return [_row(x, next(level) if x["turn"] is not None else None, sum(n not in ids for n in set(x["needs"] or [])), schemas) for x in group]

    def together_rows(batches):
        conv, group = None, []
        for b in batches:
            out = []
            for x in b.to_pylist():
                if x["conv_id"] != conv:
                    out += ordered(group)
                    conv, group = x["conv_id"], []
                group.append(x)
            yield _record(out)
        yield _record(ordered(group))

    def apart(batches):
        for b in batches:
            yield _record([_row(x, x["level"], x["n_missing"] or 0, schemas) for x in b.to_pylist()])

    large = persist(both.where("conv_id is not null").groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > together).select("conv_id"), "chat-large")
    some = not large.isEmpty()
    small = both.where("conv_id is not null")
    small = small.join(large, "conv_id", "left_anti") if some else small
    out = small.select(names).repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(tidy(together_rows), _OUT)
    alone = both.where("conv_id is null").select(*names, F.when(F.col("turn").isNotNull(), F.lit(0).cast("long")).alias("level"), F.size(F.array_distinct("needs")).cast("long").alias("n_missing"))
    out = out.union(alone.mapInArrow(tidy(apart), _OUT))
    if not some:
        discard(large)
        return out
    # a row key stands for calls without a name, on which nothing can depend; they are told apart by it
    unnamed = F.col("call_id").isNull()
    big = persist(both.join(large, "conv_id").withColumn("row_key", F.when(unnamed, F.uuid())), "chat-large")
    wanted = F.filter(F.coalesce("needs", F.array().cast("array<string>")), lambda n: n.isNotNull())
    known = big.where("turn is not null").select("conv_id", F.to_json(F.struct("call_id", "row_key")).alias("call_id"), F.transform(wanted, lambda n: F.to_json(F.struct(n.alias("call_id"), F.lit(None).cast("string").alias("row_key")))).alias("needs"))
    level = level_rounds(known)
    wants = known.select("conv_id", "call_id", F.explode(F.array_distinct("needs")).alias("need")).join(known.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_anti")
    missing = persist(wants.groupBy("conv_id", "call_id").agg(F.count("*").alias("n_missing")), "chat-missing")
    keyed = big.select(*(F.col(c).alias(f"b_{c}") for c in names), "conv_id", F.to_json(F.struct("call_id", "row_key")).alias("call_id"))
    wide = keyed.join(level, ["conv_id", "call_id"], "left").join(missing, ["conv_id", "call_id"], "left")
    return out.union(wide.select(*(F.col(f"b_{c}").alias(c) for c in names), "level", "n_missing").mapInArrow(tidy(apart), _OUT))


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A conversation table (conv_id, turn, role, text) as calls and results.

    A user's turn calls the tool "reply" with its text and turn, under the identifier call_<turn>, and needs the call two
    turns before, if there is one. An assistant's turn is the result of the call of the turn before. System turns are neither."""
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    name = lambda k: F.concat(F.lit("call_"), (F.col("turn") - k).cast("string"))
    user = m.where("role = 'user'")
    ids = user.select("conv_id", name(0).alias("need")).distinct()
    calls = user.select("conv_id", name(0).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"), name(2).alias("need"), "turn")
    calls = calls.join(ids.withColumn("there", F.lit(True)), ["conv_id", "need"], "left")
    calls = calls.select("conv_id", "call_id", "name", "arguments", F.when(F.col("there"), F.array("need")).otherwise(F.array().cast("array<string>")).alias("needs"), "turn")
    return calls, m.where("role = 'assistant'").select("conv_id", name(1).alias("call_id"), F.col("text").alias("content"), "turn")
