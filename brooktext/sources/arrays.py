"""The elements of large JSON arrays, read by many tasks.

A JSON array in one file has no line breaks to split at, and whether a place lies in a string can't be seen from what follows.
So the file is read as text whose "lines" end at closing braces, which Spark splits into blocks at any byte, twice:

1. Every block is scanned under both assumptions, that it begins in a string and that it doesn't. A row for each block tells how the scan ended:
   in a string or not, how many brackets deeper or higher. From the first block on, which begins outside, these rows give the state at the beginning
   of each block. They are one for each block of `spark.sql.files.maxPartitionBytes` bytes, so the driver can chain them.
2. With its state known, each block gives its elements whole, and the pieces of those that reach over its borders; pieces are put together
   by a shuffle of their own.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("?)|[\[\]{},]', re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*("?)', re.S)


@dataclass(frozen=True)
class State:
    """Where a scan stands: in a string, how deep in brackets, within the wanted array or not."""

    quoted: bool = False
    depth: int = 0
    inside: bool = False


class Scan:
    """A scan over text in order. key: the root object's member whose array is wanted; None: the root is the array.

    borders() yields the places in a text where an element ends; `lowest` is the least depth so far."""

    def __init__(self, key: str | None, state: State):
        self.key, self.state, self.lowest, self.word = key, state, state.depth, ""
        self.level = 1 if key is None else 2

    def borders(self, text: str):
        at, s = 0, self.state
        quoted, depth, inside = s.quoted, s.depth, s.inside
        if quoted:
            m = _REST.match(text)
            at, quoted = m.end(), not m[1]
        while m := _TOKEN.search(text, at):
            at, token = m.end(), m[0][0]
            if token == '"':
                self.word, quoted = m[0], not m[1]
            elif token in "[{":
                depth += 1
                if depth == self.level and token == "[" and (self.key is None or self._named()):
                    inside = True
                    yield at, "opened"
            elif token in "]}":
                if depth == self.level and inside:
                    inside = False
                    yield at - 1, "closed"
                depth -= 1
                self.lowest = min(self.lowest, depth)
            elif depth == self.level and inside:
                yield at - 1, "parted"
        self.state = State(quoted, depth, inside)

    def _named(self) -> bool:
        try:
            return json.loads(self.word) == self.key
        except ValueError:
            return False


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """file, block, value: the text between closing braces, in order within a block."""
    found = spark.read.option("lineSep", "}").text(path)
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batches):
    """(file, block, texts) again and again, in order; a block may come in several runs."""
    for b in batches:
        files, blocks, values = (b.column(c).to_pylist() for c in ("file", "block", "value"))
        start = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or (files[i], blocks[i]) != (files[start], blocks[start]):
                yield files[start], blocks[start], [v + "}" for v in values[start:i]]
                start = i


def _ends(key: str | None):
    """Of each block, for both beginnings: quoted or not at its end, the change of depth, the least depth met, and whether the wanted array is open."""

    def run(batches):
        held: dict[tuple[str, int], list[Scan]] = {}
        for file, block, texts in _runs(batches):
            # relative to the block's own beginning; the wanted array is looked for at any depth that may turn out to be the right one
            scans = held.setdefault((file, block), [Scan(key, State(q)) if block == 0 else _Relative(key, State(q)) for q in (False, True)])
            for scan in scans:
                for t in texts:
                    for _ in scan.borders(t):
                        pass
        rows = [(f, b, q, s.state.quoted, s.state.depth, s.lowest, s.state.inside) for (f, b), pair in held.items() for q, s in enumerate(pair)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["file", "block", "began", "quoted", "depth", "lowest", "inside"])

    return run


class _Relative(Scan):
    """A scan from an unknown depth: the array that was opened last from the least depth so far, and is open still, counts as `inside`, as the root object
    is the outermost that a block can come back to."""

    def borders(self, text: str):
        at, s = 0, self.state
        quoted, depth, inside = s.quoted, s.depth, s.inside
        if quoted:
            m = _REST.match(text)
            at, quoted = m.end(), not m[1]
        while m := _TOKEN.search(text, at):
            at, token = m.end(), m[0][0]
            if token == '"':
                self.word, quoted = m[0], not m[1]
            elif token in "[{":
                if depth == self.lowest:
                    inside = token == "[" and (self.key is None or self._named())
                depth += 1
            elif token in "]}":
                depth -= 1
                if depth <= self.lowest:
                    self.lowest, inside = depth, False
        self.state = State(quoted, depth, inside)
        return ()


def _starts(ends: DataFrame, key: str | None) -> dict[tuple[str, int], State]:
    """The state at the beginning of each block, from what is known of the blocks before."""
    known = {(r.file, r.block, bool(r.began)): r for r in ends.collect()}  # two rows a block
    out, last, state = {}, None, State()
    for file, block in sorted({k[:2] for k in known}):
        state = State() if file != last else state
        out[file, block], last = state, file
        r = known[file, block, state.quoted]
        if block == 0:
            state = State(r.quoted, r.depth, r.inside)
            continue
        depth, met = state.depth + r.depth, state.depth + r.lowest
        root = 0 if key is None else 1
        state = replace(state, quoted=r.quoted, depth=depth, inside=r.inside if met <= root else state.inside)
    return out


def _pieces(key: str | None, starts: dict[tuple[str, int], State]):
    """(file, block, at, began, ended, json): the elements and their pieces in each block. A piece that hasn't begun goes on from the block before, one that
    hasn't ended goes on in the next."""

    def run(batches):
        scan, where, began, at, held = None, None, False, 0, []
        rows = []

        def cut(ended: bool):
            nonlocal at, began
            piece = "".join(held)
            held.clear()
            if piece.strip() or not (began and ended):
                rows.append((*where, at, began, ended, piece))
            at, began = at + 1, True

        for file, block, texts in _runs(batches):
            if (file, block) != where:
                if scan and scan.state.inside:
                    cut(False)
                where, scan, at, began = (file, block), Scan(key, starts[file, block]), 0, False
                held.clear()
            for t in texts:
                done = 0
                within = scan.state.inside
                for place, what in scan.borders(t):
                    if what == "opened":
                        began, within = True, True
                    else:
                        held.append(t[done:place])
                        cut(True)
                        within = what == "parted"
                    done = place if what == "opened" else place + 1
                if within:
                    held.append(t[done:])
            while len(rows) >= 1000:
                yield _batch(rows[:1000])
                del rows[:1000]
        if scan and scan.state.inside:
            cut(False)
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["file", "block", "at", "began", "ended", "json"])


def json_elements(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """file, block, at, json: the text of each element of the array that a JSON file is, or that its root object has under `key`. Elements are in the order of
    block and at within a file. An array of no elements, and a file without that array, give no rows."""
    found = _fragments(spark, path)
    starts = _starts(found.mapInArrow(_ends(key), "file string, block bigint, began bigint, quoted boolean, depth bigint, lowest bigint, inside boolean"), key)
    told = spark.sparkContext.broadcast(starts)  # a row for each block
    pieces = found.mapInArrow(lambda batches: _pieces(key, told.value)(batches), "file string, block bigint, at bigint, began boolean, ended boolean, json string")
    whole = pieces.where("began and ended").select("file", "block", "at", "json")
    # an element over a border begins with its last piece that has begun: at most two pieces a block
    parts = pieces.where("not (began and ended)")
    order = Window.partitionBy("file").orderBy("block", "at")
    parts = parts.withColumn("first", F.last(F.when(F.col("began"), F.struct("block", "at")), ignorenulls=True).over(order))
    joined = parts.groupBy("file", "first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "json"))), lambda p: p["json"]), "").alias("json"))
    joined = joined.where(F.col("first").isNotNull()).select("file", "first.block", "first.at", "json")
    return whole.unionByName(joined.where(F.trim(F.regexp_replace("json", r"\s+", " ")) != ""))
