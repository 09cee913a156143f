"""Steps that need a model: an interface, and stand-ins that read what a model has said before.

No model is part of this library. A step is any function from a DataFrame to a DataFrame that adds its column;
`batched` makes one of a function that is loaded once for each task and called with lists of texts. The precomputed stand-ins below
are stubs: they only look up recorded outputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ModelStep = Callable[[DataFrame], DataFrame]


def batched(load: Callable[[], Callable[[list[str]], Iterable]], prompt: str, out: str, kind: str = "string") -> ModelStep:
    """A step that calls load() once a task and what it returns on each Arrow batch of prompts."""

    def step(df: DataFrame) -> DataFrame:
        wide = df.withColumn(out, F.lit(None).cast(kind))
        names, schema = wide.columns, wide.schema

        def run(batches):
            model = None
            for b in batches:
                model = model or load()
                got = list(model([t or "" for t in b.column(prompt).to_pylist()]))
                at = names.index(out)
                yield pa.RecordBatch.from_arrays([pa.array(got, b.column(k).type) if k == at else b.column(k) for k in range(len(names))], names=names)

        return wide.mapInArrow(run, schema)

    return step


def precomputed(recorded: DataFrame, keys: list[str], out: str) -> ModelStep:
    """A stub: joins recorded outputs (keys, out) in place of a model; rows without one get null."""
    return lambda df: df.join(recorded.select(*keys, out), keys, "left")


def segmented(segment: Callable[[str], list[str]] | None, text_col: str = "text", out: str = "segmented") -> ModelStep:
    """Word segmentation with a segmenter of the caller's; by default the text is taken as segmented already."""
    if segment is None:
        return lambda df: df.withColumn(out, F.coalesce(text_col, F.lit("")))
    return batched(lambda: lambda ts: [" ".join(segment(t)) for t in ts], text_col, out)
