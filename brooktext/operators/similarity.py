"""Similarity of paired embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from ..functions.vectors import cosine_of, dot, norm, normalized_of


def paired_similarity(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """pairs with cosine (-1 to 1) and score (0 to 1)."""
    parts = pairs.withColumns({"product": dot(F.col(x), F.col(y)), "nx": norm(F.col(x)), "ny": norm(F.col(y))})
    args = (F.col("product"), F.col("nx"), F.col("ny"))
    return parts.withColumns({"cosine": cosine_of(*args), "score": normalized_of(*args)}).drop("product", "nx", "ny")
