"""What is read out of a model's response and a judge's reply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE, last_line, strip, text, without

#: The labels of a response's two parts.
REWRITE_LABEL, WORDS_LABEL = "改写", "分词"
_W = f"[{WHITE}]*"
_COLONS = f"[：:{WHITE}]*"
#: How a response's two parts are found.
REWRITE = rf"(?sd)1\.{_W}{REWRITE_LABEL}{_COLONS}(.*?)(?:{_W}2\.|{_W}{WORDS_LABEL}|$)"
WORDS = rf"(?sd)2\.{_W}{WORDS_LABEL}{_COLONS}(.*)"
#: Fixed value: a judge's score. One decimal below one; one, with any character and a nought after it; nought.
SCORE = r"(?d)-?0\.[0-9]|-?1(?:.0)?|0"
UNRESOLVED = 0.01


def parsed(response: Column) -> tuple[Column, Column]:
    """(rewrite, segmentation) of a response.

    Without a segmentation the last line is taken for it; without a rewrite the whole response, less the segmentation."""
    whole = strip(text(response))
    found = strip(F.regexp_extract(text(response), WORDS, 1))
    words = F.when(found == "", strip(last_line(whole))).otherwise(found)
    rewrite = strip(F.regexp_extract(text(response), REWRITE, 1))
    return F.when(rewrite == "", without(whole, words)).otherwise(rewrite), words


def clamped(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def score(reply: Column) -> Column:
    """The score in a judge's reply, from -1 to 1; 0 if there is none or it isn't a number."""
    found = F.replace(F.regexp_extract(text(reply), SCORE, 0), F.lit("_"), F.lit(""))  # "1_0" is read as ten
    return clamped(F.coalesce(F.trim(found).try_cast("double"), F.lit(0.0)))
