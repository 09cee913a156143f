"""Text expressions whose results must not depend on an engine's idea of white space or of a regular expression's end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space in a Java pattern (all of Unicode's, and U+001C to U+001F).
WHITE = r"\s\p{Z}\x{85}\x{1c}-\x{1f}"
#: The punctuation that separates words. Not extended on purpose.
PUNCTUATION = "，。！？、：；\"“”‘’（）《》【】〃.,!?;:'\"()[]{}<>/"
#: The wave that stands for the headword in a dictionary's meanings.
PLACEHOLDER = "～"


def punctuation() -> str:
    """The punctuation for use in a character class; Java and RE2 read it alike."""
    return "".join(rf"\x{{{ord(c):04X}}}" for c in PUNCTUATION)


def punctuation_class() -> str:
    return f"[{punctuation()}]"


def text(c: str | Column) -> Column:
    """A text column with null as the empty string."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{WHITE}]+|[{WHITE}]+\z", "")


def spaced(c: Column) -> Column:
    """Punctuation made spaces."""
    return F.regexp_replace(c, punctuation_class(), " ")


def unsegmented(c: Column) -> Column:
    """A text without white space and punctuation."""
    return F.regexp_replace(c, f"[{punctuation()}{WHITE}]+", "")


def split_white(c: Column) -> Column:
    return F.split(c, f"[{WHITE}]+")


def words(c: Column) -> Column:
    """The words of a text in order: punctuation made spaces, split at white space, empty ones dropped. One split does all of it."""
    return F.filter(F.split(c, f"[{punctuation()}{WHITE}]+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(words(c))


def last_line(c: Column) -> Column:
    return F.element_at(F.split(c, "\n"), -1)


def before_end_mark(c: Column, mark: str = "</s>") -> Column:
    """What a model wrote before its end mark, stripped."""
    return strip(F.substring_index(c, mark, 1))


def without(c: Column, part: Column) -> Column:
    """All occurrences of a part removed; an empty part removes nothing."""
    return F.when((part != "") & F.contains(c, part), strip(F.replace(c, part, F.lit("")))).otherwise(c)


def expanded(meanings: Column, word: Column) -> Column:
    """Meanings with the placeholder replaced by the headword."""
    return F.transform(F.coalesce(meanings, F.array().cast("array<string>")), lambda m: F.replace(m, F.lit(PLACEHOLDER), word))


def number_suffix(c: Column) -> Column:
    """The whole number after the last hyphen, null if it is none."""
    return F.substring_index(c, "-", -1).try_cast("bigint")
