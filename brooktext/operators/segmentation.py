"""Words of text that is written without blanks, by a dictionary.

Every occurrence of a dictionary word is an edge between two places of the text; a character that isn't covered may stand for itself. The words are those
of the cheapest path, where a word costs floor(1000 * ln(total / weight)), as much as its frequency makes it unlikely, and a lone character
as much as a word of weight 1. Of paths that cost the same, the one whose last word is longest is taken, at every place. White space always parts words.

Occurrences are found by an automaton of the whole dictionary in one pass; the recurrence is linear in the number of edges. Workers hold the dictionary, so it is
bounded (`MOST_WORDS`); a larger one is an error.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import ModelStep, batched

MOST_WORDS = 1_000_000


def costs(dictionary: DataFrame) -> tuple[list[tuple[str, int]], int]:
    """(word, cost) of each word, and the cost of a lone character. dictionary: word, weight (1 or more); of equal words the weights are added."""
    words = dictionary.where("word <> ''").groupBy("word").agg(F.sum("weight").alias("weight"))
    rows = words.limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a dictionary of more than {MOST_WORDS} words")
    total = sum(r.weight for r in rows)
    cost = lambda weight: math.floor(1000 * math.log(total / weight))
    return [(r.word, cost(r.weight)) for r in rows], cost(1) if total else 0


def automaton(words: list[tuple[str, int]]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for w, cost in words:
        out.add_word(w, (len(w), cost))
    if words:
        out.make_automaton()
    return out


def best_path(text: str, found, lone: int) -> list[str]:
    """The words of the cheapest path through a text. found: an automaton, or None for an empty dictionary."""
    best, last, edges = [0] * (len(text) + 1), [0] * (len(text) + 1), found.iter(text) if found else iter(())
    end, edge = -1, next(edges, None)
    for end in range(len(text)):
        least, length = best[end] + lone, 1
        while edge and edge[0] == end:
            n, cost = edge[1]
            at = best[end + 1 - n] + cost
            if at < least or at == least and n > length:
                least, length = at, n
            edge = next(edges, None)
        best[end + 1], last[end + 1] = least, length
    out, at = [], len(text)
    while at:
        out.append(text[at - last[at] : at])
        at -= last[at]
    return out[::-1]


def by_dictionary(dictionary: DataFrame, text_col: str = "text", out: str = "segmented") -> ModelStep:
    """A step that adds the text's words, parted by blanks."""
    words, lone = costs(dictionary)
    told = dictionary.sparkSession.sparkContext.broadcast(words)

    def load():
        found = automaton(told.value) if told.value else None
        return lambda texts: [" ".join(w for part in t.split() for w in best_path(part, found, lone)) for t in texts]

    return batched(load, text_col, out)
