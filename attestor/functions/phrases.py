"""Phrases in texts: a text as the runs of its words, looked up in tables of phrases. All expressions stay in the JVM.

A text's tokens are its words in lower case; other signs between words are one token `|`, so no phrase reaches across them, and `^` stands before the first word. A phrase is in a text where it is one of the runs of tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 6  # tokens of a phrase


def spelled(*places: Iterable[str]) -> list[str]:
    """All phrases with one choice for each place, in order; an empty choice leaves its place out."""
    return [" ".join(w for w in words if w) for words in product(*places)]


def tokens(text: Column) -> Column:
    marked = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_\s]+", " | ")
    return F.filter(F.split(F.concat(F.lit("^ "), marked), r"\s+"), lambda w: w != "")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def runs(text: Column, longest: int = LONGEST) -> Column:
    """All runs of 1 to `longest` tokens, each once."""
    def all_of(words: Column) -> Column:
        of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.array_distinct(F.flatten(F.array(*(of(n) for n in range(1, longest + 1)))))

    return _once(tokens(text), all_of)


def _as_tokens(phrase: str) -> str:
    return phrase.replace("-", " | ").replace("'", " | ")


def _most(phrases: Iterable[str]) -> int:
    return max(len(p.split()) for p in phrases)


def holds(text: Column, phrases: Iterable[str]) -> Column:
    """Whether a text has one of the phrases; `^` in front of one: at its beginning."""
    known = sorted({_as_tokens(p) for p in phrases})
    return F.arrays_overlap(runs(text, _most(known)), F.array(*map(F.lit, known)))


def first_kind(text: Column, kinds: Mapping[str, Iterable[str]], default: str | None = None) -> Column:
    """The first kind, in the table's order, one of whose phrases the text has: each phrase has the rank of its kind, and the smallest rank that any run of the text has wins."""
    rank: dict[str, int] = {}
    for n, phrases in enumerate(kinds.values()):
        for p in phrases:
            rank.setdefault(_as_tokens(p), n)
    table = F.create_map(*(F.lit(x) for item in rank.items() for x in item))
    met = F.array_intersect(runs(text, _most(rank)), F.array(*map(F.lit, rank)))
    names = F.array(*map(F.lit, kinds), F.lit(default).cast("string"))
    best = F.coalesce(F.array_min(F.transform(met, lambda p: table[p])), F.lit(len(kinds)))
    return F.element_at(names, (best + 1).cast("int"))
