"""Arrow UDFs for what built-in functions can't express: fuzzy quotes, similar titles and main text of HTML; the parts of a compound claim as an SQL expression."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.functions import text as tx

# How alike a fuzzy quote is, the shortest quote that counts, how alike titles are and how long at least.
FUZZY_QUOTE, SHORTEST_QUOTE = 0.88, 12
TITLE_RATIO, SHORTEST_TITLE = 0.92, 20


def common_subsequence(places: dict[str, int], n: int, text: str) -> int:
    """Length of the longest common subsequence of a string of n characters and a text, bit-parallel: places has the positions of each character of the string as bits."""
    every = (1 << n) - 1
    free = every
    for c in text:
        met = free & places.get(c, 0)
        free = ((free + met) | (free - met)) & every
    return n - free.bit_count()


def is_close(needle: str, text: str) -> bool:
    """Whether a window of the needle's length, a quarter of it apart, has the ratio of a fuzzy quote. The characters that the ratio counts stand in the same order in both, so the longest common subsequence bounds it; windows beyond the bound, nearly all, need no more than that."""
    n = len(needle)
    places: dict[str, int] = {}
    for i, c in enumerate(needle):
        places[c] = places.get(c, 0) | 1 << i
    if n > len(text):
        return difflib.SequenceMatcher(None, needle, text).ratio() >= FUZZY_QUOTE
    matcher = difflib.SequenceMatcher()
    matcher.set_seq2(needle)
    for start in range(0, len(text) - n + 1, max(1, n // 4)):
        window = text[start : start + n]
        if 2 * common_subsequence(places, n, window) >= FUZZY_QUOTE * (n + len(window)) - 1e-9:
            matcher.set_seq1(window)
            if matcher.ratio() >= FUZZY_QUOTE:
                return True
    return False


@F.pandas_udf(T.BooleanType())
def _fuzzy(needles: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([bool(n) and bool(t) and is_close(n, t) for n, t in zip(needles, texts, strict=True)], dtype=bool)


def quote_match(quote: Column, text: Column) -> Column:
    """exact, fuzzy or none. Both sides in their matching form; the UDF sees only rows that aren't exact."""
    q, t = tx.for_match(F.coalesce(quote, F.lit(""))), tx.for_match(F.coalesce(text, F.lit("")))
    exact = (F.length(q) >= SHORTEST_QUOTE) & t.contains(q)
    left = ~exact & (F.length(q) >= SHORTEST_QUOTE)
    return F.when(exact, "exact").when(_fuzzy(F.when(left, q), F.when(left, t)), "fuzzy").otherwise("none")


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def titles_match(a: Column, b: Column) -> Column:
    x, y = F.lower(tx.one_spaced(a)), F.lower(tx.one_spaced(b))
    digits = lambda c: F.regexp_extract_all(c, F.lit("([0-9]+)"), 1)
    able = (F.length(x) >= SHORTEST_TITLE) & (F.length(y) >= SHORTEST_TITLE) & (digits(x) == digits(y))
    return F.coalesce(able & (F.when(able, ratio(x, y)) >= TITLE_RATIO), F.lit(False))


class _Blocks(HTMLParser):
    """The blocks of a page in order: (text, words, words in links, number of the container, whether it lies in an aside of the page)."""

    UNSEEN = ("script", "style", "noscript", "template", "title", "head")
    ASIDE = ("nav", "header", "footer", "aside", "form", "menu")
    CONTAINERS = ("body", "main", "article", "section", "div", "td", "ul", "ol", "dl", "table", "blockquote", *ASIDE)
    BREAKS = ("p", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "dt", "dd", "pre", "hr")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int, int, bool]] = []
        self.open: list[tuple[str, int]] = [("", 0)]
        self.made = self.links = self.linked = 0
        self.unseen: list[str] = []
        self.text: list[str] = []

    def end_block(self) -> None:
        words = " ".join("".join(self.text).split())
        if words:
            self.blocks.append((words, len(words.split()), self.linked, self.open[-1][1], any(tag in self.ASIDE for tag, _ in self.open)))
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.UNSEEN:
            self.unseen.append(tag)
        elif tag in self.CONTAINERS:
            self.end_block()
            self.made += 1
            self.open.append((tag, self.made))
        elif tag in self.BREAKS:
            self.end_block()
        elif tag == "a":
            self.links += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in self.UNSEEN:
            if tag in self.unseen:
                while self.unseen.pop() != tag:
                    pass
        elif tag in self.CONTAINERS:
            self.end_block()
            if any(t == tag for t, _ in self.open):  # with what has been left open inside it
                while self.open.pop()[0] != tag:
                    pass
        elif tag in self.BREAKS:
            self.end_block()
        elif tag == "a":
            self.links = max(0, self.links - 1)

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.text.append(data)
            self.linked += len(data.split()) if self.links else 0


#: Words that a block needs to pay for itself, and what it costs to go from one container of the page to another.
BLOCK_COST, CROSSING = 0.5, 15.0


def densest_run(blocks: list[tuple[str, int, int, int, bool]]) -> tuple[int, int]:
    """(first, past the last) of the run of blocks with the greatest sum, the earliest of equals: words outside links pay, words in links and in asides cost, and so does each change of the container."""
    best, found = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, (_, words, linked, container, aside) in enumerate(blocks):
        gain = -float(words) if aside else words - 2 * linked - BLOCK_COST
        going_on = total - (CROSSING if i and container != blocks[i - 1][3] else 0.0)
        if going_on <= 0:
            total, start = gain, i
        else:
            total = going_on + gain
        if total > best:
            best, found = total, (start, i + 1)
    return found


def _main_text(html: str | None) -> str:
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.end_block()
    first, past = densest_run(p.blocks)
    return "\n".join(text for text, *_ in p.blocks[first:past])


@F.pandas_udf(T.StringType())
def main_text(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The body of a page, a line for each block: the run of blocks that is densest in text outside links. No names of classes are looked at."""
    for part in html:
        yield part.map(_main_text)


# Joiners at which a claim may part, openings of a part of its own, pronouns that go on with the subject before, and finite verbs.
JOINERS = (", and ", ", but ", ", while ", ", whereas ", "; and ", "; but ", "; ", ", because ", ", since ", ", which means ", ", which shows ", ", so ")
REPORTERS = "author authors researcher researchers study studies paper report analyst analysts company team spokesperson".split()
REASONS = ("because", "since", "which means", "which shows", "which suggests", "which implies", "so that", "therefore", "as a result")
PRONOUNS = "it they this that these those which who".split()
FINITE = (
    (
        "is are was were be been being has have had do does did can could may might must shall should will would take takes took taken make makes made show shows showed shown find finds found note notes noted report "
        "reports reported reveal reveals revealed reduce reduces reduced increase increases increased differ differs differed use uses used require requires required contain contains contained state states stated say "
        "says said mean means meant compute computes computed store stores stored retrieve retrieves retrieved publish publishes published sustain sustains sustained complete completes completed contradict "
        "contradicts contradicted grow grows grew depend depends depended"
    ).split()
)


def _listed(words: Iterable[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def own_subject_sql(clause: str) -> str:
    """Whether a clause begins anew, as a Spark SQL expression: with a reason or someone who reports, or with an article or a capital before a finite verb; without a verb only a clause of six words or more does.

    A verb is a known one, or past the first word one in -ed or -es; words with hyphens are none."""
    opening = f"rlike({clause}, r'(?i)^((the |a |an )?({'|'.join(REPORTERS)})|{'|'.join(REASONS)})([^A-Za-z0-9_]|$)')"
    verb = f"(arrays_overlap(v, array({_listed(FINITE)})) OR exists(slice(v, 2, size(v)), x -> length(x) > 3 AND (endswith(x, 'ed') OR endswith(x, 'es'))))"
    anew = f"(lower(w[0]) IN ('the', 'a', 'an') OR rlike(w[0], '^[A-Z][a-z]'))"
    goes_on = f"(size(w) < 3 OR {_let('f', "lower(trim(BOTH ',;' FROM w[0]))", f"f IN ({_listed(PRONOUNS)}) OR endswith(f, 'ing')")})"
    body = f"CASE WHEN size(w) = 0 THEN false WHEN {opening} THEN true WHEN NOT {verb} THEN size(w) >= 6 ELSE NOT {goes_on} AND {anew} END"
    plain = "filter(transform(w, x -> lower(trim(BOTH '.,;:()' FROM x))), x -> x <> '' AND NOT contains(x, '-'))"
    return _let("w", f"filter(split({clause}, r'\\s+'), x -> x <> '')", _let("v", plain, body))


def propositions_sql(claim: str) -> str:
    """The parts of a claim that state something of their own, as a Spark SQL expression.

    The clauses between joiners carry the rank of their joiner. Rank by rank, a clause opens a part if what reaches from it to the next clause of its rank, or to one that has opened a part already, has a subject of its own; the others go
    on with the part before."""
    edge, mark = "\x01", "\x02"
    joiners = "|".join(sorted(JOINERS, key=lambda j: (-len(j), j)))
    clauses = f"split(regexp_replace(trim(coalesce({claim}, '')), '({joiners})', '{edge}$1{mark}'), '{edge}')"
    joiner = f"if(i = 0, '', substring_index(p, '{mark}', 1))"
    told = f"transform({clauses}, (p, i) -> named_struct('joiner', {joiner}, 'rank', array_position(array({_listed(JOINERS)}), {joiner}), 'clause', substring_index(p, '{mark}', -1)))"
    rest, flags = "slice(s, i + 2, size(s))", "slice(o, i + 2, size(s))"
    until = _let("n", f"array_position(zip_with({rest}, {flags}, (x, f) -> f OR x.rank = r), true)", f"if(n = 0, {rest}, slice({rest}, 1, cast(n AS int) - 1))")
    reach = f"concat(q.clause, array_join(transform({until}, x -> concat(x.joiner, x.clause)), ''))"
    opened = f"aggregate(sequence(1, {len(JOINERS)}), transform(s, x -> false), (o, r) -> transform(s, (q, i) -> if(q.rank = r, {_let('t', reach, own_subject_sql('t'))}, o[i])))"
    goes_on = "concat(slice(parts, 1, size(parts) - 1), array(concat(element_at(parts, -1), s[i].joiner, s[i].clause)))"
    gathered = f"aggregate(if(size(s) > 1, sequence(1, size(s) - 1), cast(array() AS array<int>)), array(s[0].clause), (parts, i) -> if(o[i], concat(parts, array(s[i].clause)), {goes_on}))"
    return f"filter(transform({_let('s', told, _let('o', opened, gathered))}, p -> trim(BOTH ' ,;.' FROM p)), p -> p <> '')"


def propositions(claims: str) -> Column:
    """The parts of the claims in a column, by its name."""
    return F.expr(propositions_sql(claims))
