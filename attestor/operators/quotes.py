"""Where a quote stands in a text: word for word in the matching form, closely, or not at all, with its offset.

Matching form: typographic quotes, dashes and the no-break space as plain ones, lower case, white space as one space. A quote of n characters is close to a text if a window of n characters,
one of those that begin at a multiple of n // 4, has a ratio of FUZZY_QUOTE with it; a text that is shorter than the quote is one window.

All quotes meet all texts, without loss, in tasks that hold some texts and read the quotes block by block from files of the shared folder. For each text and quote it is counted, for every distance between their
places, how many runs of q characters the two have in common at it. In a close window at most u = n - ceil(0.88 n) characters are left over on either side, so what matches forms at most 2 u + 1 stretches of
together n - u characters, shifted by u at most against the window's start: at least n - u - (2 u + 1)(q - 1) runs stand at distances within u of it. Windows below that, nearly all, are
dropped; then the longest common subsequence bounds the ratio; the ratio itself decides.
"""

from __future__ import annotations

import bisect
import difflib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.functions import text as tx
from attestor.functions.matching import FUZZY_QUOTE, SHORTEST_QUOTE
from attestor.sources import store

BLOCK_CHARACTERS = 60_000  # of quotes at once
FILE_ROWS = 20_000  # quotes in a file
ANCHOR = 32  # characters that a quote is found by where only exact places count
PIECE = 1 << 13  # starts of a text at once
RUNS = (8, 4, 3)  # lengths of runs that quotes are looked for by
KNOWN_BITS = 20  # of the table of buckets that hold a run of a quote
CELL = 16  # distances that are counted together at first
PAIRS = 1 << 21  # places of a text and a quote at once
_TO_PLAIN = str.maketrans(tx.TYPOGRAPHIC, tx.PLAIN)


def matching_form(text: str | None) -> str:
    text = text or ""
    for sign, plain in zip(tx.TYPOGRAPHIC, tx.PLAIN, strict=True):  # eight scans for single characters cost less than a table lookup for each
        text = text.replace(sign, plain)
    return " ".join(text.lower().split())


def original_offsets(text: str) -> list[int]:
    """The place in a text of each character of its matching form."""
    out: list[int] = []
    for m in re.finditer(r"\s+|\S", text.translate(_TO_PLAIN)):
        out += [m.start()] * (1 if m[0][0].isspace() else len(m[0].lower()))
    return out[1:] if text[:1] and text.translate(_TO_PLAIN)[0].isspace() else out


def left_over(n: int) -> int:
    """Characters of a quote of n, and of a window, that a close pair leaves unmatched at most."""
    return n - math.ceil(FUZZY_QUOTE * n - 1e-9)


def stretches(needle: str) -> int:
    """Stretches that what matches of a quote and a close window forms at most. From 200 characters on the ratio's matcher begins a stretch, but for one at the very start, at a character that stands in the quote in no more than a hundredth of it and one place."""
    n, most = len(needle), 2 * left_over(len(needle)) + 1
    return most if n < 200 else min(most, 1 + sum(c for c in Counter(needle).values() if c <= n // 100 + 1))


def runs_needed(needle: str, q: int) -> int:
    """Runs of q characters that a quote and a close window share at least."""
    return len(needle) - left_over(len(needle)) - stretches(needle) * (q - 1)


def run_length(needle: str) -> int:
    """How long the runs are that a quote is looked for by: the longer, the fewer stand in other texts."""
    return next((q for q in RUNS if runs_needed(needle, q) >= 1), RUNS[-1])


def grams(text: str, q: int) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < q:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(points) - q + 1, np.uint64)
    for i in range(q):
        out = out * np.uint64(0x100000001B3) + points[i : len(points) - q + 1 + i]
    return out


def bucket(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - KNOWN_BITS)


class Quotes:
    """Some quotes in their matching form, with an index of the places of their runs."""

    def __init__(self, ids: list, needles: list[str]) -> None:
        self.ids, self.needles = ids, needles
        self.size = np.array([len(n) for n in needles], np.int64)
        self.most = int(self.size.max(initial=0))
        self.slack = np.array([left_over(int(n)) for n in self.size], np.int64)
        lengths = [run_length(n) for n in needles]
        self.needed = np.array([runs_needed(n, q) for n, q in zip(needles, lengths, strict=True)], np.int64)
        self.bits: list[dict[str, int]] = []
        for needle in needles:
            places: dict[str, int] = {}
            for i, c in enumerate(needle):
                places[c] = places.get(c, 0) | 1 << i
            self.bits.append(places)
        #: For each q the quotes that are looked for by runs of q characters.
        self.index = []
        for q in RUNS:
            own = [k for k, length in enumerate(lengths) if length == q]
            if own:
                parts = [grams(needles[k], q) for k in own]
                g, k, y = np.concatenate(parts), np.repeat(np.arange(len(own), dtype=np.int32), [len(p) for p in parts]), np.concatenate([np.arange(len(p), dtype=np.int32) for p in parts])
                order = np.argsort(g, kind="stable")
                known = np.zeros(1 << KNOWN_BITS, bool)
                known[bucket(g)] = True
                self.index.append((q, np.array(own), known, g[order], k[order], y[order]))

    def meetings(self, text: str, start: int, width: int, q: int, known: np.ndarray, g: np.ndarray, k: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place of the quote in `own`, distance from `start` - most on) of the runs that text and quotes share, in slices of bounded size."""
        first = max(0, start - self.most)
        own = grams(text[first : start + width], q)
        hit = np.flatnonzero(known[bucket(own)])  # most runs of a text stand in no quote
        low, high = np.searchsorted(g, own[hit]), np.searchsorted(g, own[hit], side="right")
        held = high > low
        hit, low, times = hit[held], low[held], (high - low)[held]
        place = (hit + (first - start + self.most)).astype(np.int32)
        ends = np.cumsum(times)
        at = 0
        while at < len(hit):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS)))
            n = times[at:to]
            entry = np.repeat(low[at:to] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            d = np.repeat(place[at:to], n) - y[entry]
            ok = (d >= 0) & (d < width)
            yield (k[entry], d) if ok.all() else (k[entry[ok]], d[ok])
            at = to

    def distances(self, text: str, start: int, width: int, q: int, own: np.ndarray, *index: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(quote, how many runs it shares with the text at each distance) of the quotes of `own` that share enough of them in cells of CELL distances that a window could reach."""
        cells = width // CELL + 1
        slices = self.meetings(text, start, width, q, *index)
        held = list(islice(slices, 2))  # a single slice, as most texts have, is made once
        if not held or len(held) < 2 and (np.bincount(held[0][0], minlength=len(own)) < self.needed[own]).all():
            return
        coarse = np.zeros(len(own) * cells, np.int64)
        for k, d in chain(held, slices):
            coarse += np.bincount(k * cells + d // CELL, minlength=len(coarse))
        ends = np.cumsum(np.pad(coarse.reshape(len(own), cells), ((0, 0), (1, 0))), axis=1)
        spread = (2 * self.slack[own] // CELL + 2)[:, None]  # cells that a window's distances can lie in
        at = np.arange(cells)[None, :]
        most = (np.take_along_axis(ends, np.minimum(at + spread, cells), axis=1) - ends[:, :-1]).max(axis=1)
        places = np.flatnonzero(most >= self.needed[own])
        chosen = own[places]
        number = np.full(len(own), -1)
        number[places] = np.arange(len(places))
        fine = np.zeros(len(chosen) * width, np.int32)
        again = held if len(held) < 2 else self.meetings(text, start, width, q, *index)
        for k, d in again if len(chosen) else ():
            ok = number[k] >= 0
            fine += np.bincount(number[k[ok]] * width + d[ok], minlength=len(fine)).astype(np.int32)
        yield from zip(chosen.tolist(), fine.reshape(len(chosen), width), strict=True)

    def found(self, text: str) -> dict[int, tuple[str, int]]:
        """number of the quote: (class, offset in the matching form; -1 where a whole text is close) for all quotes that a text in its matching form holds or is close to."""
        out: dict[int, tuple[str, int]] = {}
        tried: dict[int, list[int]] = {}
        for start in range(0, max(1, len(text)), PIECE):
            starts = min(PIECE, len(text) - start)
            width = self.most + starts + left_over(self.most) + 1
            for q, own, *index in self.index:
                for k, row in self.distances(text, start, width, q, own, *index):
                    n = int(self.size[k])
                    last = min(starts, len(text) - n - start + 1)  # starts of windows from here on
                    if last <= 0 or k in out:
                        continue
                    for d in np.flatnonzero(row[self.most : self.most + last] >= n - q + 1).tolist():
                        if text.startswith(self.needles[k], start + d):
                            out[k] = "exact", start + d
                            break
                    else:
                        u, step = left_over(n), max(1, n // 4)
                        sums = np.concatenate([[0], np.cumsum(row)])
                        s = np.arange(-start % step, last, step) + self.most
                        near = s[sums[s + u + 1] - sums[s - u] >= self.needed[k]] - self.most + start
                        if len(near):
                            tried.setdefault(k, []).extend(near.tolist())
        for k, starts_of in tried.items():
            if k not in out and (at := next((s for s in starts_of if self.is_close(k, text[s : s + int(self.size[k])])), None)) is not None:
                out[k] = "fuzzy", at
        for k in np.flatnonzero(self.size > len(text)).tolist():
            if 2 * len(text) >= FUZZY_QUOTE * (self.size[k] + len(text)) - 1e-9 and self.is_close(k, text, whole=True):
                out[k] = "fuzzy", -1
        return out

    def is_close(self, k: int, window: str, whole: bool = False) -> bool:
        """The characters that the ratio counts stand in the same order in both, so the longest common subsequence bounds it."""
        needle = self.needles[k]
        owed = math.ceil(FUZZY_QUOTE / 2 * (len(needle) + len(window)) - 1e-9)
        if not reaches(self.bits[k], len(needle), window, owed):
            return False
        sides = (needle, window) if whole else (window, needle)
        return difflib.SequenceMatcher(None, *sides).ratio() >= FUZZY_QUOTE


def reaches(places: dict[str, int], n: int, text: str, owed: int) -> bool:
    """Whether the longest common subsequence of a string of n characters (places: the positions of each as bits) and a text may have `owed` characters. Given up where too many characters of the text have met none.

    What may be left over on either side also bounds how far apart the places of matched characters are, so only places in that band count."""
    every = (1 << n) - 1
    free, spare = every, len(text) - owed
    if spare < 0 or n < owed:
        return False
    shift = max(spare, n - owed)
    for start in range(0, len(text), 16):
        low = max(0, start - shift)
        band = ((1 << (start + 16 + shift - low)) - 1) << low
        for c in text[start : start + 16]:
            met = free & places.get(c, 0) & band
            free = ((free + met) | (free - met)) & every
        if min(start + 16, len(text)) - n + free.bit_count() > spare:
            return False
    return True


class ExactQuotes:
    """Some quotes in their matching form, looked for word for word: an automaton finds where the first ANCHOR characters of any stand, and the rest is compared there."""

    def __init__(self, ids: list, needles: list[str]) -> None:
        self.ids, self.needles = ids, needles
        own: dict[str, list[int]] = {}
        for k, needle in enumerate(needles):
            own.setdefault(needle[:ANCHOR], []).append(k)
        self.anchors = ahocorasick.Automaton()
        for anchor, at in own.items():
            self.anchors.add_word(anchor, (len(anchor), at))
        if own:
            self.anchors.make_automaton()

    def found(self, text: str) -> dict[int, tuple[str, int]]:
        """number of the quote: (exact, first offset in the matching form) for all quotes that a text in its matching form holds."""
        out: dict[int, tuple[str, int]] = {}
        for end, (size, own) in self.anchors.iter(text) if len(self.anchors) else ():
            start = end - size + 1
            for k in own:
                if k not in out and text.startswith(self.needles[k], start):
                    out[k] = "exact", start
        return out


class QuoteFiles:
    """Blocks of quotes from files of a shared folder; the blocks of the last file stay in memory."""

    def __init__(self, folder: str, close: bool = True) -> None:
        self.close = close
        self.files, root = fs.FileSystem.from_uri(folder)
        self.paths = sorted(f.path for f in self.files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file and f.base_name.endswith(".parquet"))
        self.held: tuple[str, list[Quotes] | list[ExactQuotes]] = ("", [])

    def __iter__(self) -> Iterator[Quotes]:
        for path in self.paths:
            if self.held[0] != path:
                with self.files.open_input_file(path) as f:
                    table = pq.read_table(f)
                ids, needles = table.column("quote_id").to_pylist(), [matching_form(x) for x in table.column("quote").to_pylist()]
                order = sorted((i for i in range(len(ids)) if len(needles[i]) >= SHORTEST_QUOTE), key=lambda i: len(needles[i]))
                ends = np.cumsum([len(needles[i]) for i in order]).tolist()
                blocks, at = [], 0
                if not self.close:
                    blocks, at = [ExactQuotes([ids[i] for i in order], [needles[i] for i in order])], len(order)
                while at < len(order):
                    to = max(at + 1, bisect.bisect(ends, (ends[at - 1] if at else 0) + BLOCK_CHARACTERS))
                    blocks.append(Quotes([ids[i] for i in order[at:to]], [needles[i] for i in order[at:to]]))
                    at = to
                self.held = (path, blocks)
            yield from self.held[1]


def met_needles(texts: DataFrame, needles: DataFrame, text: str, needle_id: str, needle: str) -> DataFrame:
    """needle_id of the needles that any of the texts holds, as they are. One pass over the texts, with the needles in files that tasks read; an automaton for each file finds all needles of it at once. Null matches nothing; an empty needle
    is in every text."""
    spark = texts.sparkSession
    folder = store.fresh_path(spark, "needles")
    needles.where(F.col(needle).isNotNull()).select(F.col(needle_id).alias("id"), F.col(needle).alias("needle")).write.option("maxRecordsPerFile", FILE_ROWS).parquet(folder)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(folder)
        paths = sorted(f.path for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file and f.base_name.endswith(".parquet"))
        held: tuple[str, dict[str, list], ahocorasick.Automaton | None] = ("", {}, None)
        met: set = set()
        for batch in batches:
            new = []
            for path in paths:
                if held[0] != path:
                    with files.open_input_file(path) as f:
                        table = pq.read_table(f)
                    ids: dict[str, list] = {}
                    for i, x in zip(table.column("id").to_pylist(), table.column("needle").to_pylist(), strict=True):
                        ids.setdefault(x, []).append(i)
                    found = ahocorasick.Automaton()
                    for x in ids:
                        if x:
                            found.add_word(x, x)
                    if len(found):
                        found.make_automaton()
                    held = (path, ids, found)
                _, ids, found = held
                for t in batch.iloc[:, 0]:
                    if t is not None:
                        hits = {x for _, x in found.iter(t)} if len(found) else set()
                        new += [i for x in hits | {""} for i in ids.get(x, ()) if i not in met]
                        met.update(new)
            yield pd.DataFrame({needle_id: pd.Series(sorted(set(new)), dtype="object")})

    schema = T.StructType([T.StructField(needle_id, needles.schema[needle_id].dataType)])
    return texts.select(text).mapInPandas(work, schema).distinct()


def shared_runs(texts: DataFrame, quotes: DataFrame, n: int = 3, text_id: str = "doc_id", text: str = "text", quote_id: str = "item_id", quote: str = "text") -> DataFrame:
    """text_id, quote_id of the texts and quotes that have n words in a row in common; words are what stands between single spaces, as given. One pass over the texts, which look their runs up in those of the quotes, read from files of the
    shared folder. Null and fewer words match nothing."""
    spark = texts.sparkSession
    folder = store.fresh_path(spark, "runs")
    quotes.where(F.col(quote).isNotNull()).select(F.col(quote_id).alias("quote_id"), F.col(quote).alias("quote")).write.option("maxRecordsPerFile", FILE_ROWS).parquet(folder)
    schema = T.StructType([T.StructField(text_id, texts.schema[text_id].dataType), T.StructField(quote_id, quotes.schema[quote_id].dataType)])

    def runs_of(t: str) -> Iterator[tuple[str, ...]]:
        words = t.split(" ")
        return zip(*(words[k:] for k in range(n)))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(folder)
        paths = sorted(f.path for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file and f.base_name.endswith(".parquet"))
        held: tuple[str, dict[tuple[str, ...], list]] = ("", {})
        for batch in batches:
            rows = []
            for path in paths:
                if held[0] != path:
                    with files.open_input_file(path) as f:
                        table = pq.read_table(f)
                    own: dict[tuple[str, ...], list] = {}
                    for i, x in zip(table.column("quote_id").to_pylist(), table.column("quote").to_pylist(), strict=True):
                        for r in set(runs_of(x)):
                            own.setdefault(r, []).append(i)
                    held = (path, own)
                own = held[1]
                for i, t in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                    if t is not None:
                        rows += [(i, k) for k in {k for r in runs_of(t) if r in own for k in own[r]}]
            yield pd.DataFrame(rows, columns=schema.names)

    rows = texts.select(text_id, text)
    cores = spark.sparkContext.defaultParallelism
    return (rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows).mapInPandas(work, schema).distinct()


def located(texts: DataFrame, quotes: DataFrame, text_id: str = "doc_id", text: str = "text", quote_id: str = "item_id", quote: str = "text", close: bool = True) -> DataFrame:
    """text_id, quote_id, quote_match (exact or fuzzy), offset (of the first place, in the text as it is; null where the whole text is the close window) for all pairs that match. Null texts and
    quotes, and quotes of fewer than SHORTEST_QUOTE characters, match nothing. Without `close` the exact ones only, which an automaton finds at a fraction of the work. One pass over the texts, without a shuffle where they have as many partitions as there are cores."""
    spark = texts.sparkSession
    folder = store.fresh_path(spark, "quotes")
    quotes.where(F.col(quote).isNotNull()).select(F.col(quote_id).alias("quote_id"), F.col(quote).alias("quote")).write.option("maxRecordsPerFile", FILE_ROWS).parquet(folder)
    schema = T.StructType([
        T.StructField(text_id, texts.schema[text_id].dataType), T.StructField(quote_id, quotes.schema[quote_id].dataType), T.StructField("quote_match", T.StringType()), T.StructField("offset", T.IntegerType()),
    ])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = QuoteFiles(folder, close)
        for batch in batches:
            rows = []
            whole = [(i, t, matching_form(t)) for i, t in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True) if t]
            for block in files:
                for i, t, form in whole:
                    got = block.found(form) if form else {}
                    places = original_offsets(t) if got else []
                    rows += [(i, block.ids[k], kind, places[at] if at >= 0 else None) for k, (kind, at) in got.items()]
            out = pd.DataFrame(rows, columns=schema.names)
            yield out.astype({"offset": "Int64"})

    rows = texts.select(text_id, text)
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # a small table in a few files: its texts are dealt out, for the work on each is long
        rows = rows.repartition(cores)
    return rows.mapInPandas(work, schema)
