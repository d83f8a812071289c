"""Operator 11: runs of a repeated stretch of words, by Crochemore's refinement of position classes.

A class of level k holds the positions where equal factors of k words begin. Level k + 1 follows from level k: two positions of a class part where the positions after them stand in
different classes. Only the smaller children of a class that has split need to be looked at, so a word is moved a logarithmic number of times. Neighbours of a class of level k that
are k apart begin a square whose root is no repetition itself; squares at consecutive positions make up a run.

A run that repeats its period r times has r - 1 positions at least in the class of each of its squares. A factor that stands fewer times is dead, and so is every longer one that
begins there or one word before; dead positions leave their classes, so words that are not repeated cost little. While a level has at most half of the positions of the one before,
its classes are made by sorting pairs, else by moving the smaller halves.

Cases: null and empty text, and text of white space, has no words and no runs; a null id is allowed; a text of any length is read whole, in memory of some hundred bytes a word; repeated rows get equal
results; equal words are equal bytes of UTF-8; an empty table gives an empty result; columns named like the new ones, in any case of letters, are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from attestor.llm.common import passing

SHORTEST = 6  # words of a run at least
REPEATS = 4  # times that a run holds its period at least
ROWS = 256  # texts worked on at once

Run = tuple[int, int, int]  # start, length, period


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal ones."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def joined(starts: list[int], period: int, shortest: int, repeats: int) -> Iterator[Run]:
    """The runs of one period from the ascending starts of its squares."""
    first = last = -2
    for i in [*starts, -1]:
        if i == last + 1 and i >= 0:
            last = i
            continue
        if first >= 0 and (length := last - first + 2 * period) >= max(shortest, repeats * period):
            yield first, length, period
        first = last = i


class Classes:
    """Position classes of one level as linked lists in ascending order, which `refine` takes to the next level by the smaller halves."""

    def __init__(self, members: np.ndarray, labels: np.ndarray, n: int, level: int, longest: int, rare: int) -> None:
        """members: the living positions by class and position, labels: their classes."""
        self.level, self.longest, self.rare = level, longest, rare
        label, after, before = (np.full(n + 1, -1, np.int32) for _ in range(3))
        label[members] = labels
        same = labels[1:] == labels[:-1]
        after[members[:-1][same]] = members[1:][same]
        before[members[1:][same]] = members[:-1][same]
        edges = np.flatnonzero(np.concatenate([[True], ~same]))
        self.head = dict(zip(labels[edges].tolist(), members[edges].tolist(), strict=True))
        self.size = dict(zip(labels[edges].tolist(), np.diff(np.append(edges, len(members))).tolist(), strict=True))
        self.label, self.after, self.before = (array("i", x.tobytes()) for x in (label, after, before))
        self.fresh = int(labels.max()) + 1
        self.by_gap: dict[int, list[int]] = defaultdict(list)  # distance to the next of the class: positions; the lists may hold positions for which that has changed
        gaps = after - np.arange(n + 1)
        for i in np.flatnonzero((gaps > level) & (gaps <= longest)).tolist():
            self.by_gap[int(gaps[i])].append(i)
        self.small = [self.members(c) for c in self.head]  # to begin with, all classes are looked at
        self.fallen = (members[label[members + 1] < 0] + 1).tolist()  # positions that have died since the level before and follow a living one

    def members(self, c: int) -> list[int]:
        out, i, after = [], self.head[c], self.after
        while i >= 0:
            out.append(i)
            i = after[i]
        return out

    def link(self, i: int, j: int) -> None:
        """j follows i in their class."""
        self.after[i], self.before[j] = j, i
        if self.level < j - i <= self.longest:
            self.by_gap[j - i].append(i)

    def leave(self, i: int, c: int) -> None:
        a, b = self.after[i], self.before[i]
        if b < 0:
            self.head[c] = a
            if a >= 0:
                self.before[a] = -1
        elif a < 0:
            self.after[b] = -1
        else:
            self.link(b, a)
        self.size[c] -= 1

    def refine(self) -> None:
        label, size, head = self.label, self.size, self.head
        dead: list[int] = []
        children: dict[int, list[int]] = {}
        for j in self.fallen:
            if j and (c := label[j - 1]) >= 0:
                children.setdefault(c, [])
                self.leave(j - 1, c)
                label[j - 1] = -1
                dead.append(j - 1)
        for group in self.small:  # one class of this level
            into: dict[int, int] = {}
            last: dict[int, int] = {}
            for j in group:
                if not j or (c := label[j - 1]) < 0:
                    continue
                i = j - 1
                self.leave(i, c)
                if (new := into.get(c)) is None:
                    new = into[c] = self.fresh
                    self.fresh += 1
                    children.setdefault(c, []).append(new)
                    head[new], size[new] = i, 0
                    self.before[i] = -1
                else:
                    self.link(last[c], i)
                self.after[i] = -1
                label[i], last[c] = new, i
                size[new] += 1
        self.small = []
        for c, new in children.items():
            new.append(c)
            largest = max(new, key=size.__getitem__)
            for d in new:
                if size[d] < self.rare:
                    for i in self.members(d) if size[d] else ():
                        label[i] = -1
                        dead.append(i)
                    del size[d], head[d]
                elif d != largest:
                    self.small.append(self.members(d))
        self.fallen = dead
        self.level += 1

    def squares(self) -> list[int]:
        """Ascending starts of the squares whose root has as many words as the level."""
        k = self.level
        return sorted({i for i in self.by_gap.pop(k, ()) if self.label[i] >= 0 and self.after[i] == i + k})


def runs_of(ids: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS) -> list[Run]:
    """All runs of at least `shortest` items that hold their smallest period `repeats` times (two at least), by start and period."""
    n, rare = len(ids), max(2, repeats - 1)
    longest = n // repeats
    found: list[Run] = []
    if n < max(shortest, repeats):
        return found
    alive, label, level = np.arange(n), np.append(ids, -1), 1
    alive = alive[np.bincount(ids)[ids] >= rare]
    label = np.full(n + 1, -1, np.int64)
    label[alive] = ids[alive]
    while len(alive):
        order = alive[np.argsort(label[alive], kind="stable")]
        labels = label[order]
        starts = order[:-1][(labels[1:] == labels[:-1]) & (np.diff(order) == level)]
        found += joined(np.sort(starts).tolist(), level, shortest, repeats)
        if level == longest:
            break
        going = alive[label[alive + 1] >= 0]
        _, pair, times = np.unique(label[going] * (n + 1) + label[going + 1], return_inverse=True, return_counts=True)
        often = times[pair] >= rare
        if 2 * np.count_nonzero(often) > len(alive):
            classes = Classes(order, labels, n, level, longest, rare)
            while classes.size and classes.level < longest:
                classes.refine()
                found += joined(classes.squares(), classes.level, shortest, repeats)
            break
        label = np.full(n + 1, -1, np.int64)
        alive, label[going[often]], level = going[often], pair[often], level + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document with the repetition that its id sets in: none for nine ids of ten."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_BEST = ("start", "length", "period", "exponent_milli")


def periodic(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), runs: bool = True, collapsed: bool = True, digests: bool = False,
    change: Callable[[list[bytes], object], list[bytes]] | None = None, shortest: int = SHORTEST, repeats: int = REPEATS,
) -> DataFrame:
    """The columns `keep`, n_runs, and the greatest run (start, length, period, exponent_milli; ties: the smallest start, then period). As asked for: runs, an array of all; collapsed, the text
    without repetitions; runs_sha256 and collapsed_sha256. `change` makes a document's words other ones, from them and the first column of keep. One pass, no shuffle."""
    fields = [T.StructField(c, T.LongType()) for c in ("n_runs", *_BEST)]
    fields += [T.StructField("runs", T.ArrayType(_RUN))] * runs + [T.StructField("collapsed", T.StringType())] * collapsed
    fields += [T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256") if digests]
    kept = passing(keep, (f.name for f in fields))
    schema = T.StructType([*(docs.schema[c] for c in kept), *fields])
    run_type = pa.list_(pa.struct([(f.name, pa.int64()) for f in _RUN]))

    def row(value: str | None, first: object) -> list:
        words = (value or "").encode().split()
        if change:
            words = change(words, first)
        found = runs_of(numbered(words), shortest, repeats)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        out = [len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)]
        if runs:
            out.append([dict(zip(_RUN.names, r, strict=True)) for r in found])
        whole = b" ".join(kept_words(words, found)) if collapsed or digests else b""
        if collapsed:
            out.append(whole.decode())
        if digests:
            out += [hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest(), hashlib.sha256(whole).hexdigest()]
        return out

    types = [pa.int64()] * 5 + [run_type] * runs + [pa.string()] * (collapsed + 2 * digests)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                first = batch.column(0) if kept else [None] * batch.num_rows
                rows = [row(t.as_py(), i.as_py() if i is not None else None) for t, i in zip(batch.column(len(kept)), first, strict=True)]
                made = [pa.array(list(column), kind) for column, kind in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], kind) for kind in types]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=schema.names)

    return docs.select(*kept, text).mapInArrow(work, schema)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return periodic(docs, runs=False, collapsed=False, digests=True, change=planted)
