"""Operator 5: toxicity by cumulative-link ordinal regression over sparse text features.

Features of a text: its lower-cased words (runs of letters) and their proper beginnings of 3 to 8 letters, which stand for stems. From a bounded sample of
labelled documents, a covering pass chooses the features that mark toxic documents which few chosen features mark yet, as long as enough of those
have it and hardly any clean document does. The labels know toxic and clean only. The grades of the sample's toxic documents are their thirds by a margin out of fold: a binary model, fitted on the
other half of the sample, tells how far each stands from the clean ones; clean documents have grade 0. The proportional-odds model P(grade > j) = logistic(w x - t_j), with one w for all thresholds
t_1 < t_2 < t_3, is fitted by penalised maximum likelihood on sparse rows; x is log(1 + count) of each cue. Severity is the expected grade, the sum of the three probabilities; a document with
P(grade > 0) >= TOXIC_FROM is toxic.

Cases: null and empty text have the severity of a text without cues; texts are read whole; repeated rows get equal results; labels without a document, or with null
toxic, teach nothing, and of several labels for a document the larger counts; no toxic label: every severity is 0; an empty table gives an empty
result; columns named like the new ones are replaced, all others stay, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm.common import passing, small_batches

WORDS = re.compile(r"[^\W\d_]+")
GRADES = 3
#: Bound of the training sample: labelled documents whose cues reach the driver.
SAMPLE_ROWS = 20_000
#: Toxic documents that a cue must gain for each clean one that has it.
CLEAN_COST = 4
#: P(grade > 0) from which a document is toxic. Documents without cues are far below; this takes in those with one weak cue.
TOXIC_FROM = 0.25


def features_of_word(word: str) -> tuple[str, ...]:
    return ("=" + word, *(word[:n] + "*" for n in range(3, 9) if len(word) > n))


def counts_of(text: str | None) -> Counter:
    words = Counter(WORDS.findall(text.lower())) if text else Counter()
    out: Counter = Counter()
    for w, n in words.items():
        for f in features_of_word(w):
            out[f] += n
    return out


@dataclass
class OrdinalModel:
    cues: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def exceedance(self, x: SparseRows) -> np.ndarray:
        """P(grade > j) for j = 0, 1, 2: a row for each row of x."""
        if not len(self.cues):
            return np.zeros((x.n, GRADES))
        return 1 / (1 + np.exp(-np.clip(x.times(self.weights)[:, None] - self.thresholds[None, :], -40, 40)))


def cover(toxic: list[set[str]], clean: Counter, support: int, quota: int = 3) -> list[str]:
    """Greedy covering: the feature with most toxic documents that hold fewer than `quota` chosen cues, less CLEAN_COST for each clean document that has it,
    until fewer than `support` gain. A feature that begins like a chosen one, or the other way round, says the same and is passed over. Gains only fall, so a feature is counted anew only when it comes to the top."""
    holders: dict[str, set[int]] = {}
    for i, found in enumerate(toxic):
        for f in found:
            holders.setdefault(f, set()).add(i)
    open_docs = set(range(len(toxic)))
    gain = lambda f: len(holders[f] & open_docs) - CLEAN_COST * clean[f]
    heap = [(-g, len(f), f) for f in holders if (g := gain(f)) >= support]
    heapq.heapify(heap)
    held = [0] * len(toxic)
    chosen: list[str] = []
    stems: list[str] = []
    while heap:
        before, size, best = heapq.heappop(heap)
        stem = best.strip("=*")
        if any(stem.startswith(s) or s.startswith(stem) for s in stems) or (now := gain(best)) < support:
            continue
        if -before != now:
            heapq.heappush(heap, (-now, size, best))
            continue
        chosen.append(best)
        stems.append(stem)
        for i in holders[best]:
            held[i] += 1
            if held[i] >= quota:
                open_docs.discard(i)
    return chosen


@dataclass
class SparseRows:
    """Rows of n x d by the row, column and value of each entry."""

    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    n: int
    d: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.n)

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * g[self.row], self.d)

    def only(self, rows: np.ndarray) -> SparseRows:
        """The rows with these numbers, which are in order."""
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        inside = place[self.row] >= 0
        return SparseRows(place[self.row[inside]], self.col[inside], self.value[inside], len(rows), self.d)


def sparse(x: np.ndarray) -> SparseRows:
    row, col = np.nonzero(x)
    return SparseRows(row, col, x[row, col], *x.shape)


def fit_ordinal(x: SparseRows, grade: np.ndarray, penalty: float = 0.05, rounds: int = 1500, top: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the proportional-odds model of grades 0 to top, by gradient steps with a backtracking step length on the mean penalised log-likelihood."""
    n, d = x.n, x.d
    k = np.arange(top)
    rates = np.clip([(grade > j).mean() for j in k], 1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(-np.log(np.array(rates) / (1 - np.array(rates))) + 0.05 * k)
    params = np.concatenate([np.zeros(d), [start[0]], np.log(np.maximum(np.diff(start), 0.05))])

    def unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return p[:d], np.concatenate([[p[d]], p[d] + np.cumsum(np.exp(p[d + 1 :]))])

    def value(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, t = unpack(p)
        z = x.times(w)[:, None] - t[None, :]
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        edges = np.hstack([np.ones((n, 1)), s, np.zeros((n, 1))])
        slopes = np.hstack([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))])
        rows = np.arange(n)
        p_own = np.maximum(edges[rows, grade] - edges[rows, grade + 1], 1e-12)
        loss = -np.log(p_own).sum() + penalty * (w @ w)
        g = np.zeros((n, top + 2))
        g[rows, grade] -= slopes[rows, grade] / p_own
        g[rows, grade + 1] += slopes[rows, grade + 1] / p_own
        g = g[:, 1:-1]
        gt = -g.sum(axis=0)
        gaps = np.exp(p[d + 1 :])
        return loss / n, np.concatenate([x.transposed_times(g.sum(axis=1)) + 2 * penalty * w, [gt.sum()], [gaps[j] * gt[j + 1 :].sum() for j in range(top - 1)]]) / n

    step, (loss, grad), velocity = 1.0, value(params), np.zeros_like(params)
    for _ in range(rounds):
        velocity = 0.9 * velocity - step * grad
        new = params + velocity
        new_loss, new_grad = value(new)
        if new_loss > loss + 1e-12:
            step, velocity = step / 2, np.zeros_like(params)
            if step < 1e-6:
                break
        else:
            done = loss - new_loss < 1e-10
            params, loss, grad, step = new, new_loss, new_grad, min(step * 1.1, 64.0)
            if done:
                break
    return unpack(params)


def graded(x: SparseRows, toxic: np.ndarray) -> np.ndarray:
    """Grades of the rows: 0 for clean ones, 1 to GRADES for toxic ones by the quantiles of their margins out of fold. Rows of even and odd number are the two folds."""
    margin = np.zeros(x.n)
    for fold in (0, 1):
        learn, judge = np.arange(1 - fold, x.n, 2), np.arange(fold, x.n, 2)
        if 0 < toxic[learn].sum() < len(learn):
            weights, _ = fit_ordinal(x.only(learn), toxic[learn].astype(int), rounds=300, top=1)
            margin[judge] = x.only(judge).times(weights)
    cuts = np.quantile(margin[toxic], np.arange(1, GRADES) / GRADES)
    return np.where(toxic, 1 + np.searchsorted(cuts, margin, side="left"), 0)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, support: int = 3) -> OrdinalModel:
    """From at most sample_rows labelled documents, those first by a hash of doc_id. The driver gets the features that gain `support`, which are bounded by the sample, and for each of its rows those that it has."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample_rows ids and flags

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            totals: dict[str, list[int]] = {}
            for text, toxic in zip(batch["text"], batch["_toxic"]):
                for f in counts_of(text):
                    totals.setdefault(f, [0, 0])[int(toxic > 0)] += 1
            if totals:
                yield pd.DataFrame({"feature": list(totals), "clean": [v[0] for v in totals.values()], "toxic": [v[1] for v in totals.values()]})

    held = texts.mapInPandas(spread, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    candidates = held.where(F.col("toxic") - CLEAN_COST * F.col("clean") >= support).toPandas()
    clean = Counter(dict(zip(candidates["feature"], candidates["clean"])))
    names = set(candidates["feature"])

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [{f: n for f, n in counts_of(t).items() if f in names} for t in batch["text"]]
            if found:
                yield pd.DataFrame({"toxic": batch["_toxic"], "features": [list(x) for x in found], "counts": [list(x.values()) for x in found]})

    rows = texts.mapInPandas(present, "toxic int, features array<string>, counts array<int>").toPandas()
    # Rows in an order of their own, whatever order they came in: the folds and sums are the same in every run. Copies of one document teach the cover once.
    known_rows = sorted((t > 0, sorted(zip(f, (int(n) for n in c)))) for t, f, c in zip(rows["toxic"], rows["features"], rows["counts"]))
    once = sorted({(t, tuple(f for f, _ in x)) for t, x in known_rows})
    cues = {f: i for i, f in enumerate(cover([set(f) for t, f in once if t], clean, support))}
    if not cues:
        return OrdinalModel({}, np.zeros(0), np.zeros(GRADES))
    entries = [(i, cues[f], np.log1p(n)) for i, (_, x) in enumerate(known_rows) for f, n in x if f in cues]
    row, col, value = (np.array(v) for v in zip(*entries))
    x = SparseRows(row, col, value, len(known_rows), len(cues))
    weights, thresholds = fit_ordinal(x, graded(x, np.array([t for t, _ in known_rows])))
    return OrdinalModel(cues, np.round(weights, 9), np.round(thresholds, 9))


def scored(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """docs with severity (0 to 3), toxic_probability, grade (the likeliest) and toxic."""
    fields = [T.StructField("severity", T.DoubleType()), T.StructField("toxic_probability", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]
    kept = passing(docs.columns, (f.name for f in fields))
    schema = T.StructType([*(docs.schema[c] for c in kept), *fields])
    cues, at = model.cues, kept.index(text)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known: dict[str, tuple[int, ...]] = {}
        for batch in (whole.slice(s, 512) for whole in batches for s in range(0, whole.num_rows, 512)):
            rows, cols, counts = [], [], []
            for i, value in enumerate(batch.column(at)):
                value = value.as_py()
                found: Counter = Counter()
                for word in WORDS.findall(value.lower()) if value and cues else ():
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= 200_000:
                            known.clear()
                        ids = known[word] = tuple(cues[f] for f in features_of_word(word) if f in cues)
                    for j in ids:
                        found[j] += 1
                rows += [i] * len(found)
                cols += found.keys()
                counts += found.values()
            over = model.exceedance(SparseRows(np.array(rows, np.int64), np.array(cols, np.int64), np.log1p(np.array(counts, np.float64)), batch.num_rows, len(cues)))
            severity = np.round(over.sum(axis=1), 9)
            each = np.hstack([1 - over[:, :1], over[:, :-1] - over[:, 1:], over[:, -1:]])
            new = [pa.array(severity), pa.array(np.round(over[:, 0], 9)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(over[:, 0] >= TOXIC_FROM)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return docs.select(*kept).mapInArrow(work, schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    with small_batches(docs.sparkSession):
        model = fit(docs, labels)
    return scored(docs, model)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")
