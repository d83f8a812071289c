"""Operator 7: quality by random Fourier features, ridge regression and isotonic calibration.

A document is described by STATISTICS of its whole text. Standardised, they go through D random Fourier features, cos and sin of random projections, whose products
approximate a Gaussian kernel. Each partition sums its part of the normal equations; the sums of equal positions are added up, and the driver solves one
system of fixed size. For the calibration, the rows fall in two halves by a hash of their statistics, so that copies fall together; each half is scored by a system that was solved from the other one
(where a half has labels of one kind only: by that of all).
These scores, in bins of fixed width, are made monotone by pooling adjacent violators, and that table maps a score to a probability.

Cases: null and empty text has the statistics of no words, and a score; labels without a document or with null quality teach nothing, and of several labels for a
document the smallest counts; with labels of one kind, or none, every score is that kind's share (0.5 if none); repeated rows get equal results; texts are read
whole; an empty table gives an empty result; columns named like the new ones are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm.common import passing, written

FOURIER = 192
BINS = 512
RIDGE = 1.0
STATISTICS = (
    "log_words", "log_lines", "mean_word", "sd_word", "distinct_share", "top_word_share", "repeated_next_share", "upper_share", "digit_share", "mark_share", "odd_mark_share",
    "marked_word_share", "lone_mark_share", "repeated_line_share", "words_a_line", "capital_word_share", "end_mark_share", "packed_share", "non_ascii_share", "repeated_pair_share",
)
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_ODD = b"#$%&*+<=>@[]^_`{|}~\\!"
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"
_ENDS = re.compile(rb"[.!?]+(?=\s|$)")


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8")
    words = data.split()
    n, size = len(words), max(1, len(data))
    if not n:
        return [0.0] * len(STATISTICS)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lower = data.lower().split()
    counts = Counter(lower)
    lines = [x for x in data.split(b"\n") if x.strip()]
    same_next = sum(map(bytes.__eq__, lower[1:], lower[:-1]))
    pairs = Counter(zip(lower, lower[1:]))
    drop = lambda chars: len(data) - len(data.translate(None, chars))
    ends = [w[-1] for w in words]
    return [
        np.log1p(n), np.log1p(len(lines)), float(lengths.mean()), float(lengths.std()), len(counts) / n, max(counts.values()) / n, same_next / n, drop(_UPPER) / size, drop(_DIGITS) / size, drop(_MARKS) / size, drop(_ODD) / size,
        sum(e in _ODD for e in ends) / n, sum(len(w) == 1 and w in _MARKS for w in words) / n, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(65 <= w[0] <= 90 for w in words) / n, len(_ENDS.findall(data)) / n,
        len(zlib.compress(data, 1)) / size, (len(data) - len(text)) / size, 1 - len(pairs) / max(1, n - 1) if n > 1 else 0.0,
    ]


def described(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and stats array<double>."""
    kept = passing(keep, ["stats"])
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py()) for t in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found, pa.list_(pa.float64()))], names=schema.names)

    return docs.select(*kept, text).mapInArrow(work, schema)


@dataclass
class QualityModel:
    center: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # of the Fourier features and a constant; empty: `constant` for all
    steps: np.ndarray  # calibrated probability of each bin of the raw score
    constant: float

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.center) / self.spread, -6, 6)
        z = x @ projections(x.shape[1])
        return np.hstack([np.cos(z), np.sin(z), np.ones((len(x), 1))]) * np.append(np.full(FOURIER, np.sqrt(2 / FOURIER)), 1.0)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), self.constant)
        return np.round(self.steps[bin_of(self.fourier(stats) @ self.weights)], 9)


def projections(d: int, width: float = 4.0, seed: int = 11) -> np.ndarray:
    """d x FOURIER/2 normal draws: the spectrum of a Gaussian kernel of that width."""
    return np.random.default_rng(seed).normal(size=(d, FOURIER // 2)) / width


def bin_of(raw: np.ndarray) -> np.ndarray:
    """Bins of equal width from -0.5 to 1.5."""
    return np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)


def isotonic(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing probability of each bin by pooling adjacent violators, with half a good and half a bad row added to each pool; empty bins are filled in a straight line."""
    pools: list[list[float]] = []
    for i in np.flatnonzero(total):
        pools.append([good[i], total[i], i, i])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            g, t, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + g, pools[-1][1] + t, pools[-1][2], last]
    at, value = [], []
    for g, t, first, last in pools:
        at += [first, last]
        value += [(g + 0.5) / (t + 1)] * 2
    return np.maximum.accumulate(np.interp(np.arange(len(total)), at, value))


def fit(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """stats: doc_id, stats (written). labels: doc_id, quality; all labelled rows teach. Only sums of fixed size reach the driver."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).cast("double").alias("y"))
    rows = written(stats.join(known, "doc_id").select("stats", "y", (F.abs(F.xxhash64("stats")) % 2).cast("int").alias("half")), "labelled_stats")
    d = len(STATISTICS)

    def summed(features, width: int) -> np.ndarray:
        """Adds up features(stats, y, half), one vector of fixed width a partition, by position."""

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(width)
            for b in batches:
                if len(b):
                    total += features(np.stack(b["stats"].to_numpy()), b["y"].to_numpy(), b["half"].to_numpy())
            at = np.flatnonzero(total)
            yield pd.DataFrame({"at": at, "value": total[at]})

        out = np.zeros(width)
        for r in rows.mapInPandas(work, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
            out[r["at"]] = r["value"]
        return out

    m = summed(lambda x, y, half: np.concatenate([[len(x), y.sum()], x.sum(axis=0), (x * x).sum(axis=0), np.bincount((2 * half + y).astype(int), minlength=4)]), 6 + 2 * d)
    n, good = m[0], m[1]
    model = QualityModel(np.zeros(d), np.ones(d), np.zeros(0), np.zeros(BINS), float(good / n) if n else 0.5)
    if not 0 < good < n:
        return model
    model.center = np.round(m[2 : 2 + d] / n, 9)
    model.spread = np.round(np.sqrt(np.maximum(m[2 + d : 2 + 2 * d] / n - (m[2 : 2 + d] / n) ** 2, 1e-12)), 9)
    # Both kinds weigh the same in the fit; the calibration brings their shares back.
    heavy = (0.5 * n / (n - good), 0.5 * n / good)
    width = FOURIER + 1
    upper = np.triu_indices(width)

    part = len(upper[0]) + width

    def normal(x: np.ndarray, y: np.ndarray, half: np.ndarray) -> np.ndarray:
        z, w = model.fourier(x), np.where(y > 0, heavy[1], heavy[0])
        sums = []
        for own in (half == 0, half == 1):
            weighted = (z[own] * w[own][:, None]).T
            sums += [(weighted @ z[own])[upper], weighted @ y[own]]
        return np.concatenate(sums)

    def solved(sums: np.ndarray) -> np.ndarray:
        gram = np.zeros((width, width))
        gram[upper] = sums[: len(upper[0])]
        gram = gram + np.triu(gram, 1).T
        return np.round(np.linalg.solve(gram + RIDGE * np.eye(width), sums[len(upper[0]) :]), 9)

    sums = summed(normal, 2 * part)
    model.weights = solved(sums[:part] + sums[part:])
    # Weights for a half, from the other one; where a half lacks one kind, as among a few rows, the weights of all stand in.
    of_other = np.stack([solved(sums[part:]), solved(sums[:part])] if (m[-4:] > 0).all() else [model.weights] * 2)

    def binned(x: np.ndarray, y: np.ndarray, half: np.ndarray) -> np.ndarray:
        at = bin_of((model.fourier(x) * of_other[half]).sum(axis=1))
        return np.concatenate([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])

    counts = summed(binned, 2 * BINS)
    model.steps = isotonic(counts[:BINS], counts[BINS:])
    return model


def scored(stats: DataFrame, model: QualityModel) -> DataFrame:
    """stats with score in place of stats."""
    kept = passing(stats.columns, ["stats", "score"])
    schema = T.StructType([*(stats.schema[c] for c in kept), T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["stats"].to_numpy()) if len(b) else np.zeros((0, len(STATISTICS)))
            yield b[kept].assign(score=model.score(x))

    return stats.select(*kept, "stats").mapInPandas(work, schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    stats = written(described(docs), "document_stats")
    out = scored(stats, fit(stats, labels.where(~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def with_score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """docs with score, in one pass over the texts."""
    kept = passing(docs.columns, ["score"])
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType())])
    at = kept.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                b = whole.slice(s, 512)
                x = np.array([statistics(t.as_py()) for t in b.column(at)]).reshape(-1, len(STATISTICS))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x), pa.float64())], names=schema.names)

    return docs.select(*kept).mapInArrow(work, schema)
