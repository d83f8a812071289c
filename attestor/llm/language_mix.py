"""Operator 13: the languages of a text as a mixture, by expectation-maximisation over n-grams.

Learning counts, for every language of the labels, how often each letter n-gram stands in its texts: runs of ORDER code points of the lower-case text, other characters than letters being one
space, in 2**BITS bins. Counts are summed task by task, then by bin. Each language gives an n-gram a probability, with SMOOTH added to every bin, so that unseen ones count against no language alone.

A text is taken as n-grams drawn from a mixture of the languages. EM finds the proportions that make it likeliest. Languages then go in order of
proportion: the first one alone, the first two, and so on, each set with proportions of its own, and the set with the greatest log-likelihood less its price wins. A further language costs
PRICE times the logarithm of the number of n-grams, since n-grams that overlap are not independent. The prediction is the language of the greatest proportion in the set, with that proportion as its score.

Cases: null text, and text without a letter, is `und` with score 0 and no languages, and so is every text where nothing was learned; null languages teach nothing, an empty string
is a language like others; ties go to the language that is first by code point; texts are read whole, piece by piece; repeated rows get equal results; an empty table gives an empty result; columns named like
the new ones, in any case of letters, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm.common import passing

ORDER = 3
BITS = 16
SMOOTH = 0.05
PRICE = 6.0
STEPS = 60  # of EM at most
PIECE = 1 << 20  # characters worked on at once
ROWS = 256
UNKNOWN = "und"


def grams(text: str) -> Iterator[np.ndarray]:
    """Bins of the n-grams of each piece of a text, in order; n-grams across two pieces are of the second. A text without letters has none."""
    tail = np.array([32], np.uint32)  # the text begins and ends with a space
    for start in range(0, len(text), PIECE):
        piece = text[start : start + PIECE].lower()
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not piece.isalpha():
            ascii_letter = (points >= 97) & (points <= 122)
            other = np.flatnonzero(~ascii_letter)
            kinds, at = np.unique(points[other], return_inverse=True)
            letter = np.array([chr(p).isalpha() for p in kinds.tolist()], bool)
            points = points.copy()
            points[other[~letter[at]]] = 32
        points = np.concatenate([tail, points, np.array([32] * (start + PIECE >= len(text)), np.uint32)])
        points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
        if len(points) >= ORDER:
            mixed = np.zeros(len(points) - ORDER + 1, np.uint64)
            for i in range(ORDER):
                mixed = mixed * np.uint64(0x9E3779B1) + points[i : len(points) - ORDER + 1 + i]
            mixed *= np.uint64(0x9E3779B97F4A7C15)
            yield (mixed >> np.uint64(64 - BITS)).astype(np.int64)
        tail = points[-(ORDER - 1) :]


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct bins of a text and how often each stands."""
    pieces = list(grams(text or ""))
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0)
    if len(pieces) > 1:
        whole = sum(np.bincount(p, minlength=1 << BITS) for p in pieces)
        bins = np.flatnonzero(whole)
        return bins, whole[bins].astype(float)
    bins, times = np.unique(pieces[0], return_counts=True)
    return bins, times.astype(float)


@dataclass
class LanguageModel:
    languages: list[str]  # by code point
    chances: np.ndarray  # of each bin (rows) in each language (columns)

    def mixture(self, text: str | None) -> tuple[list[int], np.ndarray]:
        """The languages of the text, by descending proportion, and their proportions; none without letters."""
        bins, times = counted(text)
        if not len(bins) or not self.languages:
            return [], np.zeros(0)
        p = self.chances[bins]
        n = times.sum()
        share, best = proportions(p, times)
        order = np.lexsort((np.arange(len(share)), -share))
        price = PRICE * np.log(n + 1)
        chosen: tuple[list[int], np.ndarray] | None = None
        most = -np.inf
        for size in range(1, len(order) + 1):
            if best - price * (size - 1) <= most:  # no larger set can reach the best one: `best` is the likelihood of all languages together
                break
            own = order[:size]
            part, likelihood = (np.ones(1), float(times @ np.log(p[:, own[0]]))) if size == 1 else proportions(p[:, own], times)
            if likelihood - price * (size - 1) > most:
                most = likelihood - price * (size - 1)
                again = np.lexsort((own, -part))
                chosen = [int(own[i]) for i in again], part[again]
        assert chosen
        return chosen


def proportions(p: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
    """EM from equal shares: the proportions of the columns of p that make the counts likeliest, and that log-likelihood."""
    share, n = np.full(p.shape[1], 1 / p.shape[1]), times.sum()
    for _ in range(STEPS):
        new = share * (p.T @ (times / (p @ share))) / n
        near = np.abs(new - share).max() < 1e-4
        share = new
        if near:
            break
    share = np.round(share / share.sum(), 9)
    return share, float(times @ np.log(p @ share))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """From all rows with a language. A number for each language and bin that is seen reaches the driver, summed up: the size of the model."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1), strict=True):
                total = sums.setdefault(name.as_py(), np.zeros(1 << BITS, np.int64))
                bins, times = counted(t.as_py())
                total[bins] += times.astype(np.int64)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1), pa.string()), pa.array([-1, *at.tolist()], pa.int32()), pa.array([0, *total[at].tolist()], pa.int64())], names=["lang", "bin", "n"])

    counts = docs.where(F.col(lang).isNotNull()).select(text, lang).mapInArrow(work, "lang string, bin int, n long")
    table = counts.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    chances = np.full((1 << BITS, len(languages)), SMOOTH)
    seen = table[table["bin"] >= 0]
    chances[seen["bin"].to_numpy(), pd.Categorical(seen["lang"], languages).codes] += seen["n"].to_numpy()
    return LanguageModel(languages, chances / chances.sum(axis=0))


def identified(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred, score, and languages and proportions of the mixture. One pass, no shuffle."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("proportions", T.ArrayType(T.DoubleType()))]
    kept = passing(keep, (f.name for f in fields))
    schema = T.StructType([*(docs.schema[c] for c in kept), *fields])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                found = [m.mixture(t.as_py()) for t in batch.column(len(kept))]
                names = [[m.languages[i] for i in own] for own, _ in found]
                made = [
                    pa.array([x[0] if x else UNKNOWN for x in names], pa.string()), pa.array([float(s[0]) if len(s) else 0.0 for _, s in found], pa.float64()),
                    pa.array(names, pa.list_(pa.string())), pa.array([s.tolist() for _, s in found], pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=schema.names)

    return docs.select(*kept, text).mapInArrow(work, schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def op13_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    model = learn(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("text", "lang"))
    return identified(docs.select("doc_id", out, "text"), model, keep=("doc_id", "held_out"))
