"""Operator 9: mixing sources to target weights by a low-discrepancy schedule.

Every source's documents, in the order of a hash, are one stream of words that begins anew when it ends, cut into blocks of BLOCK_WORDS. A schedule has a slot
for each block that the mix takes. Slot i belongs to the source in whose share of the cumulated targets the point frac(i * golden ratio) lies, so any
stretch of the schedule has nearly the mix's shares. The slots of a source are ranked, and slot of rank r takes block r. The ranks beyond a source's quota are left
out and missing ones stand at the end, so a source gives its target, to the word.

Targets share the words of all documents by weight; none is above 3 times the source's own words, and what is cut off goes to the others by weight.

Cases: null source is a source of its own, the last; null text and text without words have size 0 and nothing is taken; repeated rows are documents of
their own; no words at all: all targets are 0; an empty table gives an empty result; columns named like the new ones are replaced. The number of sources is checked: their table goes to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import prefix_sums, written

BLOCK_WORDS = 256
REPEATS = 3
MAX_SOURCES = 1_000_000
#: Bytes of the table of sources that is broadcast at most with its names.
BROADCAST_BYTES = 64 << 20
#: 2**64 divided by the golden ratio.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD.pattern)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight, held at `most` times each size; the excess is shared anew by weight among the others until none is above."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        heavy = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] > heavy * most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / heavy if heavy else 0.0
            break
        for i in over:
            out[i] = float(most * sizes[i])
            free.discard(i)
        left -= sum(out[i] for i in over)
    return out


@dataclass
class Mix:
    """placed: the rows with _source (number), _start (words of its source before it), _whole (words of its source). sources: a row each. schedule: slot, _source, block, words. takes: row keys with epoch, words and the first slot."""

    placed: DataFrame
    sources: DataFrame
    schedule: DataFrame
    takes: DataFrame


def mix(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), block: int = BLOCK_WORDS) -> Mix:
    """sized: written table of doc_id, source, size, tie (any long that tells apart rows of one doc_id)."""
    spark = sized.sparkSession
    table = sized.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(table) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    own = [r["source_size"] for r in table]
    goal = targets(own, [weights[i % len(weights)] for i in range(len(own))])
    words = [min(round(t), REPEATS * s) for t, s in zip(goal, own, strict=True)]
    quota = [-(-w // block) for w in words]
    rows = [(i, r["source"], own[i], goal[i], words[i], quota[i]) for i, r in enumerate(table)]
    sources = spark.createDataFrame(rows, "_source int, source string, source_size long, target double, _words long, _quota long")

    bounds = np.cumsum(np.array(quota, dtype=np.float64))
    total = int(sum(quota))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            slot = b["id"].to_numpy()
            point = (slot.astype(np.uint64) + np.uint64(1)) * GOLDEN
            u = (point >> np.uint64(11)).astype(np.float64) / 2.0**53 * bounds[-1]
            yield pd.DataFrame({"slot": slot, "_source": np.minimum(np.searchsorted(bounds, u, side="right"), len(bounds) - 1).astype(np.int32)})

    slots = written(spark.range(total).mapInPandas(assign, "slot long, _source int") if total else spark.createDataFrame([], "slot long, _source int"), "slots")
    ranked = prefix_sums(slots.withColumn("_key", F.col("slot") * F.lit((2**63 - 1) // max(1, total))), ["_source"], "_key", [F.col("slot").asc()], F.lit(1), "block")
    quotas = F.broadcast(sources.select("_source", "_words", "_quota"))  # MAX_SOURCES rows at most
    counted = slots.groupBy("_source").agg(F.count(F.lit(1)).alias("_had"))
    missing = sources.join(F.broadcast(counted), "_source", "left").withColumn("_had", F.coalesce("_had", F.lit(0))).where("_had < _quota")
    missing = missing.select(F.lit(total).cast("long").alias("slot"), "_source", F.explode(F.sequence("_had", F.col("_quota") - 1)).alias("block"))
    schedule = ranked.select("slot", "_source", F.col("block").cast("long").alias("block")).unionByName(missing).join(quotas, "_source").where("block < _quota")
    schedule = written(schedule.select("slot", "_source", "block", F.least(F.lit(block).cast("long"), F.col("_words") - F.col("block") * block).alias("words")), "schedule")

    named = sources.select("_source", F.col("source").alias("_name"), F.col("source_size").alias("_whole"), "_words")
    if sum(len((r["source"] or "").encode()) + 32 for r in table) <= BROADCAST_BYTES:
        named = F.broadcast(named)
    keyed = sized.join(named, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    keyed = keyed.withColumn("_order", F.xxhash64(F.lit(9), "doc_id", "tie"))
    placed = written(prefix_sums(keyed, ["_source"], "_order", [F.col("doc_id").asc_nulls_first(), F.col("tie").asc(), F.col("size").asc()], F.col("size"), "_start").drop("_order"), "placed")

    # A document's piece of each block that it lies in, in each run through its source.
    passes = placed.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1)))).withColumn("_low", F.col("_start") + F.col("epoch") * F.col("_whole")).where(F.col("_low") < F.col("_words"))
    pieces = passes.withColumn("block", F.explode(F.sequence(F.floor(F.col("_low") / block), F.floor((F.col("_low") + F.col("size") - 1) / block))))
    met = pieces.join(schedule, ["_source", "block"])
    start = F.col("block") * block
    overlap = F.least(F.col("_low") + F.col("size"), start + F.col("words")) - F.greatest("_low", start)
    takes = met.withColumn("_overlap", overlap).where("_overlap > 0").groupBy("_source", "_start", "doc_id", "size", "tie", "epoch").agg(F.sum("_overlap").cast("long").alias("words"), F.min("slot").alias("slot"))
    return Mix(placed, sources, schedule, takes)


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size, tie of docs, written."""
    tie = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return written(docs.select("doc_id", "source", word_count(F.col(text)).alias("size"), tie.alias("tie")), "sizes")


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot (the schedule's slot in which the mix comes to the document first, null if never): a row for each row of docs."""
    m = mix(sized(docs))
    sums = m.takes.groupBy("_source", "_start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    some, none = m.placed.where("size > 0"), m.placed.where("size = 0")
    rows = some.join(sums, ["_source", "_start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).unionByName(none.withColumn("taken", F.lit(0).cast("long")).withColumn("first_slot", F.lit(None).cast("long")))
    return rows.join(F.broadcast(m.sources.select("_source", "source_size", "target")), "_source").select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")


def mixed(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them, in the order of the schedule: a row for each run through a document, whole, or its first words where the source's target ends inside it; n_chars, if there, follows.

    Rows are dealt by ranges of their first slot and sorted inside each, so the files of a written mix hold the sources interleaved.
    """
    names = docs.columns
    # Columns get names of our own on the way, for docs may hold any.
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = {c: f"c{names.index(c)}" for c in ("doc_id", "text", "source")}
    sizes = sized(rows.select(*(F.col(c).alias(n) for n, c in at.items())))
    m = mix(sizes)
    takes = written(m.takes.select("doc_id", "size", "tie", "epoch", "words", "slot"), "takes")
    tied = rows.withColumn("own_tie", F.crc32(F.coalesce(F.col(at["text"]), F.lit("")).cast("binary")))
    if not sizes.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():  # the takes of all copies of a row hang on one of them
        tied = tied.dropDuplicates([at["doc_id"], "own_tie"])
    met = tied.join(takes, F.col(at["doc_id"]).eqNullSafe(F.col("doc_id")) & (F.col("own_tie") == F.col("tie"))).select(*rows.columns, "size", "words", "slot", "epoch")
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, n in zip(b.column(text).to_pylist(), b.column("words").to_pylist(), strict=True):
                for k, found in enumerate(WORD.finditer(t), 1):
                    if k == n:
                        t = t[: found.end()]
                        break
                texts.append(t)
            columns = list(b.columns)
            columns[text] = pa.array(texts, b.schema.field(text).type)
            if chars is not None:
                columns[chars] = pa.array([len(t) for t in texts], b.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    both = met.where("words = size").unionByName(met.where("words < size").mapInArrow(cut, met.schema))
    ordered = both.repartitionByRange("slot", at["doc_id"], "epoch").sortWithinPartitions("slot", at["doc_id"], "epoch")
    return ordered.select(*rows.columns).toDF(*names)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return taken(docs).select("doc_id", "size", "source_size", "target", "taken", "first_slot")
