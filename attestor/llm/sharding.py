"""Operator 8: rendezvous hashing of stable record keys over weighted shards, with DataFrame functions only.

Every (key, shard) pair has a uniform draw u from a 64-bit hash; the record goes to the shard with the largest -weight / ln(u). A shard that is
added takes records only into itself, and one that is removed gives up only its own.

Cases: a null key is a key of its own; repeated rows get the same shard and different slots; null text counts as no bytes; an empty table gives an
empty result; columns named like the new ones (shard, grown_shard, slot) are replaced, all others stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import free_name, prefix_sums


def rendezvous(keys: Sequence[Column], weights: Sequence[float], seed: int = 7) -> Column:
    """The shard (int) among range(len(weights)) that wins the keys; a shard of weight 0 never wins unless all are 0."""
    if not weights or min(weights) < 0:
        raise ValueError("weights: one number of 0 or more for each shard")

    def bid(shard: int, weight: float) -> Column:
        draw = (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed), F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(2**53))
        return F.struct((F.lit(float(-weight)) / F.log(draw)).alias("bid"), F.lit(-shard).alias("shard"))

    bids = [bid(i, w) for i, w in enumerate(weights)]
    return -(F.greatest(*bids) if len(bids) > 1 else bids[0])["shard"]


def shard(docs: DataFrame, key: str, weights: Sequence[float], new_weight: float = 1.0, seed: int = 7, ties: Sequence[str] = ()) -> DataFrame:
    """docs with shard, grown_shard (after one more shard of new_weight) and slot: gapless from 0 inside a shard, in the order of a hash of the key, then the key, then the columns `ties`, which tell rows of one key apart so that reruns give them the same slots."""
    order = free_name(docs, "order")
    rows = (
        docs.withColumn("shard", rendezvous([F.col(key)], weights, seed))
        .withColumn("grown_shard", rendezvous([F.col(key)], [*weights, new_weight], seed))
        .withColumn(order, F.xxhash64(F.col(key), F.lit(seed + 1)))
    )
    last = [F.col(c).asc_nulls_first() for c in (key, *ties)]
    return prefix_sums(rows, ["shard"], order, last, F.lit(1), "slot").withColumn("slot", F.col("slot").cast("long")).drop(order)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard(sized, "doc_id", [1.0] * 16, ties=("text_crc32", "size")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
