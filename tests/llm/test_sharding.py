import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestor.llm.sharding import op8_sharding, rendezvous, shard

SF = "/root/testdata/sf0.01"


def test_weights_and_growth(spark):
    n = 40_000
    rows = spark.range(n).select(rendezvous([F.col("id")], [1.0, 2.0, 0.0, 1.0]).alias("a"), rendezvous([F.col("id")], [1.0, 2.0, 0.0, 1.0, 1.0]).alias("b")).collect()
    counts = Counter(r.a for r in rows)
    assert set(counts) == {0, 1, 3} and all(abs(counts[s] - n * w / 4) < n * 0.01 for s, w in ((0, 1), (1, 2), (3, 1)))
    assert all(r.a == r.b or r.b == 4 for r in rows) and abs(sum(r.b == 4 for r in rows) - n / 5) < n * 0.01
    with pytest.raises(ValueError):
        rendezvous([F.col("id")], [])
    assert {r[0] for r in spark.range(5).select(rendezvous([F.col("id")], [1.0])).collect()} == {0}


def test_query(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = {}
    for r in rows:
        assert (r["size"], r.text_crc32, r.law) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "key")
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 16


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a"), (1, None), (1, None), (1, "x"), (2, "y" * 100_000)], "doc_id long, text string").withColumn("shard", F.lit("old"))
    rows = shard(df, "doc_id", [1.0] * 4).collect()
    assert len(rows) == 5 and len({r.shard for r in rows if r.doc_id == 1}) == 1
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert shard(df.limit(0), "doc_id", [1.0] * 4).count() == 0


def test_winner_against_plain_code(spark):
    """The shard with the largest -w / ln(u), from the hash of every (key, shard) pair."""
    weights, seed = [1.0, 2.5, 0.0, 0.5], 7
    hashes = [F.xxhash64(F.col("id"), F.lit(seed), F.lit(i)).alias(f"h{i}") for i in range(len(weights))]
    for r in spark.range(500).select("id", rendezvous([F.col("id")], weights, seed).alias("shard"), *hashes).collect():
        draws = [(((r[f"h{i}"] % 2**64) >> 11) + 0.5) / 2**53 for i in range(len(weights))]
        assert r.shard == max(range(len(weights)), key=lambda i: -weights[i] / math.log(draws[i]))


def test_clashing_names_and_ties(spark):
    rows = [(1, f"text {i}") for i in range(40)] + [(2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("_range", "_weight", "_range_start", "_order", "_sum", "slot"):
        df = df.withColumn(name, F.lit(name))
    first = shard(df.repartition(7), "doc_id", [1.0] * 3, ties=("text",)).collect()
    assert all(r[n] == n for r in first for n in ("_range", "_weight", "_range_start", "_order", "_sum"))
    again = shard(df.repartition(3), "doc_id", [1.0] * 3, ties=("text",)).collect()
    assert {(r.text, r.shard, r.slot) for r in first} == {(r.text, r.shard, r.slot) for r in again} and len(first) == 41
