import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from attestor.llm import mixing
from attestor.llm.mixing import mix, mixed, op9_mixing, sized, taken, targets

SF = "/root/testdata/sf0.01"


def test_targets():
    assert targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    got = targets([10, 10, 580], [1, 2, 3])
    assert got == [30, 30, 540] and sum(got) == 600
    assert targets([0, 5], [1, 2]) == [0, 5] and targets([0, 0], [1, 2]) == [0, 0] and targets([], []) == []


def test_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op9_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or "")) and 0 <= r.taken <= 3 * r["size"]
        by[docs[r.doc_id].source].append(r)
    names = sorted(by)
    goal = targets([sum(r["size"] for r in by[n]) for n in names], [1 + i % 3 for i in range(len(names))])
    for n, t in zip(names, goal):
        assert {r.source_size for r in by[n]} == {sum(r["size"] for r in by[n])}
        assert all(abs(r.target - t) < 1e-6 for r in by[n])
        assert abs(sum(r.taken for r in by[n]) - t) <= 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op9_mixing(spark, SF).collect()))


ROWS = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "w " * 30_000, "y"), (5, "one", None), (None, "p q", "z"), (6, "d e\tf\ng", "\U0001f600"), (7, "h i", "�")]


def test_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("size", F.lit(7)).withColumn("block", F.lit(1))
    rows = taken(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r.taken <= 3 * r["size"] for r in rows) and {r.target for r in rows if r.source == "�"} == {6.0}
    out = mixed(docs).collect()
    assert sum(len((r.text or "").split()) for r in out) == sum(r.taken for r in rows)
    assert taken(docs.limit(0)).count() == 0 and mixed(docs.limit(0)).count() == 0
    nothing = taken(docs.withColumn("text", F.lit(None).cast("string"))).collect()
    assert len(nothing) == len(ROWS) and not any(r.taken or r.target for r in nothing)


def test_names_too_long_for_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    want = sorted(map(str, taken(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(map(str, taken(docs).collect())) == want


def test_schedule_is_even_and_whole(spark):
    docs = spark.createDataFrame([(i, "w " * 64, "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    m = mix(sized(docs), block=16)
    rows = sorted(m.schedule.collect(), key=lambda r: (r.slot, r["_source"], r.block))
    assert {s: sorted(r.block for r in rows if r["_source"] == s) for s in range(3)} == {s: list(range(400 * (s + 1))) for s in range(3)}
    for n in (60, 600, 2000):
        for s in range(3):
            assert sum(r["_source"] == s for r in rows[:n]) == pytest.approx(n * (s + 1) / 6, abs=4)


def plain_mix(rows, block):
    """taken and first slot of each row, (doc_id, source, words, order key): the schedule slot by slot, and every word of a source's stream by its place."""
    names = sorted({s for _, s, _, _ in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for _, t, n, _ in rows if t == s) for s in names}
    goal = targets([own[s] for s in names], [1 + i % 3 for i in range(len(names))])
    words = [min(round(t), 3 * own[s]) for t, s in zip(goal, names)]
    quota = [-(-w // block) for w in words]
    total, bounds = sum(quota), [sum(quota[: i + 1]) for i in range(len(quota))]
    slots = [[] for _ in names]
    for slot in range(total):
        u = (((slot + 1) * 0x9E3779B97F4A7C15) % 2**64 >> 11) / 2.0**53 * bounds[-1]
        slots[next((i for i, b in enumerate(bounds) if u < b), len(bounds) - 1)].append(slot)
    out = {}
    for i, s in enumerate(names):
        stream = [d for d, t, n, _ in sorted((r for r in rows if r[1] == s), key=lambda r: (r[3], r[0])) for _ in range(n)]
        for w in range(words[i]):
            d, b = stream[w % len(stream)], w // block
            slot = slots[i][b] if b < len(slots[i]) else total
            taken_words, first = out.get(d, (0, total))
            out[d] = taken_words + 1, min(first, slot)
    return {d: out.get(d, (0, None)) for d, _, _, _ in rows}


@pytest.mark.parametrize("block", [1, 7, 256])
def test_blocks_and_pieces_equal_a_plain_mix(spark, block, monkeypatch):
    """Which words of which documents the mix takes, and in which slot a document comes first, word by word."""
    rng = random.Random(block)
    docs = spark.createDataFrame([(i, "w " * rng.choice([0, 1, 3, 40, 300, 700]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(90)], "doc_id long, text string, source string")
    keys = {r.doc_id: r.k for r in docs.select("doc_id", F.xxhash64(F.lit(9), "doc_id", F.crc32(F.col("text").cast("binary"))).alias("k")).collect()}
    rows = [(r.doc_id, r.source, len(r.text.split()), keys[r.doc_id]) for r in docs.collect()]
    m = mix(sized(docs), block=block)
    sums = {r.doc_id: (r.words, r.slot) for r in m.takes.groupBy("doc_id").agg(F.sum("words").alias("words"), F.min("slot").alias("slot")).collect()}
    assert {d: sums.get(d, (0, None)) for d in keys} == plain_mix(rows, block)
    if block == 256:
        assert {r.doc_id: (r.taken, r.first_slot) for r in taken(docs).collect()} == plain_mix(rows, block)


def test_mix_is_interleaved(spark, tmp_path):
    """Files of the written mix hold the sources in their shares, whatever order documents came in."""
    docs = spark.createDataFrame([(i, f"w{i} " * 64, "abc"[i // 200]) for i in range(600)], "doc_id long, text string, source string").withColumn("_tie", F.lit("x")).withColumn("words", F.lit(0)).withColumn("slot", F.lit("y"))
    out = mixed(docs)
    assert out.columns == docs.columns
    out.write.parquet(str(tmp_path / "mix"))
    for part in sorted((tmp_path / "mix").glob("part-*")):
        rows = spark.read.parquet(str(part)).collect()
        assert all(r["_tie"] == "x" and r.words == 0 and r.slot == "y" for r in rows)
        if len(rows) > 60:
            n = sum(len(r.text.split()) for r in rows)
            for s in range(3):
                assert abs(sum(len(r.text.split()) for r in rows if r.source == "abc"[s]) / n - (s + 1) / 6) < 0.08
    first = {r.doc_id: r for r in taken(docs).collect()}
    assert all((r.first_slot is None) == (r.taken == 0) for r in first.values())
