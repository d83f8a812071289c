import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import topk
from attestor.llm.topk import LEVELS, ORACLE, Chunk, op4_top_k, slack, statistics, top_k


def brute(rows, k, every):
    good = [(i, [int(np.floor(256.0 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q and len(a) == len(b))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("d", [1, 3, 64])
def test_bounds_hold_and_results_are_exact(d):
    rng = np.random.default_rng(d)
    x = rng.integers(-200, 200, (300, d))
    x[50:150] = x[50]
    ids = np.arange(300)
    for parts in LEVELS:
        s = statistics(x.astype(float), parts)
        assert (s @ s.T - x @ x.T > -1e-6).all()
    floor = np.full(6, -np.inf)
    r, c, score = Chunk(ids, x).best(ids[::50], x[::50], 5, floor)
    assert not np.isneginf(floor).any()
    rows = [(int(i), [v / 256 for v in x[i]]) for i in ids]
    assert sorted(zip(ids[::50][r].tolist(), c.tolist(), score.tolist())) == sorted((q, i, s) for q, _, i, s in brute(rows, 5, 50))


@pytest.mark.parametrize("offset", [0, 2**20, 2**26, 2**40])
def test_large_offsets(offset):
    """Vectors of a large common offset beside spread ones: a bound may not fall under the true product by more than the proven slack, and the best five are exact."""
    rng = np.random.default_rng(offset % 1000)
    for _ in range(10):
        x = np.vstack([offset + rng.integers(-9, 9, (150, 64)), rng.integers(-(offset + 2), offset + 2, (150, 64))])
        true = x.astype(object) @ x.astype(object).T
        norms = np.linalg.norm(x.astype(float), axis=1)
        for parts in LEVELS:
            s = statistics(x.astype(float), parts)
            assert ((s @ s.T + slack(64) * norms[:, None] * norms[None, :]) >= true.astype(float)).all()
        ids, q = np.arange(300), np.arange(0, 300, 10)
        r, c, score = Chunk(ids, x).best(q, x[q], 5, np.full(len(q), -np.inf))
        got = {}
        for a, b, n in zip(r, c, score):
            got.setdefault(int(q[a]), []).append((-int(n), int(b)))
        for i in q:
            assert got[int(i)] == sorted((-min(max(int(true[i, j]), -(2**63)), 2**63 - 1), j) for j in range(300) if j != i)[:5]


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    rows += [(200, None), (250, []), (300, [1.0, float("nan"), 0.0, 0.0]), (301, [1.0, None, 2.0, 3.0]), (302, [float("inf")] * 4), (350, [1.0, 2.0]), (351, [1e13, -1e13]), (360, [1.0, 3.0]), (401, [-2.0, 5e13]), (None, [1.0] * 4)]
    rows += [(500 + i, [2.0, 2.0, 2.0, 2.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1))
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, 5).collect())
    assert got == brute(rows, 5, 50)
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_many_files_and_chunks(spark, monkeypatch):
    """The same result with files of a few queries, chunks of a few candidates and floors that are mostly forgotten."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4 if i % 3 else 2)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for name, value in (("FILE_ROWS", 7), ("CHUNK", 50), ("BLOCK", 3), ("FLOORS", 10)):
        monkeypatch.setattr(topk, name, value)
    assert sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 5 == 0, 4).collect()) == brute(rows, 4, 5)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in op4_top_k(spark, sf).select("query_id", "rank", "vec_id", "score").collect())
    c = duckdb.connect()
    c.sql(f"create view embeddings as from '{sf}/embeddings.parquet'")
    assert got == sorted(c.sql(ORACLE).fetchall())
