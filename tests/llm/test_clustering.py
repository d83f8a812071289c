import hashlib
import math

import duckdb
import numpy as np
import pytest

from attestor.llm import clustering
from attestor.llm.clustering import LENGTH, MOST, ORACLE, clustered, nearest, op12_centroids

SF = "/root/testdata/sf0.01"
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows, clusters=40, rounds=5):
    """Lloyd's rounds row by row in whole numbers of Python."""
    kept = [(i, [max(-MOST, min(MOST, math.floor(256.0 * x))) for x in v]) for i, v in rows if v is not None and len(v) == LENGTH and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        got = assign()
        for k in range(len(centroids)):
            own = [v for (_, v), (c, _) in zip(kept, got) if c == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    got = assign()
    total = sum(d for _, d in got)
    out = []
    for (i, _), (c, d) in zip(kept, got):
        out.append((i, c, d, sum(y for x, y in got if x == c), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("high", [3, 2**20, 2**23])
def test_nearest_is_exact(high):
    rng = np.random.default_rng(high)
    x, c = rng.integers(-high, high, (500, 8)), rng.integers(-high, high, (30, 8))
    c[7] = c[3]
    cluster, distance = nearest(x, c)
    for v, k, d in zip(x.tolist(), cluster.tolist(), distance.tolist()):
        all_of = [sum((a - b) ** 2 for a, b in zip(v, w)) for w in c.tolist()]
        assert (k, d) == (all_of.index(min(all_of)), min(all_of))


def test_equals_plain_code_with_hot_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    near = [[float(round(x, 2)) for x in rng.normal(size=LENGTH)] for _ in range(60)]
    rows = [(i, near[int(rng.integers(60))]) for i in range(150)] + [(1000 + i, near[0]) for i in range(100)]
    rows += [(2000, None), (2001, []), (2002, near[1][:-1]), (2003, [*near[1][:-1], None]), (2004, [*near[1][:-1], math.inf]), (2005, [*near[1][:-1], math.nan]), (5, near[2]), (5, near[2]), (None, near[3]), (2006, [1e30, -1e30] * 32)]
    df = spark.createDataFrame([(i, v, -1) for i, v in rows], "vec_id long, embedding array<double>, Cluster int")
    assert rows_of(clustered(df)) == plain(rows)
    assert rows_of(clustered(df, clusters=3, rounds=2)) == plain(rows, 3, 2)


def test_all_light_and_all_heavy(spark, monkeypatch):
    """The broadcast of heavy keys and the shuffle of the others give the same rows."""
    rows = [(i, [float(i % 17)] * LENGTH) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for heavy in (0, 5, 1000):
        monkeypatch.setattr(clustering, "HEAVY", heavy)
        assert rows_of(clustered(df)) == plain(rows)


def test_few_and_none(spark):
    rows = [(1, [0.5] * LENGTH), (2, [0.5] * LENGTH), (3, [-0.5] * LENGTH)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = clustered(df)
    assert rows_of(got) == plain(rows) and {r.cluster for r in got.collect()} <= {0, 1, 2}
    empty = clustered(df.limit(0))
    assert empty.columns == COLUMNS and empty.count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM read_parquet('{SF}/embeddings.parquet')")
    theirs = con.sql(ORACLE)
    assert rows_of(op12_centroids(spark, SF)) == sorted((tuple(r[theirs.columns.index(c)] for c in COLUMNS) for r in theirs.fetchall()), key=str)
