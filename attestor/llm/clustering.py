"""Operator 12: centroid clustering (Lloyd's rounds) on distinct quantised vectors with multiplicities.

Equal vectors are grouped first, with how often they stand, so a vector that a third of all rows share is multiplied once a round. Each task assigns its distinct vectors
to the nearest centroid and adds them up, each times its multiplicity, in whole numbers; the sums of a centroid are added over the tasks. Centroids, of a number and
a length that are parameters, are all that the driver sees. In the end the assignment of a distinct vector is joined back to the rows that hold it: those of the few vectors that more than
one in `HEAVY` rows hold through a broadcast of HEAVY keys at most, the others by a shuffle.

Cases: vectors that are null, of another length or with null or non-finite components take no part; components whose quantised form is beyond 2**24 are held there, so that every distance
is a whole number of 64 bits; sums of distances beyond 64 bits are held there; with fewer rows than centroids there are as many centroids as rows; a centroid without vectors stays as it is; a row of null
id takes part, after all others in the order of the seeds; repeated rows are rows of their own; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import written

CLUSTERS = 40
ROUNDS = 5
LENGTH = 64
HEAVY = 1000
MOST = 2**24
BLOCK = 4096  # vectors multiplied at once
ADDED = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}


def quantised(vector: Column, factor: float) -> Column:
    """floor(factor * x) of each component, x as double, within MOST."""
    return F.transform(vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * F.lit(factor)).cast("double"), F.lit(-float(MOST))), F.lit(float(MOST))).cast("int"))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid, exact; ties to the smaller number. In floating point where all sums stay below 2**53, else in whole numbers of 64 bits."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 2**53 else np.int64
    a, c = x.astype(kind), centroids.astype(kind)
    distance = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(x)), best].astype(np.int64)


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for batch in batches:
        for s in range(0, len(batch), BLOCK):
            part = batch.iloc[s : s + BLOCK]
            yield part, np.stack(part["v"].to_numpy()).astype(np.int64)


def seeds(rows: DataFrame, clusters: int) -> np.ndarray:
    """The vectors of the rows with the smallest hashes, in their order; a limit that is a parameter, kept task by task."""
    first = rows.withColumn("hash", F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256)).orderBy(F.col("hash").asc_nulls_last(), "v").limit(clusters)
    return np.array([r.v for r in first.select("v").collect()], np.int64).reshape(-1, LENGTH)


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the centroids after every distinct vector went to its nearest one."""
    k, d = centroids.shape

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for part, x in blocks(batches):
            cluster, _ = nearest(x, centroids)
            order = np.argsort(cluster, kind="stable")
            times = part["times"].to_numpy(np.int64)[order]
            found, first = np.unique(cluster[order], return_index=True)
            sums[found] += np.add.reduceat(x[order] * times[:, None], first, axis=0)
            counts[found] += np.add.reduceat(times, first)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"cluster": at, "n": counts[at], "sums": list(sums[at])})

    total = distinct.mapInPandas(work, "cluster int, n long, sums array<long>").groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(d))).alias("sums"))
    out = centroids.copy()
    for r in total.collect():
        out[r.cluster] = np.array(r.sums, np.int64) // r.n  # rounds down, for negative sums too
    return out


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The key and times of each distinct vector with cluster and distance."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in blocks(batches):
            cluster, distance = nearest(x, centroids)
            yield pd.DataFrame({"key": part["key"], "times": part["times"], "cluster": cluster, "distance": distance})

    return distinct.mapInPandas(work, "key binary, times long, cluster int, distance long")


def clustered(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, factor: float = 256.0) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every row whose vector has LENGTH finite components."""
    spark = vectors.sparkSession
    v = F.col(vector)
    good = v.isNotNull() & (F.size(v) == LENGTH) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(good).select(F.col(id_column).alias("id"), quantised(v, factor).alias("v"))
    centroids = seeds(rows, clusters)
    if not len(centroids):
        return rows.select(F.col("id").alias(id_column), *(F.lit(None).cast(t).alias(c) for c, t in ADDED.items())).where("false")
    key = F.unhex(F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256))
    distinct = written(rows.groupBy("v").agg(F.count(F.lit(1)).alias("times")).withColumn("key", key), "distinct_vectors")
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    found = written(assigned(distinct, centroids), "assigned")

    product = F.col("times").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")
    sums = {r.cluster: (int(r.inertia), r.n) for r in found.groupBy("cluster").agg(F.sum(product).alias("inertia"), F.sum("times").alias("n")).collect()}
    whole, n = min(2**63 - 1, sum(x for x, _ in sums.values())), sum(x for _, x in sums.values())
    table = [(c, min(2**63 - 1, inertia), whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, (inertia, _) in sums.items()]
    of_cluster = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")

    heavy = found.where(F.col("times") * HEAVY > n).select("key", F.col("cluster").alias("c"), F.col("distance").alias("d"))  # fewer than HEAVY
    of_rows = written(rows.select("id", key.alias("key")), "keys_of_rows").join(F.broadcast(heavy), "key", "left")
    common = of_rows.where("c is not null").select("id", F.col("c").alias("cluster"), F.col("d").alias("distance"))
    other = of_rows.where("c is null").select("id", "key").join(found.select("key", "cluster", "distance"), "key").select("id", "cluster", "distance")
    return common.unionByName(other).join(F.broadcast(of_cluster), "cluster").select(F.col("id").alias(id_column), *ADDED)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _oracle() -> str:
    def assignment(centroids: str, out: str) -> str:
        return f"""{out} AS (SELECT vec_id, v, rn, min(number) AS cluster, d AS distance FROM (
  SELECT p.*, min(d) OVER (PARTITION BY rn) AS least FROM (
    SELECT e.vec_id, e.v, e.rn, c.number, CAST(list_sum(list_transform(list_zip(e.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM e CROSS JOIN {centroids} c) p
  ) WHERE d = least GROUP BY vec_id, v, rn, d)"""

    parts = [
        f"""e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS rn FROM embeddings
  WHERE len(embedding) = {LENGTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), v) - 1 AS number, v AS c FROM e QUALIFY number < {CLUSTERS})",
    ]
    for r in range(ROUNDS):
        parts += [
            assignment(f"c{r}", f"a{r}"),
            f"""m{r} AS (SELECT cluster, i, (s - ((s % n) + n) % n) // n AS x FROM (SELECT cluster, i, sum(CAST(x AS HUGEINT)) AS s, count(*) AS n FROM (
  SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i))""",
            f"c{r + 1} AS MATERIALIZED (SELECT number, coalesce(l, c) AS c FROM c{r} LEFT JOIN (SELECT cluster, list(CAST(x AS BIGINT) ORDER BY i) AS l FROM m{r} GROUP BY cluster) ON cluster = number)",
        ]
    parts.append(assignment(f"c{ROUNDS}", "final"))
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM final JOIN c{ROUNDS} ON number = cluster"""


ORACLE = _oracle()
