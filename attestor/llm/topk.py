"""Operator 4: exact top-k by integer inner product, with segment statistics from coarse to fine.

A vector is cut into 1, 4, 16 and 32 segments. With a segment's mean m and deviation s over L components, the inner product of two vectors is at most
the sum over segments of L (m m' + s s'), by Cauchy-Schwarz on the parts around the means; that is, twice the inner product plus the lower bound of the squared
distance is at most the sum of the squared norms. Bounds are taken level by level for the pairs that the level before has left; the exact integer
products of the survivors decide. A pair is dropped only if its bound, with the proven rounding error added, is under the k-th best score found so far for its query, so results are exact. On vectors without structure the
bounds drop little, and nearly all pairs are multiplied.

Queries lie in the shared folder in files of bounded size, which tasks read; the driver sees none. Each task holds one bounded chunk of candidates and goes through the files block by block; a chunk and a
block give k rows for each query at most, and the last ranking sees only those.

Cases: vectors that are null, empty or hold null or non-finite components take no part; vectors of different lengths are never compared; components whose
rounded form is beyond 2**62 are held there; scores are held within 64 bits; a query with fewer than k candidates
has fewer rows; columns besides the id and the vector are not read, whatever their names; repeated ids are rows of their own, except that a query meets no row of its own id; ties go to the smaller id; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm.common import fresh_path

LEVELS = (1, 4, 16, 32)
CHUNK = 16_384  # candidates at once, at most twice as many
BLOCK = 128  # queries at once
FILE_ROWS = 32_768  # queries in a file
FLOORS = 4_000_000  # queries whose best score so far a task remembers from chunk to chunk; for others it begins anew


def usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def scaled(vector: Column, factor: float) -> Column:
    """floor(factor * x) of each component, x as double."""
    most = float(2**62)
    return F.transform(vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * F.lit(factor)).cast("double"), F.lit(-most)), F.lit(most)).cast("long"))


def statistics(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows of sqrt(L) * (means, deviations) of x (float64) in `parts` segments: the product of two such rows bounds the inner product, but for rounding (`slack`). Deviations are those of centred components, so that a large common offset cancels nothing."""
    edges = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    sizes = np.diff(edges)
    sums = np.add.reduceat(x, edges[:-1], axis=1)
    centred = x - np.repeat(sums / sizes, sizes, axis=1)
    return np.hstack([sums / np.sqrt(sizes), np.sqrt(np.add.reduceat(centred * centred, edges[:-1], axis=1))])


def slack(d: int) -> float:
    """What rounding can take from a bound, over the product of the two norms. With d components of unit roundoff u = 2**-53, a segment's scaled mean and deviation are each off by at most (d + 3) u times the
    segment's norm (d additions, the centring, the conversion of whole numbers beyond 2**53), their products by twice that, and the dot product of the statistics and the score by (d + 2) u each: under 8 (d + 3) u."""
    return 8 * (d + 3) * 2.0**-53


def in_53_bits(q: np.ndarray, c: np.ndarray) -> bool:
    return float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2**53


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All inner products, exact: in floating point where every partial sum is below 2**53, else in whole numbers of any size, held within 64 bits at the end."""
    if in_53_bits(q, c):
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ c.astype(object).T
    return np.vectorize(lambda x: max(-(2**63), min(2**63 - 1, x)), otypes=[np.int64])(exact)


class Chunk:
    """Candidates of one length in the order of their ids, with their statistics at every level."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        floats = self.vectors.astype(np.float64)
        self.levels = [statistics(floats, parts) for parts in LEVELS]
        self.norms = np.linalg.norm(floats, axis=1)

    def best(self, q_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, row here, score) of each query's k best candidates of other ids, ties to the smaller id, as far as they reach `floor`: the query's k-th best score so far, which is raised."""
        own = list(zip(np.searchsorted(self.ids, q_ids), np.searchsorted(self.ids, q_ids, side="right"), strict=True))

        def without_own(grid: np.ndarray, worst: float) -> None:
            for row, (low, high) in enumerate(own):
                grid[row, low:high] = worst

        if np.isneginf(floor).any() and len(self.ids) > k:
            seeds = products(q, self.vectors[: min(1024, len(self.ids))]).astype(np.float64)
            without_own(seeds, -np.inf)
            if seeds.shape[1] >= k:
                np.maximum(floor, np.partition(seeds, -k, axis=1)[:, -k], out=floor)
        floats = q.astype(np.float64)
        least, own_slack = floor[:, None], slack(q.shape[1]) * np.linalg.norm(floats, axis=1)[:, None]
        alive = np.ones((len(q), len(self.ids)), bool)
        without_own(alive, False)
        for parts, own_stats in zip(LEVELS, self.levels, strict=True):
            columns = np.flatnonzero(alive.any(axis=0))
            if not len(columns):
                break
            asked = np.hstack([statistics(floats, parts), own_slack])
            if len(columns) == len(self.ids):
                alive &= asked @ np.hstack([own_stats, self.norms[:, None]]).T >= least
            else:
                alive[:, columns] &= asked @ np.hstack([own_stats[columns], self.norms[columns, None]]).T >= least
        columns = np.flatnonzero(alive.any(axis=0))  # survivors of any query of the block
        scores = products(q, self.vectors[columns])
        r, x = np.nonzero(alive[:, columns] & (scores >= floor[:, None]))
        col, scores = columns[x], scores[r, x]
        order = np.lexsort((self.ids[col], ~scores, r))  # ~ turns the order without overflow
        r, col, scores = r[order], col[order], scores[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        last = rank == k - 1
        floor[r[last]] = np.maximum(floor[r[last]], scores[last])
        return r[rank < k], col[rank < k], scores[rank < k]


class QueryBlocks:
    """Queries in files of a shared folder, read block by block: (file, block, ids, vectors) of one length each. The last file stays in memory, so a single one is read once."""

    def __init__(self, folder: str, size: int) -> None:
        self.size = size
        self.files, root = fs.FileSystem.from_uri(folder)
        found = self.files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        self.paths = sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet"))
        self.held: tuple[int, list[tuple[np.ndarray, np.ndarray]]] = (-1, [])

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for i in range(len(self.paths)):
            if self.held[0] != i:
                self.held = (i, list(self.blocks_of(self.paths[i])))
            for j, (ids, x) in enumerate(self.held[1]):
                yield i, j, ids, x

    def blocks_of(self, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        with self.files.open_input_file(path) as f:
            rows = pq.read_table(f, columns=["id", "v"]).to_pandas()
        for d, part in rows.groupby(rows["v"].map(len)):
            ids, x = part["id"].to_numpy(np.int64), np.stack(part["v"].to_numpy()).astype(np.int64).reshape(-1, d)
            for s in range(0, len(ids), self.size):
                yield ids[s : s + self.size], x[s : s + self.size]


def top_k(vectors: DataFrame, queries: Column, k: int, id_column: str = "vec_id", vector: str = "embedding", factor: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: for every row where `queries` holds, against all rows. One pass over the candidates; queries never reach the driver."""
    spark = vectors.sparkSession
    good = vectors.where(F.col(id_column).isNotNull() & usable(F.col(vector))).select(F.col(id_column).cast("long").alias("id"), scaled(F.col(vector), factor).alias("v"), queries.alias("is_query"))
    folder = fresh_path(spark, "queries")
    block, chunk_rows, remembered = BLOCK, CHUNK, FLOORS
    good.where("is_query").select("id", "v").write.option("maxRecordsPerFile", FILE_ROWS).parquet(folder)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = QueryBlocks(folder, block)
        floors: dict[tuple[int, int], np.ndarray] = {}
        kept = 0

        def chunk_best(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal kept
            chunks = {d: Chunk(part["id"].to_numpy(np.int64), np.array(part["v"].tolist(), np.int64).reshape(-1, d)) for d, part in rows.groupby(rows["v"].map(len))}
            for i, j, q_ids, q in asked:
                if (chunk := chunks.get(q.shape[1])) is None:
                    continue
                floor = floors.get((i, j))
                if floor is None:
                    floor = np.full(len(q_ids), -np.inf)
                    if kept < remembered:
                        floors[i, j], kept = floor, kept + len(floor)
                r, col, score = chunk.best(q_ids, q, k, floor)
                yield pd.DataFrame({"query_id": q_ids[r], "vec_id": chunk.ids[col], "score": score})

        held, n = [], 0
        for batch in batches:
            for s in range(0, len(batch), chunk_rows):
                held.append(batch.iloc[s : s + chunk_rows])
                n += len(held[-1])
                if n >= chunk_rows:
                    yield from chunk_best(pd.concat(held))
                    held, n = [], 0
        if n:
            yield from chunk_best(pd.concat(held))

    found = good.select("id", "v").mapInPandas(work, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0, 5)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
