"""Operator 10: MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts makes each document's set of distinct word shingles (64-bit hashes), a key of the set, a signature of HASHES min-hashes of 16 bits and the
   hashes of BANDS bands of min-hashes. Documents with one key have one set and form a class; its smallest doc_id stands for it.
2. Hub rounds. In every bucket of a band the smallest class is the hub. Each class is first a candidate with the hub that it shares most buckets with, one pair a class; then
   with the hubs of those of its buckets that are still in another component: no more pairs than bucket entries, whatever a bucket holds.
3. Candidates are verified: batches of the two signatures are compared one after another; after n hashes with m equal, the posterior of the similarity
   under a uniform prior is Beta(m + 1, n - m + 1), and a pair is dropped when the chance that it reaches the threshold is below MISS. Survivors
   are confirmed on their full shingle sets: a hub's set travels once for every FAN of its partners, and each partner's once.
4. Confirmed links are closed to components by alternating star contraction, on tables.
5. The last round takes the buckets that still hold more than one component. All pairs of classes of different components are compared by signature, in the task that has
   the bucket, and only the classes with a survivor go on. These come together again with their sets; surviving pairs are confirmed in the task, likeliest components first
   joined in a local union-find, and only links that join something are written: fewer than there are classes, never pairs. A pair is confirmed in the first band
   that it shares. Buckets beyond BLOCK entries or SHINGLES of their sets are cut into blocks that meet two by two. So no pair that shares a bucket is left out.

The rows of a band follow from the threshold (band_rows), so that a pair at it shares no bucket with probability under LOST, bands taken as independent draws: 7 rows at 0.85 (1.5e-5), 6 at 0.80 (7.7e-5).

Cases: null text and text without words has an empty set, links with nothing and is kept; fewer words than a shingle are one shingle; texts are read whole; of repeated doc_ids
each row is classed by its own text, and rows of one id are linked; a null doc_id is dropped from grouping and kept as a component of its own; an empty table gives
an empty result; columns of docs other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import scratch, small_batches, written

WORDS = 5
HASHES = 128
BANDS = 48
BATCH = 16
MISS = 1e-6
#: Chance that a pair at the threshold shares no bucket.
LOST = 1e-4
#: Entries of a bucket, and shingles of its sets, that one block holds.
BLOCK = 4096
SHINGLES = 2_000_000
#: Partners that a hub's set is sent to at once.
FAN = 512
#: Ids that are broadcast at most, of 8 bytes each; beyond, a shuffled join.
BROADCAST_IDS = 1_000_000

_random = np.random.default_rng(20_240_601)
MULTIPLIERS = _random.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _random.integers(0, 2**63, HASHES, dtype=np.uint64)
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes. Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered."""

    def __init__(self, kept: int = 200_000) -> None:
        self.kept, self.known = kept, {}

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint64)
        words = text.encode("utf-8").lower().split()
        known = self.known
        if len(known) > self.kept:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        x = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(x):
            return x
        n = min(WORDS, len(x))
        h = np.full(len(x) - n + 1, n, np.uint64)
        for j in range(n):
            h = mixed(h + x[j : len(x) - n + 1 + j] * _POWERS[j])
        return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima (uint64), in bounded steps."""
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(shingles), 4096):
        part = shingles[s : s + 4096]
        for k in range(0, HASHES, 16):
            best[k : k + 16] = np.minimum(best[k : k + 16], (part[None, :] * MULTIPLIERS[k : k + 16, None] + OFFSETS[k : k + 16, None]).min(axis=1))
    return best


def posterior_at_least(threshold: float, m: int, n: int) -> float:
    """P(similarity >= threshold) under Beta(m + 1, n - m + 1): that of at most m successes among n + 1 draws at the threshold."""
    return sum(math.comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(n, fewest equal hashes with which a pair goes on) after each batch."""
    return [(n, next(m for m in range(n + 1) if posterior_at_least(threshold, m, n) >= miss)) for n in range(BATCH, HASHES + 1, BATCH)]


def matches(a: np.ndarray, b: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Equal hashes of each pair of rows of a and b (signatures) that goes through all batches, else -1."""
    alive, equal, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in needed:
        equal[alive] += (a[alive, done:n] == b[alive, done:n]).sum(axis=1, dtype=np.int32)
        alive, done = alive[equal[alive] >= least], n
        if not len(alive):
            break
    out = np.full(len(a), -1, np.int32)
    out[alive] = equal[alive]
    return out


def band_rows(threshold: float) -> int:
    """The most rows a band can have so that a pair at the threshold shares none of BANDS bands with a chance under LOST: of m equal hashes among HASHES, a band of r rows is drawn whole with chance C(m, r) / C(HASHES, r)."""

    def lost(r: int) -> float:
        return sum(math.comb(HASHES, m) * threshold**m * (1 - threshold) ** (HASHES - m) * (1 - math.comb(m, r) / math.comb(HASHES, r)) ** BANDS for m in range(HASHES + 1))

    return next((r for r in range(12, 1, -1) if lost(r) <= LOST), 1)


def members_of_bands(rows: int) -> np.ndarray:
    """The hashes of each band: every hash serves in several bands."""
    return np.stack([np.random.default_rng(1000 + b).choice(HASHES, rows, replace=False) for b in range(BANDS)])


def sketched(docs: DataFrame, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key (binary, null for an empty set), sig (binary), bands array<long> of `rows` hashes each."""
    members = members_of_bands(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                batch = whole.slice(s, 512)
                sizes, keys, sigs, bands = [], [], [], []
                for text in batch.column(1):
                    x = shingler.of(text.as_py())
                    sizes.append(len(x))
                    if not len(x):
                        keys.append(None), sigs.append(None), bands.append(None)
                        continue
                    keys.append(xxhash.xxh3_128_digest(x.tobytes()))
                    best = signature(x)
                    sigs.append((mixed(best) >> np.uint64(48)).astype(np.uint16).tobytes())
                    h = np.arange(BANDS, dtype=np.uint64)
                    for j in range(rows):
                        h = mixed(h + best[members[:, j]] * _POWERS[j % 5])
                    bands.append(h.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "sig", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>")


Keep = Callable[[DataFrame, str], DataFrame]


def bounded(small: DataFrame) -> DataFrame:
    """small (a written table of ids and numbers) for a broadcast if it has few rows, else as it is."""
    return F.broadcast(small) if small.count() <= BROADCAST_IDS else small


def bayes_pruned(pairs: DataFrame, classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures let them reach the threshold, with the number of equal hashes."""
    sides = classes.select("rep", "n_shingles", "sig")
    left = sides.toDF("a", "n_a", "sig_a")
    right = sides.toDF("b", "n_b", "sig_b")
    near = (F.col("n_a") >= F.col("n_b") * F.lit(threshold - 1e-9)) & (F.col("n_b") >= F.col("n_a") * F.lit(threshold - 1e-9))
    joined = pairs.join(right, "b").join(left, "a").where(near).select("a", "b", "sig_a", "sig_b")
    needed = least_matches(threshold, miss)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (signatures(batch.column(i)) for i in (2, 3))
                m = matches(a, b, needed)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(m)], names=["a", "b", "m"]).filter(pa.array(m >= 0))

    return joined.mapInArrow(work, "a long, b long, m int").groupBy("a", "b").agg(F.max("m").alias("m"))


def signatures(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def shingle_sets(texts: DataFrame, ids: DataFrame, keep: Keep) -> DataFrame:
    """rep, set (binary, sorted 64-bit hashes) of the texts (rep, text) whose rep is among ids (rep), written. Texts move only if the ids are too many for a broadcast."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                part = whole.slice(s, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingler.of(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], names=["rep", "set"])

    return keep(texts.join(bounded(ids), "rep", "left_semi").select("rep", "text").mapInArrow(work, "rep long, set binary"), "sets")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, keep: Keep) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. pairs must be written; texts: rep, text. Partners of one hub a are dealt by FAN, and its set goes once to each part."""
    sets = shingle_sets(texts, keep(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "rep"), "ids"), keep)
    many = keep(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("of")).where("of > 1"), "large_fans")  # at most 1/FAN of the pairs
    dealt = pairs.join(bounded(many), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("of", F.lit(1))).cast("int").alias("part"))
    hubs = dealt.select("a", "part").distinct().join(sets.toDF("a", "set"), "a").select("a", "part", F.lit(0).alias("role"), F.col("a").alias("b"), "set")
    partners = dealt.join(sets.toDF("b", "set"), "b").select("a", "part", F.lit(1).alias("role"), "b", "set")
    rows = hubs.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            found = []
            for a, part, role, b, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(data, np.uint64)
                if role == 0:
                    own = [*own, x] if at == (a, part) else [x]  # several sets only where ids repeat with different texts
                    at = (a, part)
                    continue
                for y in own:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        found.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    with small_batches(pairs.sparkSession):
        return keep(rows.mapInArrow(work, "a long, b long"), "confirmed")


def _is_settled(links: DataFrame) -> bool:
    """Whether the links (u, v) are stars: every u has one v, and no v is a u."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    odd = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out = 1 and in = 1)")
    return odd.isEmpty()


def components(edges: DataFrame, keep: Keep) -> DataFrame:
    """node, component (the smallest node reachable) for all nodes of the edges (a, b) but those that are the smallest themselves. Alternating star contraction; each round is a table in the shared folder, and rounds end when only stars are left."""
    links = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _is_settled(links):
        # Large star: every larger neighbour of a node goes to the smallest of its neighbours and itself.
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = keep(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large_star")
        # Small star: every smaller neighbour, and the node, goes to the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        links = keep(large.join(least, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))


def in_blocks(entries: DataFrame, size: Column) -> DataFrame:
    """entries (key, rep and more) as rows of pairs of blocks (key, i, j); `second` tells the row's block where i < j. size: the blocks of a bucket as an aggregate over its entries. Buckets of one block, nearly all, are not copied."""
    of = entries.groupBy("key").agg(F.ceil(size).cast("int").alias("of")).where("of > 1")
    cut = entries.join(of, "key", "left").withColumn("of", F.coalesce("of", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("of")).cast("int"))
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    return spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("second"), *(c for c in entries.columns if c != "key"))


def whole_runs(batches: Iterator[pa.RecordBatch], enough: int = 16 << 20) -> Iterator[pa.Table]:
    """Sorted rows as tables that hold every run of equal (key, i, j) whole; a run is bounded by two blocks."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        more = pa.Table.from_batches([batch])
        held = more if held is None else pa.concat_tables([held, more])
        if held.nbytes >= enough or held.num_rows >= 20_000:
            key, i, j = (held.column(c).to_numpy() for c in ("key", "i", "j"))
            start = int(np.argmax((key == key[-1]) & (i == i[-1]) & (j == j[-1])))
            if start:
                yield held.slice(0, start)
                held = held.slice(start).combine_chunks()
    if held is not None:
        yield held


def open_pairs(table: pa.Table, threshold: float, needed: list[tuple[int, int]], joined: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In bounded portions, the pairs of rows (u, v) of one run that `joined` doesn't know to be in one component and that sizes and signatures let reach the threshold. Row r meets row r + d as long as both are of one run."""
    key, i, j, second, n = (table.column(c).to_numpy() for c in ("key", "i", "j", "second", "n_shingles"))
    sig = signatures(table.column("sig"))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    starts = np.flatnonzero(new)
    end = np.repeat(np.append(starts[1:], len(key)), np.diff(np.append(starts, len(key))))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def settled() -> tuple[np.ndarray, np.ndarray]:
        u, v = (np.concatenate(x) for x in zip(*waiting, strict=True))
        alive = matches(sig[u], sig[v], needed) >= 0
        return u[alive], v[alive]

    left, d = np.arange(len(key)), 1
    while len(left := left[left + d < end[left]]):
        right = left + d
        ok = (i[left] == j[left]) | (second[left] != second[right])
        ok &= (n[left] >= n[right] * (threshold - 1e-9)) & (n[right] >= n[left] * (threshold - 1e-9))
        ok &= ~joined(left, right)
        if ok.any():
            waiting.append((left[ok], right[ok]))
            held += int(ok.sum())
            if held > most:
                yield settled()
                waiting, held = [], 0
        d += 1
    if waiting:
        yield settled()


def with_survivors(entries: DataFrame, threshold: float, miss: float) -> DataFrame:
    """entries: key, rep, n_shingles, sig, component, of buckets with several components. key, rep, n_shingles, component of those with a pair that sizes and signatures let reach the threshold."""
    needed = least_matches(threshold, miss)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches):
            comp = table.column("component").to_numpy()
            hit = np.zeros(table.num_rows, bool)
            for u, v in open_pairs(table, threshold, needed, lambda u, v: comp[u] == comp[v]):
                hit[u] = hit[v] = True
            yield from table.select(["key", "rep", "n_shingles", "component"]).filter(pa.array(hit)).combine_chunks().to_batches()

    rows = in_blocks(entries, F.count(F.lit(1)) / BLOCK).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(work, "key long, rep long, n_shingles long, component long").distinct()


class Joined:
    """A union-find over the components of one run."""

    def __init__(self, component: np.ndarray) -> None:
        self.names, self.of = np.unique(component, return_inverse=True)
        self.root = np.arange(len(self.names))

    def same(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.root[self.of[u]] == self.root[self.of[v]]

    def join(self, u: int, v: int) -> bool:
        a, b = self.root[self.of[u]], self.root[self.of[v]]
        if a != b:
            self.root[self.root == max(a, b)] = min(a, b)
        return a != b


def joining_links(entries: DataFrame, threshold: float, percent: int, miss: float) -> DataFrame:
    """entries: key, rep, n_shingles, component, sig, bands, set. Links (a, b) that hold on the full sets and join, in their run, components that no link before them has joined. A pair counts in the first band that it shares: in every bucket before, it would have met as well."""
    needed = least_matches(threshold, miss)

    def of_run(table: pa.Table) -> Iterator[tuple[int, int]]:
        rep, n = table.column("rep").to_numpy(), table.column("n_shingles").to_numpy()
        state = Joined(table.column("component").to_numpy())
        if len(state.names) < 2:
            return
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        band = int(np.flatnonzero(bands[0] == table.column("key")[0].as_py())[0])
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        edges = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        mine = [ids[edges[r] : edges[r + 1]] for r in range(len(sets))]
        mark = np.zeros(int(ids.max(initial=-1)) + 1, bool)
        for u, v in open_pairs(table, threshold, needed, state.same):
            before = (bands[u, :band] == bands[v, :band]).any(axis=1)
            u, v = u[~before], v[~before]
            if not len(u):
                continue
            order = np.argsort(u, kind="stable")
            u, v = u[order], v[order]
            at = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            for lo, hi in zip(at, [*at[1:], len(u)], strict=True):
                x, others = int(u[lo]), v[lo:hi]
                mark[mine[x]] = True
                for s in range(0, len(others), 64):
                    part = others[s : s + 64]
                    part = part[~state.same(np.full(len(part), x), part)]
                    if not len(part):
                        continue
                    both = np.add.reduceat(mark[np.concatenate([mine[y] for y in part])].astype(np.int64), np.concatenate([[0], np.cumsum(n[part])[:-1]]))
                    for y in part[100 * both >= percent * (n[x] + n[part] - both)]:
                        if state.join(x, int(y)):
                            yield min(int(rep[x]), int(rep[y])), max(int(rep[x]), int(rep[y]))
                mark[mine[x]] = False

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches):
            key, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            links = [x for lo, hi in zip(starts, [*starts[1:], len(key)], strict=True) for x in of_run(table.slice(lo, hi - lo))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    rows = entries.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(work, "a long, b long")


def _labelled(rows: DataFrame, column: str, comps: DataFrame | None, out: str) -> DataFrame:
    """rows with the component of `column`, itself where it has no link."""
    if comps is None:
        return rows.withColumn(out, F.col(column))
    return rows.join(comps.select(F.col("node").alias(column), F.col("component").alias(out)), column, "left").withColumn(out, F.coalesce(out, column))


def _joined(comps: DataFrame | None, links: DataFrame, keep: Keep) -> DataFrame | None:
    """The components with more links (a, b): old ones enter as stars, so few rounds follow."""
    if links.isEmpty():
        return comps
    return components(links if comps is None else links.unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b"))), keep)


def _link(pairs: DataFrame, first: list[str], comps: DataFrame | None, texts: DataFrame, percent: int, keep: Keep) -> DataFrame | None:
    """Confirms pairs (a, b, m): for each value of `first` the likeliest pair, then all pairs that these links leave in different components. Returns the components with the new links."""
    pairs = keep(pairs, "survivors")
    best = keep(pairs.groupBy(*first).agg(F.max(F.struct("m", "a", "b")).alias("p")).select("p.a", "p.b").distinct(), "best")
    if best.isEmpty():
        return comps
    comps = _joined(comps, confirmed(best, texts, percent, keep), keep)
    rest = _labelled(_labelled(pairs.join(best, ["a", "b"], "left_anti"), "a", comps, "of_a"), "b", comps, "of_b").where("of_a <> of_b")
    rest = keep(rest.select("a", "b"), "rest")
    return comps if rest.isEmpty() else _joined(comps, confirmed(rest, texts, percent, keep), keep)


def near_duplicates(docs: DataFrame, percent: int = 80, miss: float = MISS) -> DataFrame:
    """docs (doc_id, text): doc_id, n_shingles, component_id, kept, a row for each row of docs. The result is a written table; the tables on the way to it are deleted."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        sketches, comps, classes = _components_of(docs, percent, miss, keep)
        return written(_named(sketches, _labelled(classes.select("set_key", "rep", "copies"), "rep", comps, "component"), keep), "near_duplicates")


def _components_of(docs: DataFrame, percent: int, miss: float, keep: Keep) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    threshold = percent / 100
    with small_batches(docs.sparkSession):
        sketches = keep(sketched(docs, band_rows(threshold)), "sketches")
    full = sketches.where("set_key is not null and doc_id is not null")
    first = full.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "sig", "bands")).alias("f"), F.count(F.lit(1)).alias("copies"))
    classes = keep(first.select("set_key", F.col("f.doc_id").alias("rep"), "f.n_shingles", "f.sig", "f.bands", "copies"), "classes")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")

    entries = classes.select("rep", F.explode("bands").alias("key"))
    hubs = entries.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keep(entries.join(hubs, "key").select("key", "n", "hub", "rep"), "shared_buckets")

    # Every class with the hub that it shares most buckets with: one pair a class.
    likeliest = shared.where("rep <> hub").groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("m")).groupBy("rep").agg(F.max(F.struct("m", (-F.col("hub")).alias("h"))).alias("x"))
    comps = _link(bayes_pruned(likeliest.select((-F.col("x.h")).alias("a"), F.col("rep").alias("b")), classes, threshold, miss), ["b"], None, texts, percent, keep)

    # Then every class with the hubs of its buckets that are still in another component.
    def opened(rows: DataFrame) -> DataFrame:
        """The entries of buckets with more than one component, with the component of the hub."""
        rows = keep(_labelled(rows, "rep", comps, "component"), "labelled_buckets")
        keys = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "rep").alias("of_hub")).where("low < high").select("key", "of_hub")
        return rows.join(keys, "key")

    candidates = opened(shared).where("component <> of_hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    comps = _link(bayes_pruned(candidates, classes, threshold, miss), ["b"], comps, texts, percent, keep)

    # Then all pairs of different components in a bucket; a bucket of two has been settled by its hub.
    left = opened(shared.where("n > 2").select("key", "rep")).join(classes.select("rep", "n_shingles", "sig"), "rep").select("key", "rep", "n_shingles", "sig", "component")
    alive = keep(with_survivors(left, threshold, miss), "survivors")
    if not alive.isEmpty():
        sets = shingle_sets(texts, keep(alive.select("rep").distinct(), "ids"), keep)
        cut = in_blocks(alive, F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / SHINGLES))
        packed = classes.select("rep", "sig", "bands")
        with small_batches(docs.sparkSession):
            links = keep(joining_links(cut.join(packed, "rep").join(sets, "rep"), threshold, percent, miss), "links")
        comps = _joined(comps, links, keep)
    return sketches, comps, classes


def _named(sketches: DataFrame, named: DataFrame, keep: Keep) -> DataFrame:
    """The rows of sketches with component_id and kept. Classes of more than BLOCK copies, at most 1/BLOCK of the rows, are broadcast; rows without a class are not joined."""
    named = keep(named, "named")
    rows = sketches.select("doc_id", "n_shingles", "set_key")
    large = keep(named.where(F.col("copies") > BLOCK).select("set_key", F.col("component").alias("large")), "large_classes")
    marked = rows.where("set_key is not null").join(bounded(large), "set_key", "left")
    small = marked.where("large is null").join(named.where(F.col("copies") <= BLOCK).select("set_key", "component"), "set_key", "left").select("doc_id", "n_shingles", "component")
    out = small.unionByName(marked.where("large is not null").select("doc_id", "n_shingles", F.col("large").alias("component"))).unionByName(rows.where("set_key is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component")))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, percent=85)


#: All pairs that share a shingle, and the closure of their links.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s), e AS (SELECT doc_id, hash(unnest(s)) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)), t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT t.b, r.root FROM r JOIN t ON t.a = r.doc_id WHERE r.root < t.b),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM m JOIN n USING (doc_id)
"""
