"""Deduplication of results, sources and claims. "First" always means the smallest explicit sequence number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import lexicon as lx
from attestor.functions import matching
from attestor.functions import text as tx
from attestor.sources import store


def ordered_distinct(pairs: Column) -> Column:
    """The second fields of an array of (order, value), distinct, in order."""
    return F.array_distinct(F.transform(F.array_sort(pairs), lambda p: p["v"]))


def by_url(results: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One candidate a canonical URL: the first row's spelling, title and domain, the best score, the first content there is, and the queries and sub-questions that found it. URLs in `known` are left out."""
    rows = results.where("canonical_url <> ''")
    if known is not None:
        rows = rows.join(known.select("canonical_url").distinct(), "canonical_url", "left_anti")
    found = F.struct(F.col("seq").alias("o"), F.col("query_id").alias("v"))
    asked = F.when(F.col("sub_question_id") != "", F.struct(F.col("seq").alias("o"), F.col("sub_question_id").alias("v")))
    return rows.groupBy("canonical_url").agg(
        F.min("seq").alias("seq"), F.min_by("url", "seq").alias("url"), F.min_by("title", "seq").alias("title"), F.min_by("domain", "seq").alias("domain"), F.max("score").alias("best_score"),
        F.min_by("content", F.when(F.col("content") != "", F.col("seq"))).alias("content"), F.count(F.lit(1)).alias("n_results"),
        ordered_distinct(F.collect_set(F.when(F.col("sub_question_id") != "", found))).alias("found_by"), ordered_distinct(F.collect_set(asked)).alias("sub_questions"),
    )


def url_statistics(results: DataFrame, known: DataFrame) -> DataFrame:
    """One row: results in, already known, duplicate URLs, candidates, fetches avoided and the duplicate rate."""
    rows = results.where("canonical_url <> ''").join(known.select("canonical_url", F.lit(1).alias("_known")).distinct(), "canonical_url", "left")
    # Counts by URL first, so that no distinct count gathers a whole column.
    per = rows.groupBy("canonical_url").agg(F.count(F.lit(1)).alias("n"), F.max("_known").alias("k"))
    out = per.agg(F.sum("n").alias("results_in"), F.sum(F.when(F.col("k") == 1, F.col("n")).otherwise(0)).alias("already_known"), F.sum(F.when(F.col("k").isNull(), F.col("n") - 1).otherwise(0)).alias("duplicate_urls"), F.count_if(F.col("k").isNull()).alias("candidates"))
    avoided = F.col("already_known") + F.col("duplicate_urls")
    return out.withColumn("fetches_avoided", avoided).withColumn("duplicate_rate", F.round(avoided / F.col("results_in"), 4))


def by_content(sources: DataFrame, order: str = "doc_id") -> DataFrame:
    """source_id, duplicate_of: the first usable source with the same content, null for that one and for unusable rows. Hashes are reduced before they are joined back."""
    first = sources.where("usable").groupBy("content_hash").agg(F.min_by("source_id", order).alias("first_id"))
    rows = sources.join(first, "content_hash", "left")
    return rows.select("source_id", F.when(F.col("usable") & (F.col("first_id") != F.col("source_id")), F.col("first_id")).alias("duplicate_of"))


PLACEMENTS = ("summary", "finding", "section")


def claims(rows: DataFrame) -> DataFrame:
    """Which claims stay: of those with one normal text and one list of evidence the first by placement and id, and of those left the first that asserts with one set of content words in one slot. Framing always stays; a claim without slot or content words restates none."""
    place = F.array_position(F.array(*(F.lit(p) for p in PLACEMENTS)), F.col("placement"))
    words = tx.content_words(F.col("text"), lx.FUNCTION_WORDS)
    keyed = rows.select("claim_id", "placement", "kind", "evidence_ids", F.trim(F.coalesce("slot", F.lit(""))).alias("_slot"), tx.claim_normal(F.col("text")).alias("_norm"), words.alias("_words"), F.struct(place.alias("p"), F.col("claim_id").alias("c")).alias("_at"))
    owed = keyed.where("kind <> 'framing'")
    first = owed.groupBy("_norm", "evidence_ids").agg(F.min(F.struct("_at", "_slot", "_words")).alias("f")).select("f.*")
    restated = first.where((F.col("_slot") != "") & (F.size("_words") > 0)).groupBy("_slot", "_words").agg(F.min("_at").alias("_at")).select("_at")
    kept = restated.unionByName(first.where((F.col("_slot") == "") | (F.size("_words") == 0)).select("_at"))
    return keyed.select("claim_id", "placement", "kind", "_at").join(kept.withColumn("_kept", F.lit(True)).hint("merge"), "_at", "left").select("claim_id", "placement", ((F.col("kind") == "framing") | F.col("_kept").isNotNull()).alias("stays"))


#: Lengths that e + 1 pieces of a title have, where e characters may be left over. near_pairs doesn't use pieces any more; a test holds these.
PIECE_WIDTHS = (4, 5, 6)
#: Titles of one domain and with equal digits that a task compares with as many others at most, about.
BLOCK_TITLES = 4096
#: How the characters of a title are counted: by this many classes, up to this many each.
CLASSES, LEVELS = 32, 8


def _signatures(titles: list[str]) -> np.ndarray:
    """A row of bits a title: for each class of characters as many as it has of it, LEVELS at most. Two titles differ in no more bits than they leave characters over."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in titles]
    row = np.repeat(np.arange(len(titles)), [len(p) for p in points])
    counts = np.bincount(row * CLASSES + np.concatenate(points) % CLASSES, minlength=len(titles) * CLASSES).reshape(len(titles), CLASSES, 1)
    return np.packbits((counts > np.arange(LEVELS)).reshape(len(titles), -1), axis=1).view(np.uint64)


def _edits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Characters of two titles of n and m characters that a matching ratio leaves over at most, on both sides together."""
    return np.floor((1 - matching.TITLE_RATIO) * (n + m) + 1e-9).astype(np.int64)


def may_match(left: list[str], right: list[str] | None = None) -> Iterator[tuple[int, int]]:
    """Places (i in left, j in right; without right i < j in left) of all titles that leave no more characters over than a matching ratio allows, as counted and then in order."""
    s, n = _signatures(left), np.array([len(t) for t in left])
    s2, m = (s, n) if right is None else (_signatures(right), np.array([len(t) for t in right]))
    other = left if right is None else right
    for at in range(0, len(left), 256):
        a = s[at : at + 256]
        most = _edits(n[at : at + 256].max(), m.max())
        half = np.bitwise_count(a[:, None, 0] ^ s2[None, :, 0])
        half += np.bitwise_count(a[:, None, 1] ^ s2[None, :, 1])
        i, j = np.nonzero(half <= most)
        i += at
        if right is None:
            i, j = i[i < j], j[i < j]
        near = np.bitwise_count(s[i] ^ s2[j]).sum(axis=1, dtype=np.int64) <= _edits(n[i], m[j])
        i, j = i[near], j[near]
        last, places = -1, {}
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if x != last:
                last, places = x, {}
                for p, c in enumerate(left[x]):
                    places[c] = places.get(c, 0) | 1 << p
            if 2 * matching.common_subsequence(places, len(left[x]), other[y]) >= matching.TITLE_RATIO * (len(left[x]) + len(other[y])) - 1e-9:
                yield x, y


def near_pairs(titles: DataFrame) -> DataFrame:
    """domain, first, then (numbers, first < then) of all titles (domain, digits, number, t; written) of one domain and with equal digits that match. t: at least SHORTEST_TITLE characters; each stands once.

    Titles that may match meet in blocks: a group of up to BLOCK_TITLES is one, a larger one is cut, and each two of its blocks meet in one task, which holds no more than these. Within it, titles are compared by the bits of their
    counted characters, then by their longest common subsequence; only what passes both is written, and the ratio decides. The work is the pairs of a group, about 20 ns each.
    """
    group = ["domain", "digits"]
    cut = titles.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / BLOCK_TITLES).alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    dealt = titles.select(*group, "number", "t").join(cut.hint("merge"), group).withColumn("own", F.pmod(F.xxhash64("t"), F.col("blocks")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(*group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "number", "t")
    keys = [*group, "i", "j"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, ([], [])

        def pairs() -> pd.DataFrame:
            (domain, _, i, j), (left, right) = last, held
            meets = may_match([t for _, t in left]) if i == j else may_match([t for _, t in left], [t for _, t in right]) if left and right else ()
            second = left if i == j else right
            rows = [(domain, *min(left[x], second[y]), *max(left[x], second[y])) for x, y in meets]
            return pd.DataFrame(rows, columns=["domain", "first", "x", "then", "y"])

        for b in batches:
            for *key, own, number, t in b.itertuples(index=False, name=None):
                if key != last:
                    if last is not None:
                        yield pairs()
                    last, held = key, ([], [])
                held[own != key[2]].append((number, t))
        if last is not None:
            yield pairs()

    tasks = 8 * titles.sparkSession.sparkContext.defaultParallelism
    rows = met.repartition(tasks, *keys).sortWithinPartitions(*keys)  # few bytes, much work: dealt over the cores
    return rows.mapInPandas(work, "domain string, first long, x string, then long, y string").where(matching.titles_match(F.col("y"), F.col("x"))).select("domain", "first", "then")


def near_titles(candidates: DataFrame) -> DataFrame:
    """Candidates (canonical_url, seq, domain, title) whose title is nearly that of an earlier one of their domain that is kept itself: canonical_url, kept_as (the earliest such).

    Joins are shuffled ones by hint: titles compress well, so that what looks small enough for a broadcast may fill the driver. Equal titles are one, with the number of the first: all have its fate. Who is kept depends on who was kept before: the near pairs of a domain, not its titles, go through one task in order, which holds the numbers of those given up.
    """
    low = F.lower(tx.one_spaced(F.coalesce("title", F.lit(""))))
    t = candidates.select("canonical_url", "seq", "domain", low.alias("t")).where(F.length("t") >= matching.SHORTEST_TITLE)
    t = t.withColumn("digits", F.array_join(F.regexp_extract_all("t", F.lit("([0-9]+)"), 1), ","))
    own = store.written(t.groupBy("domain", "digits", "t").agg(F.min("seq").alias("number"), F.min_by("canonical_url", "seq").alias("url"), F.count(F.lit(1)).alias("copies")), "titles")
    near = near_pairs(own).select("domain", "then", "first")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        domain, given_up = None, set()
        for b in batches:
            out = []
            for d, then, first in b.itertuples(index=False):
                if d != domain:
                    domain, given_up = d, set()
                if first not in given_up and then not in given_up:
                    given_up.add(then)
                    out.append((then, first))
            yield pd.DataFrame(out, columns=["number", "kept"])

    gone = store.written(near.repartition("domain").sortWithinPartitions("domain", "then", "first").mapInPandas(decide, "number long, kept long"), "near_titles")
    urls = own.select(F.col("number").alias("kept"), F.col("url").alias("kept_as"))
    fate = own.join(gone.hint("merge"), "number", "left").withColumn("kept", F.coalesce("kept", "number")).join(urls.hint("merge"), "kept").where("copies > 1 or kept <> number").select("domain", "digits", "t", "kept", "kept_as")
    return t.join(fate.hint("merge"), ["domain", "digits", "t"]).where(F.col("seq") != F.col("kept")).select("canonical_url", "kept_as")


def collapsed(candidates: DataFrame) -> DataFrame:
    """Candidates without those given up for a near title; what found these is added to the one kept, whose own score and content stay."""
    gone = store.written(near_titles(candidates), "given_up")
    lost = candidates.join(gone.hint("merge"), "canonical_url").select("kept_as", "seq", "sub_questions")
    more = lost.select("kept_as", "seq", F.posexplode("sub_questions").alias("i", "q")).groupBy("kept_as").agg(ordered_distinct(F.collect_set(F.struct(F.struct("seq", "i").alias("o"), F.col("q").alias("v")))).alias("more"), F.count_distinct("seq").alias("merged"))
    kept = candidates.join(gone.select("canonical_url").hint("merge"), "canonical_url", "left_anti").join(more.withColumnRenamed("kept_as", "canonical_url").hint("merge"), "canonical_url", "left")
    added = F.coalesce("more", F.array().cast("array<string>"))
    return kept.withColumn("sub_questions", F.array_union("sub_questions", added)).withColumn("merged", F.coalesce("merged", F.lit(0))).drop("more")


def first_occurrences(rows: DataFrame, key: Column, order: str, into: str = "is_first") -> DataFrame:
    """rows with a flag at the first of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn(into, F.row_number().over(w) == 1)
