from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestor.llm.common import fresh_path
from attestor.llm.token_counts import Rollup, changes_between, inserts, op6_token_counts, token_counts

SF = "/root/testdata/sf0.001"
COUNTS = "doc_id long, source string, lang string, tokenizer_version string, tokens long"


def as_dict(df):
    return {(r.source, r.lang, r.tokenizer_version): (r.documents, r.tokens) for r in df.collect()}


def summed(rows):
    n, t = Counter(), Counter()
    for _, s, lang, v, k in rows:
        n[s, lang, v] += 1
        t[s, lang, v] += k or 0
    return {g: (n[g], t[g]) for g in n}


def test_deltas(spark):
    store = Rollup(spark, fresh_path(spark, "counts"))
    assert as_dict(store.totals()) == {}
    first = [(1, "a", "en", "v1", 10), (2, "a", None, "v1", 5), (3, None, "en", "v1", None), (1, "a", "en", "v2", 7), (None, "b", "en", "v1", 4)]
    second = [(1, "a", "en", "v1", 12), (2, "c", None, "v1", 5), (1, "a", "en", "v2", 7), (9, "a", "en", "v1", 1), (None, "b", "en", "v1", 4)]
    a, b = spark.createDataFrame(first, COUNTS), spark.createDataFrame(second, COUNTS)
    assert store.commit("one", inserts(a)) and not store.commit("one", inserts(a))
    assert as_dict(store.totals()) == summed(first)
    feed = changes_between(a, b)
    assert Counter(r.op for r in feed.collect()) == {"revise": 2, "delete": 1, "insert": 1}
    assert store.commit("two", feed)
    assert as_dict(store.totals()) == summed(second)
    store.compact()
    assert as_dict(store.totals()) == summed(second) and not store.commit("two", feed) and {r.id for r in store.batches().collect()} == {"one", "two"}
    assert store.commit("three", changes_between(b, a)) and as_dict(store.totals()) == summed(first)
    assert store.commit("none", changes_between(a, a)) and as_dict(store.totals()) == summed(first)
    store.compact()
    assert as_dict(store.totals()) == summed(first) and store.commit("rest", changes_between(a, a.limit(0))) and as_dict(store.totals()) == {}


def test_unfinished_batches_do_not_count(spark):
    store = Rollup(spark, fresh_path(spark, "counts"))
    rows = spark.createDataFrame([(1, "a", "en", "v", 3)], COUNTS)
    inserts(rows).selectExpr("source", "lang", "tokenizer_version", "1L as documents", "99L as tokens").write.parquet(f"{store.path}/unfinished/x")
    assert as_dict(store.totals()) == {} and store.commit("x", inserts(rows)) and as_dict(store.totals()) == {("a", "en", "v"): (1, 3)}
    with pytest.raises(Exception, match="unknown op"):
        store.commit("y", inserts(rows).selectExpr("'odd' as op", *[c for c in inserts(rows).columns if c != "op"]))
    with pytest.raises(ValueError):
        store.commit("../z", inserts(rows))


def test_two_writers_and_a_commit_during_compaction(spark, monkeypatch):
    store = Rollup(spark, fresh_path(spark, "counts"))
    rows = spark.createDataFrame([(1, "a", "en", "v", 3)], COUNTS)
    store.commit("a", inserts(rows))
    # Both writers have seen that the id is free; the second finds it taken when it renames.
    with monkeypatch.context() as m:
        m.setattr(Rollup, "has", lambda self, batch: False)
        assert not store.commit("a", inserts(rows)) and as_dict(store.totals()) == {("a", "en", "v"): (1, 3)}
    # A batch that comes while the deltas are summed is not in the compaction, and counts beside it.
    real = Rollup._totals

    def slow(self, folded, deltas):
        out = real(self, folded, deltas)
        if not self.has("b"):
            self.commit("b", inserts(rows))
        return out

    with monkeypatch.context() as m:
        m.setattr(Rollup, "_totals", slow)
        store.compact()
    assert {r.id for r in store.batches().collect()} == {"a", "b"} and as_dict(store.totals()) == {("a", "en", "v"): (2, 6)}
    store.compact()
    assert as_dict(store.totals()) == {("a", "en", "v"): (2, 6)} and store._list(f"{store.path}/deltas") == ["b"]


def test_query_against_plain_code(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.source, r.lang, "words-1", len((r.text or "").encode().split())) for r in docs.collect()]
    rows += [(r.doc_id, r.source, r.lang, "byte_bpe_50k", len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
    assert as_dict(op6_token_counts(spark, SF)) == summed(rows)
    assert token_counts(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_odd_documents(spark):
    """Repeated ids, null texts and a column that bears the name of our own."""
    docs = spark.createDataFrame([(1, "a b", "s", "en"), (1, "a b", "s", "en"), (1, "other words here", "s", "en"), (None, None, None, None), (2, "word " * 50_000, "s", "de")], "doc_id long, text string, source string, lang string").withColumn("_words", F.lit("x")).withColumn("tokens", F.lit("y"))
    rows = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).where("tokenizer_version = 'words-1'").collect()
    assert sorted((r.doc_id or 0, r.tokens) for r in rows) == [(0, 0), (1, 2), (1, 2), (1, 3), (2, 50_000)]
