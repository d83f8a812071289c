import pytest
from pyspark.sql import functions as F

from attestor.functions import lexicon as lx
from attestor.functions import wording
from attestor.functions.register import register
from attestor.functions import quality as ql
from attestor.functions import text as tx
from attestor.functions import urls
from attestor.functions.matching import main_text, propositions, quote_match, titles_match
from attestor.operators.selection import allocate, interleaved, starved


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_canonical_urls(spark):
    pairs = {
        "https://www.Shop.test/item?utm_source=x&id=7#top": "https://shop.test/item?id=7", "https://shop.test/item/?id=7": "https://shop.test/item?id=7", "http://shop.test:80/item?id=7": "http://shop.test/item?id=7",
        "https://shop.test:8443/a?b=2&a=1&gclid=z": "https://shop.test:8443/a?a=1&b=2", "https://shop.test": "https://shop.test/", "https://shop.test/x/index.html": "https://shop.test/x", "https://shop.test/x/amp": "https://shop.test/x",
        "https://user@shop.test./caf%C3%A9?flag": "https://shop.test/café?flag=", "not a url": "not a url", "  ": "", "https://shop.test/a%zz": "https://shop.test/a%zz",
    }
    assert column(spark, list(pairs), urls.canonical) == list(pairs.values())
    assert column(spark, [None], urls.canonical) == [""]


def test_url_policy(spark):
    cases = {"https://a.test/x.pdf": None, "ftp://a.test/": "scheme", "https://a.test:22/": "port", "http://localhost/": "local host", "http://10.1.2.3/": "private address", "http://172.20.0.1:8080/": "private address", "http://8.8.8.8/": None, "http://x.internal/": "local host", "//a": "scheme"}
    assert column(spark, list(cases), urls.unsafe_reason) == list(cases.values())
    assert column(spark, ["https://u:p@A.test:81/p?q#f", "mailto:x", None], urls.sanitized) == ["https://a.test:81/p", "", ""]


def test_text(spark):
    assert column(spark, ["a  b\n c", None], tx.word_count) == [3, 0]
    assert column(spark, ["One [S1] and [S2, S1]."], tx.markers) == [["S1", "S2"]]
    assert column(spark, ["Caf “x” – y z"], tx.for_match) == ['caf "x" - y z']
    assert column(spark, ["aaa bbb ccc", "short"], lambda c: tx.clipped(c, 8)) == ["aaa bbb…", "short"]
    assert column(spark, ["# Head\n**bold** [link](http://x) ![i](y)"], tx.unmarked) == ["Head\nbold link"]
    assert column(spark, ["First part. Second part is longer than that."], lambda c: tx.truncated(c, 15)) == ["First part."]
    assert column(spark, ["key sk-abcdefghij and Bearer abcdefgh123"], tx.scrubbed) == ["key [redacted] and [redacted]"]


def test_source_types(spark):
    cases = {"https://export.arxiv.org/abs/1": "academic", "https://docs.acme.test/": "official_docs", "https://acme.github.io/x": "official_docs", "https://acme.gov/": "government", "https://acme.test/docs/x": "vendor", "https://acme.test/blog/x": "blog", "https://acme.test/": "other", "https://old.reddit.com/r": "forum"}
    assert column(spark, list(cases), lambda c: ql.source_type(c, urls.domain(c))) == list(cases.values())


GUARDED = [
    ("numeric", "Uses 40% less", "It uses 40 % less power", True), ("numeric", "Uses 41% less", "It uses 40% less power", False), ("numeric", "Has 1,000 rows", "has 1000 rows", True),
    ("modality", "It must restart", "It may restart", False), ("modality", "It may restart", "It may restart", True), ("modality", "It often fails", "It may require care", False),
    ("hedge", "B uses AES", "A may fail under load. B uses AES.", True), ("hedge", "A fails under load", "A may fail under load. B uses AES.", False),
    ("framing", "Batches train faster", "We observed that batches train faster.", False), ("framing", "The study found that batches train faster", "We observed that batches train faster.", True),
    ("ranking", "It is the fastest", "It takes 5 ms", False), ("ranking", "It is the fastest", "It beats the rest", True),
    ("causal", "Noise causes errors", "Noise is associated with errors", False), ("causal", "Noise causes errors", "Errors due to noise", True),
    ("exclusivity", "Only A works", "A works", False), ("exclusivity", "Only A works", "only A works", True),
    ("atomicity", "A rose. B fell.", "", False), ("atomicity", "A rose, whereas B fell", "", False), ("atomicity", "A rose by e.g. ten", "", True),
]


def test_guards(spark):
    rows = spark.createDataFrame(GUARDED, "g string, c string, e string, want boolean")
    out = rows.select("*", wording.run_guards(F.col("c"), F.col("e"), F.lit("")).alias("all")).collect()
    for r in out:
        assert next(x["passed"] for x in r["all"] if x["name"] == r.g) == r.want, r
    nulls = spark.range(1).select(wording.run_guards(*[F.lit(None).cast("string")] * 3).alias("g")).first().g
    assert len(nulls) == 9


def test_plausible(spark):
    cases = [("causes of overfitting", "Overfitting appears early", True), ("data leakage", "data only", False), ("", "x", True), ("data leakage", "", False), ("self-attention layers", "scaled attention layers", True)]
    rows = spark.createDataFrame(cases, "q string, e string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", lx.plausible(F.col("q"), F.col("e")).alias("got")).collect())


def test_fuzzy(spark):
    text = "The committee approved the new water treatment plan after a long debate in the spring session."
    cases = [("approved the new water treatment plan", "exact"), ("approved the new  WATER treatment plan", "exact"), ("approved the new waste treatment plan after", "fuzzy"), ("rejected every budget proposal outright", "none"), ("approved", "none"), (None, "none")]
    rows = spark.createDataFrame([(q, w, text) for q, w in cases], "q string, want string, t string")
    assert [r.got for r in rows.select(quote_match(F.col("q"), F.col("t")).alias("got")).collect()] == [w for _, w in cases]
    titles = [("A practical guide to caching 2", "A practical guide to caching 2!", True), ("A practical guide to caching 2", "A practical guide to caching 3", False), ("Short", "Short", False)]
    rows = spark.createDataFrame(titles, "a string, b string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", titles_match(F.col("a"), F.col("b")).alias("got")).collect())


def test_html_and_propositions(spark):
    html = '<html><head><title>T</title></head><body><nav><a>Menu</a></nav><div class="ad">Buy</div><h1>Head</h1><p>One &amp; <b>two</b><script>x()</script><p>Three</body></html>'
    assert column(spark, [html, None], main_text) == ["Head\nOne & two\nThree", ""]
    assert column(spark, ["The output increased, and the error rate decreased", "Fast, cheap and small parts are sold; they break", None], lambda _: propositions("x")) == [["The output increased", "the error rate decreased"], ["Fast, cheap and small parts are sold; they break"], []]


def test_allocation(spark):
    rows = [(1, "u1", 0.9, ["a"]), (1, "u2", 0.8, ["a", "b"]), (1, "u3", 0.7, ["b"]), (1, "u4", 0.7, ["c"]), (1, "u5", 0.7, ["c"]), (1, "u6", 0.95, [])]
    df = spark.createDataFrame(rows, "run_id long, canonical_url string, ranking double, sub_questions array<string>")
    got = [(r.canonical_url, r.for_sub_question) for r in allocate(df, 4).orderBy("pick").collect()]
    assert got == [("u1", "a"), ("u2", "b"), ("u5", "c"), ("u6", None)]
    asked = spark.createDataFrame([(1, q) for q in "abcd"], "run_id long, sub_question_id string")
    assert [r.sub_question_id for r in starved(df, allocate(df, 4), asked).collect()] == ["d"]
    queries = spark.createDataFrame([("SQ1", 2, "Q1"), ("SQ1", 2, "Q2"), ("SQ2", 1, "Q3"), ("SQ2", 1, "Q4")], "sub_question_id string, priority int, query_id string")
    assert [r.query_id for r in interleaved(queries, 3).collect()] == ["Q3", "Q1", "Q4"]


@pytest.mark.parametrize("values,want", [(["a b", "A  B."], True), (["a b", "a c"], False)])
def test_claim_normal(spark, values, want):
    a, b = column(spark, values, tx.claim_normal)
    assert (a == b) == want


def test_registered_functions(spark):
    register(spark)
    spark.createDataFrame([(1, "A fell, and the cost grows."), (2, ""), (3, None)], "id int, claim string").createOrReplaceTempView("said")
    rows = spark.sql("SELECT id, part, said FROM said, LATERAL propositions(claim) ORDER BY id, part").collect()
    assert [(r.id, r.part, r.said) for r in rows] == [(1, 0, "A fell"), (1, 1, "the cost grows")]
    r = spark.sql("SELECT comparison_sides('Kafka vs Redis') AS s, main_text('<p>a</p>') AS m, title_ratio('ab', 'ab') AS t").first()
    assert (r.s, r.m, r.t) == (["Kafka", "Redis"], "a", 1.0)
