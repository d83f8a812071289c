"""Named queries over the test tables, each with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions import lexicon as lx
from attestor.functions import matching
from attestor.functions import quality as ql
from attestor.functions import text as tx
from attestor.functions import urls
from attestor.operators import coverage as cv
from attestor.operators import dedup, measure, ordered
from attestor.operators import resolve as rs
from attestor.sources import store
from attestor.sources import views as vw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = vw.with_views(sql)
        return f

    return keep


def _in(values: object) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


# --- URLs and source types -------------------------------------------------------------------------------------------------------------------------------


@query("SELECT seq, url, canonical_url, domain FROM v_results")
def url_canonical(spark, sf):
    return vw.results(spark, sf).select("seq", "url", "canonical_url", "domain")


#: Addresses that pages are put under in turn, and why a fetch of them must be refused (null: it need not).
_PLACES = (
    ("https://{h}/{i}", None), ("http://{h}:8080/{i}", None), ("ftp://{h}/{i}", "scheme"), ("https://{h}:22/{i}", "port"), ("http://localhost/{i}", "local host"), ("http://127.0.0.1/{i}", "blocked address"), ("http://10.1.2.3/{i}", "blocked address"),
    ("http://192.168.0.9/{i}", "blocked address"), ("http://169.254.169.254/{i}", "blocked address"), ("http://8.8.8.8/{i}", None), ("http://[::1]/{i}", "blocked address"), ("http://[::ffff:10.0.0.1]/{i}", "blocked address"), ("http://[2001:4860:4860::8888]/{i}", None), ("http://metadata.google.internal/{i}", "metadata host"),
)


def _placed(spark, sf):
    host = F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1))
    at = F.element_at(F.array(*(F.lit(t) for t, _ in _PLACES)), (F.col("page_id") % len(_PLACES) + 1).cast("int"))
    return vw.table(spark, sf, "pages").select("page_id", "url", F.replace(F.replace(at, F.lit("{h}"), host), F.lit("{i}"), F.col("page_id").cast("string")).alias("placed"))


@query(
    f"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS clean,
    lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, regexp_matches(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '\\.pdf$|^/pdf/') AS is_pdf,
    ([{", ".join("NULL" if r is None else f"'{r}'" for _, r in _PLACES)}])[page_id % {len(_PLACES)} + 1] IS NOT NULL AS refused FROM pages"""
)
def url_sanitized(spark, sf):
    """The clean form of each page's URL and its host, and whether the page would be refused under the address that stands in for it."""
    p = _placed(spark, sf)
    clean = urls.sanitized(F.col("url"))
    return p.select("page_id", clean.alias("clean"), urls.host_of(clean).alias("host"), urls.looks_like_pdf(F.col("url")).alias("is_pdf"), urls.unsafe_reason(F.col("placed")).isNotNull().alias("refused"))


#: Hosts of every kind, with the type, base quality and authority that their pages must get.
_HOSTS = (
    ("arxiv.org", "academic", 0.85, "primary"), ("old.reddit.com", "forum", 0.35, "aggregator"), ("docs.acme.io", "official_docs", 0.85, "primary"), ("acme.readthedocs.io", "official_docs", 0.85, "primary"), ("cdc.gov", "government", 0.8, "primary"),
    ("cs.mit.edu", "academic", 0.85, "primary"), ("acme.com/docs", "vendor", 0.55, "secondary"), ("acme.com/blog", "blog", 0.45, "aggregator"), ("acme.com/x?next=/api/", "vendor", 0.55, "secondary"), ("en.wikipedia.org", "reference", 0.7, "secondary"),
    ("example.net", "other", 0.5, "secondary"), ("www.w3.org", "standards_body", 0.9, "primary"), ("reuters.com", "news", 0.6, "secondary"), ("x.com", "social", 0.2, "aggregator"), ("pubmed.ncbi.nlm.nih.gov", "academic", 0.85, "primary"), ("notarxiv.org", "other", 0.5, "secondary"),
)


def _hosted(spark, sf):
    """Every page under its own URL (origin 0), and with its path under a host of a known kind (origin 1)."""
    host = F.element_at(F.array(*(F.lit(h[0]) for h in _HOSTS)), (F.col("page_id") % len(_HOSTS) + 1).cast("int"))
    path = F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    p = vw.table(spark, sf, "pages").select("page_id", F.posexplode(F.array(F.col("url"), F.concat(F.lit("https://"), host, path))).alias("origin", "url"))
    return p.withColumn("domain", urls.domain(F.col("url"))).withColumn("source_type", ql.source_type(F.col("url"), F.col("domain")))


_HOSTED_SQL = f"""h AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{h}', '{t}', {b}::DOUBLE, '{a}')" for i, (h, t, b, a) in enumerate(_HOSTS))}) v(i, host, source_type, base, authority)),
    o AS (SELECT page_id, 0 AS origin, {vw.domain_sql("url")} AS domain, 'other' AS source_type, 0.5::DOUBLE AS base, 'secondary' AS authority FROM pages
    UNION ALL SELECT page_id, 1, regexp_replace(regexp_extract(host, '^[^/]*'), '^www\\.', ''), source_type, base, authority FROM pages JOIN h ON page_id % {len(_HOSTS)} = i)"""


@query(f"WITH {_HOSTED_SQL} SELECT page_id, origin, domain, source_type, base, authority, CASE authority WHEN 'primary' THEN 3 WHEN 'secondary' THEN 2 ELSE 1 END AS rank FROM o")
def source_types(spark, sf):
    t = F.col("source_type")
    return _hosted(spark, sf).select("page_id", "origin", "domain", "source_type", ql.base_quality(t).alias("base"), ql.authority(t).alias("authority"), ql.authority_rank(t).alias("rank"))


@query(
    f"""WITH {_HOSTED_SQL}, r AS (SELECT *, (page_id % 100) / 100.0::DOUBLE AS s, page_id * 7 % 900 AS w, CASE WHEN page_id % 4 = 0 THEN 0::DOUBLE WHEN (page_id % 900) / 30.44::DOUBLE <= 6 THEN 0.08::DOUBLE WHEN (page_id % 900) / 30.44::DOUBLE <= 12 THEN -0.05::DOUBLE ELSE -0.15::DOUBLE END AS recency FROM o)
    SELECT page_id, origin, round(least(greatest(base + (s - 0.5::DOUBLE) * 0.20::DOUBLE + CASE WHEN w < 120 THEN -0.20::DOUBLE WHEN w > 600 THEN 0.05::DOUBLE ELSE 0::DOUBLE END + recency, 0::DOUBLE), 1::DOUBLE), 3) AS quality, recency,
    'type:' || source_type || CASE WHEN w < 120 THEN ' short' WHEN w > 600 THEN ' long' ELSE '' END || CASE WHEN recency > 0 THEN ' recent' WHEN recency < 0 THEN ' dated' ELSE '' END AS reasons FROM r"""
)
def source_quality(spark, sf):
    now = F.lit("2026-06-01").cast("date")
    published = F.when(F.col("page_id") % 4 != 0, F.date_sub(now, (F.col("page_id") % 900).cast("int")))
    words = F.col("page_id") * 7 % 900
    rows = _hosted(spark, sf).withColumn("recency", ql.recency_adjustment(published, now, F.lit(6)))
    score = ql.quality_score(F.col("source_type"), (F.col("page_id") % 100) / 100.0, words, F.col("recency"))
    return rows.select("page_id", "origin", score.alias("quality"), "recency", F.array_join(ql.quality_reasons(F.col("source_type"), words, F.col("recency")), " ").alias("reasons"))


# --- Text ------------------------------------------------------------------------------------------------------------------------------------------------

_S = vw.spaced_sql


@query(
    f"""SELECT doc_id, substr(sha256(lower({_S("text")})), 1, 16) AS content_hash, substr(sha256(text), 1, 12) AS digest, CAST(len(regexp_extract_all(text, '[^ \\t\\r\\n\\f\\x0B]+')) AS INT) AS words,
    regexp_replace(lower({_S("text")}), '[. ]+$', '') AS norm, strlen(text) + 24 + strlen(lang) AS token_bound FROM documents"""
)
def text_normal_forms(spark, sf):
    d, t = vw.table(spark, sf, "documents"), F.col("text")
    return d.select("doc_id", tx.content_hash(t).alias("content_hash"), tx.digest12(t).alias("digest"), tx.word_count(t).alias("words"), tx.claim_normal(t).alias("norm"), tx.token_bound([t, F.col("lang")]).cast("long").alias("token_bound"))


@query(
    f"""SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN {_in(lx.FUNCTION_WORDS)}))) AS content_words,
    trim(substr(regexp_extract(trim(text), '^([^.\\n]*)', 1), 1, 80)) AS first FROM documents"""
)
def text_content_words(spark, sf):
    d, t = vw.table(spark, sf, "documents"), F.col("text")
    return d.select("doc_id", tx.content_words(t, lx.FUNCTION_WORDS).alias("content_words"), F.trim(tx.first_sentence(t, 80)).alias("first"))


@query(
    """WITH m AS (SELECT conv_id, turn, text || ' [S' || conv_id || ', S' || turn || '] and [S' || conv_id || '] end' AS t FROM conversations)
    SELECT conv_id, turn, list_reverse(list_distinct(list_reverse(flatten(list_transform(regexp_extract_all(t, '\\[(S[0-9]+(?:, ?S[0-9]+)*)\\]', 1), lambda g: string_split(replace(g, ' ', ''), ',')))))) AS ids, trim(regexp_replace(t, ' ?\\[S[0-9]+(, ?S[0-9]+)*\\]', '', 'g')) AS plain FROM m"""
)
def citation_markers(spark, sf):
    """Markers of the whole text with three more at its end."""
    c = vw.table(spark, sf, "conversations")
    t = F.concat(F.col("text"), F.lit(" [S"), F.col("conv_id").cast("string"), F.lit(", S"), F.col("turn").cast("string"), F.lit("] and [S"), F.col("conv_id").cast("string"), F.lit("] end"))
    return c.select("conv_id", "turn", tx.markers(t).alias("ids"), tx.unmarkered(t).alias("plain"))


@query(
    """SELECT doc_id, regexp_replace(regexp_replace(text, '(sk|tvly|pk|ghp)[-_][A-Za-z0-9_-]{8,}', '[redacted]', 'g'), '[Bb]earer [A-Za-z0-9._-]{8,}', '[redacted]', 'g') AS scrubbed,
    CAST(len(regexp_extract_all(text, '(?i)(idiot|clown|moron)')) AS INT) AS replaced FROM documents"""
)
def text_redaction(spark, sf):
    d, t = vw.table(spark, sf, "documents"), F.col("text")
    return d.select("doc_id", tx.scrubbed(t).alias("scrubbed"), tx.blinded(t, ["clown", "idiot", "moron"])[1].alias("replaced"))


# --- Search results --------------------------------------------------------------------------------------------------------------------------------------

@query(
    """WITH r AS (SELECT * FROM v_results WHERE canonical_url NOT IN (SELECT canonical_url FROM v_known)),
    q AS (SELECT canonical_url, list(query_id ORDER BY s) AS found_by FROM (SELECT canonical_url, query_id, min(seq) AS s FROM r WHERE sub_question_id <> '' GROUP BY ALL) GROUP BY 1),
    b AS (SELECT canonical_url, list(sub_question_id ORDER BY s) AS sub_questions FROM (SELECT canonical_url, sub_question_id, min(seq) AS s FROM r WHERE sub_question_id <> '' GROUP BY ALL) GROUP BY 1),
    a AS (SELECT canonical_url, min(seq) AS seq, arg_min(url, seq) AS url, arg_min(title, seq) AS title, arg_min(domain, seq) AS domain, max(score) AS best_score, arg_min(content, seq) FILTER (content <> '') AS content, count(*) AS n_results FROM r GROUP BY 1)
    SELECT a.*, coalesce(found_by, []) AS found_by, coalesce(sub_questions, []) AS sub_questions FROM a LEFT JOIN q USING (canonical_url) LEFT JOIN b USING (canonical_url)"""
)
def result_candidates(spark, sf):
    return dedup.by_url(vw.results(spark, sf), vw.known_urls(spark, sf))


@query(
    """WITH p AS (SELECT canonical_url, count(*) AS n, max(CASE WHEN canonical_url IN (SELECT canonical_url FROM v_known) THEN 1 ELSE 0 END) AS k FROM v_results GROUP BY 1),
    s AS (SELECT CAST(sum(n) AS BIGINT) AS results_in, CAST(sum(CASE WHEN k = 1 THEN n ELSE 0 END) AS BIGINT) AS already_known, CAST(sum(CASE WHEN k = 0 THEN n - 1 ELSE 0 END) AS BIGINT) AS duplicate_urls, count(*) FILTER (k = 0) AS candidates FROM p)
    SELECT *, already_known + duplicate_urls AS fetches_avoided, round((already_known + duplicate_urls) / results_in, 4) AS duplicate_rate FROM s"""
)
def dedup_statistics(spark, sf):
    return dedup.url_statistics(vw.results(spark, sf), vw.known_urls(spark, sf))


@query("SELECT query_id, count(r.seq) AS results, count(DISTINCT r.canonical_url) AS urls FROM (SELECT 'Q' || range AS query_id FROM range(10)) q LEFT JOIN v_results r USING (query_id) GROUP BY 1")
def query_counts(spark, sf):
    queries = spark.range(10).select(F.concat(F.lit("Q"), F.col("id").cast("string")).alias("query_id"))
    per = vw.results(spark, sf).groupBy("query_id", "canonical_url").agg(F.count(F.lit(1)).alias("n")).groupBy("query_id").agg(F.sum("n").alias("results"), F.count(F.lit(1)).alias("urls"))
    return queries.join(per, "query_id", "left").fillna(0)


@query(
    """SELECT query_id, seq, round(1 - (row_number() OVER (PARTITION BY query_id ORDER BY seq) - 1) / count(*) OVER (PARTITION BY query_id), 3) AS rank_score,
    CASE WHEN CAST(substr(query_id, 2) AS INT) >= 4 THEN 'advanced' ELSE 'basic' END AS depth FROM v_results"""
)
def rank_scores(spark, sf):
    """Places within a query by running counts over ranges of seq."""
    round_number = F.floor(F.substring("query_id", 2, 9).cast("int") / 4) + 1  # queries 4 and up belong to the second round
    rows = store.written(vw.results(spark, sf).select("query_id", "seq"), "ranked")
    placed = ordered.running_sums(rows, ["query_id"], "seq", [], {"place": F.lit(1)})
    met = placed.join(store.bounded(rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))), "query_id")
    return met.select("query_id", "seq", F.round(1 - (F.col("place") - 1) / F.col("n"), 3).alias("rank_score"), F.when(round_number > 1, "advanced").otherwise("basic").alias("depth"))


def _leaders(spark, sf):
    c = dedup.by_url(vw.results(spark, sf), vw.known_urls(spark, sf)).withColumn("source_type", ql.source_type(F.col("url"), F.col("domain")))
    scored = c.withColumn("ranking", F.round(F.col("best_score") + ql.ranking_adjustment(F.col("source_type"), F.lit(True)), 6))
    rows = scored.select("canonical_url", "domain", "source_type", "ranking", F.explode("sub_questions").alias("sub_question_id"))
    w = Window.partitionBy("sub_question_id").orderBy(F.col("ranking").desc(), F.col("canonical_url").desc())
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 3")


@query(
    """WITH r AS (SELECT * FROM v_results WHERE canonical_url NOT IN (SELECT canonical_url FROM v_known)), c AS (SELECT canonical_url, arg_min(domain, seq) AS domain, max(score) AS best FROM r GROUP BY 1),
    s AS (SELECT *, 'other' AS source_type, round(best + 0.08::DOUBLE, 6) AS ranking FROM c), x AS (SELECT DISTINCT s.canonical_url, s.domain, s.source_type, s.ranking, r.sub_question_id FROM s JOIN r USING (canonical_url) WHERE r.sub_question_id <> ''),
    y AS (SELECT *, CAST(row_number() OVER (PARTITION BY sub_question_id ORDER BY ranking DESC, canonical_url DESC) AS INT) AS place FROM x) SELECT * FROM y WHERE place <= 3"""
)
def source_leaderboard(spark, sf):
    """The best three candidates of each sub-question."""
    return _leaders(spark, sf)


@query("SELECT round(max(n) FILTER (domain <> '') / sum(n), 4) AS concentration, count(*) FILTER (domain <> '') AS domains, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT domain, count(*) AS n FROM v_results GROUP BY 1)")
def domain_concentration(spark, sf):
    return cv.domain_concentration(vw.results(spark, sf))


# --- Sources, evidence, claims ---------------------------------------------------------------------------------------------------------------------------


@query(
    """WITH f AS (SELECT content_hash, arg_min(source_id, doc_id) AS first_id FROM v_sources WHERE usable GROUP BY 1)
    SELECT source_id, CASE WHEN usable AND first_id <> source_id THEN first_id END AS duplicate_of FROM v_sources LEFT JOIN f USING (content_hash)"""
)
def content_duplicates(spark, sf):
    return dedup.by_content(vw.sources(spark, sf))


@query(
    """SELECT c.claim_id, c.pos, c.evidence_id, e.source_id, CASE WHEN e.source_id IS NULL THEN 'unknown_evidence' WHEN quote_match <> 'exact' THEN 'quote_unverified' END AS issue
    FROM (SELECT claim_id, CAST(generate_subscripts(evidence_ids, 1) - 1 AS INT) AS pos, unnest(evidence_ids) AS evidence_id FROM v_claims) c LEFT JOIN v_evidence e USING (evidence_id)"""
)
def claim_resolution(spark, sf):
    return rs.resolved(*vw.cited(spark, sf))


_RESOLVED = """r AS (SELECT c.claim_id, c.pos, c.evidence_id, e.source_id, CASE WHEN e.source_id IS NULL THEN 'unknown_evidence' WHEN quote_match <> 'exact' THEN 'quote_unverified' END AS issue
    FROM (SELECT claim_id, generate_subscripts(evidence_ids, 1) AS pos, unnest(evidence_ids) AS evidence_id FROM v_claims) c LEFT JOIN v_evidence e USING (evidence_id)),
    s AS (SELECT claim_id, list(source_id ORDER BY p) AS source_ids FROM (SELECT claim_id, source_id, min(pos) AS p FROM r WHERE issue IS NULL GROUP BY ALL) GROUP BY 1),
    n AS (SELECT claim_id, count(*) AS cited, count(*) FILTER (issue IS NULL) AS sound, count(*) FILTER (issue = 'unknown_evidence') AS unknown, count(*) FILTER (issue = 'quote_unverified') AS unverified FROM r GROUP BY 1)"""


@query(f"WITH {_RESOLVED} SELECT claim_id, coalesce(source_ids, []) AS source_ids, cited, sound, unknown, unverified FROM n LEFT JOIN s USING (claim_id)")
def claim_citations(spark, sf):
    return rs.citations(*vw.cited(spark, sf))


@query(f"WITH {_RESOLVED} SELECT source_id FROM v_sources WHERE usable AND source_id NOT IN (SELECT source_id FROM r WHERE issue IS NULL)")
def unused_sources(spark, sf):
    return rs.unused_sources(vw.sources(spark, sf), *vw.cited(spark, sf))


@query(
    f"""WITH {_RESOLVED}, a AS (SELECT CAST(sum(cited) AS BIGINT) AS citations, CAST(sum(sound) AS BIGINT) AS sound, CAST(sum(unknown) AS BIGINT) AS unknown, count(*) FILTER (kind <> 'framing') AS substantive, count(*) FILTER (kind <> 'framing' AND sound > 0) AS covered
    FROM n JOIN v_claims USING (claim_id)) SELECT *, coalesce(round(sound / nullif(citations, 0), 4), 1.0::DOUBLE) AS citation_integrity, round(covered / nullif(substantive, 0), 4) AS citation_coverage FROM a"""
)
def citation_integrity(spark, sf):
    return rs.integrity(*vw.cited(spark, sf))


@query(
    f"""WITH k AS (SELECT claim_id, placement, kind, regexp_replace(lower({_S("text")}), '[. ]+$', '') AS norm, evidence_ids, list_position(['summary', 'finding', 'section'], placement) AS p FROM v_claims)
    SELECT claim_id, placement, kind = 'framing' OR row_number() OVER (PARTITION BY norm, evidence_ids, kind = 'framing' ORDER BY p, claim_id) = 1 AS stays FROM k"""
)
def claim_duplicates(spark, sf):
    return dedup.claims(vw.claims(spark, sf))


@query(
    """SELECT claim_id, kind IN ('framing', 'extracted') OR (conv_id % 5 <> 0 AND conv_id % 3 = 0) AS published, CASE WHEN conv_id % 5 = 0 THEN 'unchecked' WHEN conv_id % 3 = 0 THEN 'supported' ELSE 'partial' END AS verdict FROM v_claims"""
)
def publication_gate(spark, sf):
    claims = vw.claims(spark, sf)
    verdicts = claims.where("conv_id % 5 <> 0").groupBy("text", "evidence_ids").agg(F.when(F.min("conv_id") % 3 == 0, "supported").otherwise("partial").alias("verdict"))
    return rs.published(claims, verdicts)


_COVERAGE = """c AS (SELECT sub_question_id, count(*) AS items, count(*) FILTER (quote_match = 'exact') AS exact, count(*) FILTER (quote_match = 'exact' AND relevance >= 0.3) AS fitting,
    count(DISTINCT source_id) FILTER (quote_match = 'exact' AND relevance >= 0.3) AS sources, bool_or(stance = 'contradicts') AS contradicted FROM v_evidence GROUP BY 1),
    v AS (SELECT q.sub_question_id, coalesce(items, 0) AS items, coalesce(exact, 0) AS exact, coalesce(fitting, 0) AS fitting, coalesce(sources, 0) AS sources, coalesce(contradicted, false) AS contradicted,
    coalesce(exact, 0) - coalesce(fitting, 0) AS off_topic, CASE WHEN sources >= 2 AND fitting >= 2 THEN 'covered' WHEN fitting > 0 THEN 'weak' ELSE 'uncovered' END AS verdict,
    CASE WHEN sources >= 2 AND fitting >= 2 THEN '' WHEN fitting > 0 THEN 'evidence insufficient' WHEN exact > 0 THEN 'retrieved source did not discuss this sub-question' ELSE 'no evidence attributed' END AS cause
    FROM (SELECT 'SQ' || range AS sub_question_id FROM range(7)) q LEFT JOIN c USING (sub_question_id))"""


def _covered(spark, sf):
    asked = spark.range(7).select(F.concat(F.lit("SQ"), F.col("id").cast("string")).alias("sub_question_id"))
    return cv.coverage(vw.evidence(spark, sf), asked, F.col("relevance") >= 0.3)


@query(f"WITH {_COVERAGE} SELECT * FROM v")
def sub_question_coverage(spark, sf):
    return _covered(spark, sf)


@query(
    f"""WITH {_COVERAGE}, a AS (SELECT count(*) AS sub_questions, count(*) FILTER (verdict = 'covered') AS covered, count(*) FILTER (verdict = 'uncovered') AS missing, CAST(sum(items) AS BIGINT) AS items FROM v),
    d AS (SELECT round(max(n) FILTER (domain <> '') / sum(n), 4) AS concentration FROM (SELECT domain, count(*) AS n FROM v_sources GROUP BY 1))
    SELECT *, round(covered / sub_questions, 4) AS ratio, round(covered / sub_questions, 4) >= 0.7 AND missing = 0 AND items > 0 AS sufficient, concentration > 0.6 AND (SELECT count(*) FROM v_sources) > 2 AS diversity_warning FROM a, d"""
)
def coverage_assessment(spark, sf):
    return cv.assessment(_covered(spark, sf), cv.domain_concentration(vw.sources(spark, sf)))


@query(
    """WITH e AS (SELECT v.*, round(relevance, 3) AS confidence, coalesce(s.quality, 0) AS rank FROM v_evidence v LEFT JOIN v_sources s USING (source_id) WHERE quote_match = 'exact' AND round(relevance, 3) >= 0.25),
    r AS (SELECT sub_question_id, CAST(row_number() OVER (PARTITION BY sub_question_id ORDER BY (stance = 'contradicts') DESC, round(confidence, 1) DESC, rank DESC, confidence DESC, evidence_id) AS INT) AS place, evidence_id, confidence, rank FROM e)
    SELECT * FROM r WHERE place <= 8"""
)
def evidence_packages(spark, sf):
    rank = vw.sources(spark, sf).select("source_id", F.col("quality").alias("rank"))
    return cv.packages(vw.evidence(spark, sf), rank)


@query("SELECT 'S' || doc_id AS source_id, item_id FROM v_held")
def exact_quotes(spark, sf):
    """Passages that a document holds word for word in the matching form."""
    return vw.quote_places(spark, sf, close=False).select(F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("source_id"), "item_id")


# --- Topics -----------------------------------------------------------------------------------------------------------------------------------------------

_TERMS = lambda x: (
    f"list_filter(list_distinct(list_concat(regexp_extract_all(lower({x}), '[a-z][a-z0-9-]{{2,}}'), flatten(list_transform(regexp_extract_all(lower({x}), '[a-z][a-z0-9-]{{2,}}'), lambda w: CASE WHEN contains(w, '-') THEN list_filter(string_split(w, '-'), lambda y: length(y) >= 3) ELSE [] END)))), lambda w: w NOT IN {_in(lx.TOPIC_STOPWORDS)})"
)


@query(
    f"""WITH d AS (SELECT doc_id, unnest({_TERMS("text")}) AS t FROM documents), b AS (SELECT item_id, {_TERMS("text")} AS q FROM benchmark), c AS (SELECT item_id, len(q) AS n, unnest(q) AS t FROM b)
    SELECT doc_id, item_id, count(*) AS shared, bool_or(length(t) >= 8) OR count(*) >= least(2, any_value(n)) AS plausible FROM d JOIN c USING (t) GROUP BY ALL"""
)
def topical_overlap(spark, sf):
    """Documents and items that share a salient term: how many, and whether the document could bear on the item. Terms are made once a row and joined, never pairs of rows."""
    d = vw.table(spark, sf, "documents").select("doc_id", F.explode(lx.salient_terms(F.col("text"))).alias("t"))
    b = vw.table(spark, sf, "benchmark").select("item_id", lx.salient_terms(F.col("text")).alias("q")).select("item_id", F.size("q").alias("n"), F.explode("q").alias("t"))
    met = d.join(b, "t").groupBy("doc_id", "item_id", "n").agg(F.count(F.lit(1)).alias("shared"), F.max(F.length("t")).alias("longest"))
    return met.select("doc_id", "item_id", "shared", ((F.col("longest") >= lx.DISTINCTIVE) | (F.col("shared") >= F.least(F.lit(lx.OVERLAP), F.col("n")))).alias("plausible"))


@query()
def quote_classes(spark, sf):
    """Class and place of each piece of evidence: exact, fuzzy or none, and the offset in the document as it is. The ratio of the fuzzy form has no SQL form; tests compare it with plain code."""
    return vw.evidence(spark, sf, close=True).select("doc_id", "item_id", "quote_match", "offset")


# --- Calibration and comparison --------------------------------------------------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT guards_passed AND score >= 0.75 AS p, supported AS a FROM v_verdicts), n AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM c)
    SELECT *, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 4) AS agreement, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall FROM n"""
)
def verdict_confusion(spark, sf):
    return measure.confusion(vw.verdicts(spark, sf), F.col("guards_passed") & (F.col("score") >= 0.75), F.col("supported"))


_SWEEP = """s AS (SELECT t / 100.0::DOUBLE AS threshold, count(*) FILTER (guards_passed AND floor(round(score * 100, 6)) >= t AND supported) AS tp, count(*) FILTER (guards_passed AND floor(round(score * 100, 6)) >= t AND NOT supported) AS fp,
    count(*) FILTER (NOT (guards_passed AND floor(round(score * 100, 6)) >= t) AND supported) AS fn, count(*) FILTER (NOT (guards_passed AND floor(round(score * 100, 6)) >= t) AND NOT supported) AS tn FROM v_verdicts, (SELECT range AS t FROM range(50, 100)) GROUP BY t)"""


@query(f"WITH {_SWEEP} SELECT threshold, tp, fp, fn, tn FROM s")
def threshold_sweep(spark, sf):
    return measure.sweep(vw.verdicts(spark, sf)).select("threshold", "tp", "fp", "fn", "tn")


@query(f"WITH {_SWEEP} SELECT threshold, tp, fp, fn, tn FROM s WHERE fp = 0 ORDER BY tp DESC, threshold DESC LIMIT 1")
def threshold_choice(spark, sf):
    return measure.chosen_threshold(measure.sweep(vw.verdicts(spark, sf))).select("threshold", "tp", "fp", "fn", "tn")


_PAIRED = "g AS (SELECT question_id, repetition, list_sort(list_distinct(list(arm))) AS arms FROM v_runs WHERE ok GROUP BY ALL), b AS (SELECT *, arms = ['cloud', 'local'] AS is_paired FROM g)"


@query(f"WITH {_PAIRED} SELECT question_id, repetition, arms, is_paired FROM b")
def paired_repetitions(spark, sf):
    return measure.paired(vw.runs(spark, sf))


@query(
    f"""WITH {_PAIRED}, l AS (SELECT is_paired, arm, 'relevance_a' AS dimension, relevance_a AS value FROM v_runs JOIN b USING (question_id, repetition) WHERE ok UNION ALL SELECT is_paired, arm, 'relevance_b', relevance_b FROM v_runs JOIN b USING (question_id, repetition) WHERE ok)
    SELECT is_paired, arm, dimension, round(avg(value), 4) AS mean, count(*) AS n FROM l GROUP BY ALL"""
)
def paired_means(spark, sf):
    return measure.paired_means(vw.runs(spark, sf), ["relevance_a", "relevance_b"])


@query("SELECT question_id, arm, count(*) AS n, count(*) FILTER (abs(relevance_a - relevance_b) >= 2) AS disagreements, round(avg(relevance_a - relevance_b), 4) AS bias FROM v_runs WHERE ok GROUP BY ALL")
def reviewer_disagreement(spark, sf):
    gap = F.col("relevance_a") - F.col("relevance_b")
    return vw.runs(spark, sf).where("ok").groupBy("question_id", "arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(gap) >= 2).alias("disagreements"), F.round(F.avg(gap), 4).alias("bias"))


@query(
    """SELECT arm, count(*) AS runs, count(*) FILTER (ok) AS completed, round(avg(duration) FILTER (ok), 2) AS mean_duration, round(min(duration) FILTER (ok), 2) AS least, round(max(duration) FILTER (ok), 2) AS most FROM v_runs GROUP BY ROLLUP (arm)"""
)
def run_totals(spark, sf):
    good = F.when(F.col("ok"), F.col("duration"))
    return vw.runs(spark, sf).rollup("arm").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.expr("ok")).alias("completed"), F.round(F.avg(good), 2).alias("mean_duration"), F.round(F.min(good), 2).alias("least"), F.round(F.max(good), 2).alias("most"))


# --- Usage, ledgers, quotas ------------------------------------------------------------------------------------------------------------------------------

PRICES = {"*": (1.0, 2.0), "model-1": (0.5, 1.5), "model-1-mini": (0.1, 0.4), "model-2": (3.0, 15.0)}
_PRICED = """p AS (SELECT *, CASE WHEN starts_with(model, 'model-1-mini') THEN 'model-1-mini' WHEN starts_with(model, 'model-1') THEN 'model-1' WHEN starts_with(model, 'model-2') THEN 'model-2' ELSE '*' END AS price_of FROM v_attempts),
    k AS (SELECT p.*, round((input_tokens * i + output_tokens * o) / 1000000, 8) AS cost FROM p JOIN (VALUES ('*', 1.0::DOUBLE, 2.0::DOUBLE), ('model-1', 0.5, 1.5), ('model-1-mini', 0.1, 0.4), ('model-2', 3.0, 15.0)) v(name, i, o) ON price_of = name)"""


@query(f"WITH {_PRICED} SELECT seq, model, price_of, cost FROM k")
def attempt_costs(spark, sf):
    return measure.priced(vw.attempts(spark, sf), PRICES).select("seq", "model", "price_of", "cost")


@query(
    f"""WITH {_PRICED} SELECT role, count(*) AS requests, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'rate_limited') AS rate_limited, count(*) FILTER (status = 'error') AS errors, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
    CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost), 4) AS cost, count(*) FILTER (cost IS NULL) AS unpriced FROM k GROUP BY 1"""
)
def usage_totals(spark, sf):
    return measure.usage(measure.priced(vw.attempts(spark, sf), PRICES)).withColumn("cost", F.round("cost", 4))


@query(
    f"""WITH {_PRICED}, c AS (SELECT seq, role, date_trunc('day', ts) AS d, cost, round(sum(cost) OVER (PARTITION BY role, date_trunc('day', ts) ORDER BY seq), 8) AS cumulative FROM k)
    SELECT seq, cumulative, round(0.02 - (cumulative - cost), 8) AS headroom, cumulative <= 0.02 AS fits FROM c"""
)
def spend_ledger(spark, sf):
    rows = measure.priced(vw.attempts(spark, sf), PRICES).withColumn("key", F.concat_ws("|", "role", F.to_date("ts").cast("string")))
    return measure.ledger(rows, "key", "seq", "cost", 0.02).select("seq", "cumulative", "headroom", "fits")


@query("SELECT event_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) <= 100 AS admitted FROM events")
def daily_quota(spark, sf):
    return measure.daily_quota(vw.table(spark, sf, "events"), 100)


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) <= 2 AS within FROM events")
def rolling_hour(spark, sf):
    return measure.rolling_hour(vw.table(spark, sf, "events"), 2).select("event_id", "in_hour", "within")


@query(
    """WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM l)
    SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY ALL"""
)
def user_sessions(spark, sf):
    return measure.sessions(vw.table(spark, sf, "events"), 6 * 3600)


@query("SELECT event_type, round(sum(round(value, 3)), 3) AS seconds, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def stage_seconds(spark, sf):
    per = vw.table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.sum(F.round("value", 3)).alias("v"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("event_type").agg(F.round(F.sum("v"), 3).alias("seconds"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("users"))
