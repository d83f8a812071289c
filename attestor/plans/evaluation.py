"""Named queries of evaluation: the twelve metrics of a run, benchmark means, reviews, audits, corpora and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import text as tx
from attestor.operators import accounts, dedup, gate, metrics
from attestor.operators import coverage as cv
from attestor.operators import measure
from attestor.operators import resolve as rs
from attestor.plans.queries import _COVERAGE, _PRICED, _RESOLVED, PRICES, query
from attestor.plans.verification import _VERDICTS_SQL, _verdicts
from attestor.sources import store
from attestor.sources import views as vw

# --- Runs ------------------------------------------------------------------------------------------------------------------------------------------------


_METRICS = (
    ("evidence_integrity", "sound", "cited", True), ("citation_integrity", "known", "links", True), ("citation_coverage", "covered", "substantive", True), ("*support", "supported", "checked", True), ("partial_support", "partly", "checked", False),
    ("quote_fidelity", "exact", "quotes", True), ("quote_drift", "fuzzy", "quotes", False), ("evidence_coverage", "covered_questions", "questions", True), ("source_diversity", "outside_largest", "usable", True),
    ("contradiction_auditability", "auditable", "contradictions", True), ("duplicate_avoidance", "avoided", "results", True), ("unused_source_rate", "unused", "usable", False),
)


@query(
    f"""WITH {_RESOLVED}, {_VERDICTS_SQL.replace(" s AS (", " s2 AS (").replace("FROM s)", "FROM s2)")}, {_COVERAGE.replace("c AS (", "cc AS (", 1).replace("v AS (", "vv AS (").replace("LEFT JOIN c USING", "LEFT JOIN cc USING")},
    u AS (SELECT *, content_hash AS h FROM v_sources WHERE usable), dd AS (SELECT s.* FROM u s JOIN (SELECT h, arg_min(source_id, doc_id) AS f FROM u GROUP BY 1) x ON s.source_id = x.f),
    b AS (SELECT contradiction_id, min(ok) AS ok FROM (SELECT conv_id % 11 AS contradiction_id, conv_id // 50 % 2 AS side, max(CASE WHEN verdict = 'supported' THEN 1 ELSE 0 END) AS ok FROM v_claims LEFT JOIN v USING (claim_id) GROUP BY ALL) GROUP BY 1 HAVING count(*) = 2),
    pr AS (SELECT canonical_url, count(*) AS k, max(CASE WHEN canonical_url IN (SELECT canonical_url FROM v_known) THEN 1 ELSE 0 END) AS known FROM v_results GROUP BY 1),
    o AS (SELECT (SELECT sum(sound) FROM n) AS sound, (SELECT sum(cited) FROM n) AS cited, (SELECT count(*) FROM (SELECT DISTINCT claim_id, source_id FROM r WHERE issue IS NULL) JOIN v_sources USING (source_id)) AS known, (SELECT count(*) FROM (SELECT DISTINCT claim_id, source_id FROM r WHERE issue IS NULL)) AS links,
      (SELECT count(*) FROM n JOIN v_claims USING (claim_id) WHERE kind <> 'framing' AND sound > 0) AS covered, (SELECT count(*) FROM v_claims WHERE kind <> 'framing') AS substantive, (SELECT count(*) FROM v WHERE verdict = 'supported') AS supported, (SELECT count(*) FROM v WHERE verdict <> 'unchecked') AS checked,
      (SELECT count(*) FROM v WHERE verdict = 'partial') AS partly, (SELECT count(*) FROM v) AS owed, (SELECT count(*) FROM v_evidence WHERE quote_match = 'exact') AS exact, 0 AS fuzzy, (SELECT count(*) FROM v_evidence) AS quotes, (SELECT count(*) FROM vv WHERE verdict = 'covered') AS covered_questions, 7 AS questions,
      (SELECT count(*) FROM dd) - (SELECT max(k) FROM (SELECT count(*) AS k FROM dd GROUP BY domain)) AS outside_largest, (SELECT count(*) FROM dd) AS usable, (SELECT count(*) FROM b WHERE ok = 1) AS auditable, (SELECT count(*) FROM b) AS contradictions,
      (SELECT sum(CASE WHEN known = 1 THEN k ELSE k - 1 END) FROM pr) AS avoided, (SELECT sum(k) FROM pr) AS results, (SELECT count(*) FROM dd WHERE source_id NOT IN (SELECT source_id FROM r WHERE issue IS NULL)) AS unused),
    m AS ({" UNION ALL ".join(f"SELECT {'CASE WHEN checked = owed THEN ' + chr(39) + 'claim_support' + chr(39) + ' ELSE ' + chr(39) + 'sampled_claim_support' + chr(39) + ' END' if n[0] == '*' else chr(39) + n + chr(39)} AS name, {p} AS a, {w} AS b, {str(h).lower()} AS higher_is_better FROM o" for n, p, w, h in _METRICS)})
    SELECT name, round(a / nullif(b, 0), 4) AS value, CAST(a AS BIGINT) || '/' || CAST(b AS BIGINT) AS detail, higher_is_better FROM m"""
)
def evaluation_metrics(spark, sf):
    """The twelve metrics of a run. Evidence, claims, citations and verdicts are computed once, as tables, and each count reduces them to a row."""
    sources = vw.sources(spark, sf)
    evidence = vw.evidence(spark, sf)
    claims = store.written(vw.claims(spark, sf, evidence).drop("text"), "claims")
    resolved = store.written(rs.resolved(claims, evidence), "citations")
    verdicts = store.written(_verdicts(spark, sf, claims, evidence), "verdicts")
    cites = rs.integrity(claims, evidence).select(F.col("citations").alias("cited"), "sound", "substantive", "covered")
    links = resolved.where("issue is null").select("claim_id", "source_id").distinct().join(sources.select("source_id", F.lit(1).alias("k")), "source_id", "left").agg(F.count(F.lit(1)).alias("links"), F.count("k").alias("known"))
    verdict = verdicts.agg(F.count(F.lit(1)).alias("owed"), F.count_if(F.expr("verdict = 'supported'")).alias("supported"), F.count_if(F.expr("verdict <> 'unchecked'")).alias("checked"), F.count_if(F.expr("verdict = 'partial'")).alias("partly"))
    quotes = evidence.agg(F.count(F.lit(1)).alias("quotes"), F.count_if(F.expr("quote_match = 'exact'")).alias("exact"), F.count_if(F.expr("quote_match = 'fuzzy'")).alias("fuzzy"))
    asked = cv.coverage(evidence, spark.range(7).select(F.concat(F.lit("SQ"), F.col("id").cast("string")).alias("sub_question_id")), F.col("relevance") >= 0.3).agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.expr("verdict = 'covered'")).alias("covered_questions"))
    own = sources.where("usable").join(dedup.by_content(sources).where("duplicate_of is null").select("source_id"), "source_id")
    diverse = own.groupBy("domain").agg(F.count(F.lit(1)).alias("k")).agg(F.sum("k").alias("usable"), (F.sum("k") - F.max("k")).alias("outside_largest"))
    used = resolved.where("issue is null").select("source_id").distinct()
    unused = own.select("source_id").join(used, "source_id", "left_anti").agg(F.count(F.lit(1)).alias("unused"))
    sides = claims.select((F.col("conv_id") % 11).alias("contradiction_id"), (F.floor(F.col("conv_id") / 50) % 2).alias("side"), "claim_id")
    both = sides.select("contradiction_id", "side").distinct().groupBy("contradiction_id").agg(F.count(F.lit(1)).alias("n")).where("n = 2").agg(F.count(F.lit(1)).alias("contradictions"))
    sound = gate.both_sides(sides, verdicts).agg(F.count(F.lit(1)).alias("auditable"))
    avoided = dedup.url_statistics(vw.results(spark, sf), vw.known_urls(spark, sf)).select(F.col("fetches_avoided").alias("avoided"), F.col("results_in").alias("results"))
    one = metrics.joined_rows(cites, links, verdict, quotes, asked, diverse, unused, both, sound, avoided)
    support = F.when(F.col("checked") == F.col("owed"), "claim_support").otherwise("sampled_claim_support")
    return metrics.ratio_rows(one, [(support if n == "*support" else n, p, w, h) for n, p, w, h in _METRICS])


@query("SELECT question_id AS category, metric, round(avg(value), 4) AS mean, count(value) AS n FROM (UNPIVOT (SELECT question_id, duration, relevance_a::DOUBLE AS relevance_a, relevance_b::DOUBLE AS relevance_b FROM v_runs WHERE ok) ON duration, relevance_a, relevance_b INTO NAME metric VALUE value) GROUP BY GROUPING SETS ((metric), (question_id, metric))")
def benchmark_means(spark, sf):
    """Mean of each measurement over good runs, by question and over all."""
    r = vw.runs(spark, sf).where("ok").select(F.col("question_id").alias("category"), "duration", F.col("relevance_a").cast("double").alias("relevance_a"), F.col("relevance_b").cast("double").alias("relevance_b"))
    return metrics.means(r, "category", ["duration", "relevance_a", "relevance_b"])


@query("SELECT 'event' AS what, event_type AS kind, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'origin', CASE WHEN n_chars = 0 THEN 'none' WHEN doc_id % 3 = 0 THEN 'provider' ELSE 'fetched' END, count(*) FROM documents GROUP BY ALL")
def kind_counts(spark, sf):
    """Events by kind, documents by where their content comes from."""
    origin = F.when(F.col("n_chars") == 0, "none").when(F.col("doc_id") % 3 == 0, "provider").otherwise("fetched")
    count = lambda df, what, kind: df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return count(vw.table(spark, sf, "events"), "event", F.col("event_type")).unionByName(count(vw.table(spark, sf, "documents"), "origin", origin))


@query(
    """WITH c AS (SELECT claim_id * 10 + i AS claim_id, CASE WHEN i = 0 THEN placement ELSE 'section' END AS placement, kind, evidence_ids, CASE WHEN conv_id % 5 = 0 THEN '' ELSE slot END AS slot, CASE i WHEN 0 THEN text WHEN 1 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '.' ELSE array_to_string(list_reverse(string_split(text, ' ')), ' ') END AS text FROM v_claims, (VALUES (0), (1), (2)) x(i)),
    k AS (SELECT *, regexp_replace(lower(trim(regexp_replace(text, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'))), '[. ]+$', '') AS norm, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','have','in','is','it','its','of','on','or','that','the','this','to','was','were','will','with','which','while','but','not','no','can','may')))) AS words, list_position(['summary', 'finding', 'section'], placement) AS p FROM c),
    f AS (SELECT *, row_number() OVER (PARTITION BY norm, evidence_ids, kind = 'framing' ORDER BY p, claim_id) AS n FROM k), g AS (SELECT *, row_number() OVER (PARTITION BY slot, words ORDER BY p, claim_id) AS m FROM f WHERE n = 1 AND kind <> 'framing')
    SELECT k.claim_id, k.placement, k.kind = 'framing' OR coalesce(g.slot = '' OR len(g.words) = 0 OR g.m = 1, false) AS stays FROM k LEFT JOIN g ON k.claim_id = g.claim_id"""
)
def claim_restatements(spark, sf):
    """Every claim thrice: as it is, in capitals with a stop, and with its words turned round."""
    c = vw.claims(spark, sf).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    text = F.when(F.col("i") == 0, F.col("text")).when(F.col("i") == 1, F.concat(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("."))).otherwise(F.array_join(F.reverse(F.split("text", " ")), " "))
    return dedup.claims(c.select((F.col("claim_id") * 10 + F.col("i")).alias("claim_id"), F.when(F.col("i") == 0, F.col("placement")).otherwise("section").alias("placement"), "kind", "evidence_ids", F.when(F.col("conv_id") % 5 == 0, "").otherwise(F.col("slot")).alias("slot"), text.alias("text")))


def _titled(spark, sf) -> DataFrame:
    """Candidates with titles that come again, with another sign at the end, another number or nothing else in common, on the same host and on others."""
    c = dedup.by_url(vw.results(spark, sf)).select("canonical_url", "seq", "sub_questions")
    n = F.col("seq")
    title = F.concat(F.lit("A guide to number "), F.element_at(F.array(*(F.lit(w) for w in ("seven and caching", "seven and caching!", "seven 2 and caching", "queues of all kinds", "queues of all kindz"))), (n % 5 + 1).cast("int")))
    return c.select("canonical_url", "seq", F.concat(F.lit("host"), (n % 13).cast("string")).alias("domain"), title.alias("title"), "sub_questions")


@query(
    """WITH c AS (SELECT canonical_url, min(seq) AS seq FROM v_results WHERE canonical_url <> '' GROUP BY 1), t AS (SELECT canonical_url, seq, seq % 13 AS d, [0, 0, 2, 3, 3][seq % 5 + 1] AS k FROM c)
    SELECT canonical_url, arg_min(u, s) AS kept_as FROM (SELECT t.canonical_url, e.canonical_url AS u, e.seq AS s FROM t JOIN t e ON t.d = e.d AND t.k = e.k AND e.seq < t.seq) GROUP BY 1"""
)
def near_titles(spark, sf):
    return dedup.near_titles(_titled(spark, sf))


@query()
def collapsed_candidates(spark, sf):
    """Candidates by URL without those whose title is nearly that of an earlier one of their domain; what found these counts for the one kept. The ratio has no SQL form; a test does it in plain loops."""
    found = dedup.by_url(vw.results(spark, sf)).select("canonical_url", "seq", "domain", "title", "best_score", "sub_questions")
    return dedup.collapsed(store.written(found, "candidates"))


# --- Reviews ---------------------------------------------------------------------------------------------------------------------------------------------


def _packet(spark, sf):
    """Cases with what a person says of them: supported, unsupported, uncertain; one in nine was never labelled, one label in seven has no case."""
    d = vw.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    word = F.when(F.col("doc_id") % 5 == 0, "uncertain").when(F.col("quality") == 1, "supported").otherwise("unsupported")
    return d.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("case_id")), d.where("doc_id % 9 <> 0").select(F.col("doc_id").alias("case_id"), word.alias("human"))


_PACKET = "d AS (SELECT doc_id AS case_id, max(quality) AS quality FROM labels GROUP BY 1), k AS (SELECT case_id FROM d WHERE case_id % 7 <> 0), h AS (SELECT case_id, CASE WHEN case_id % 5 = 0 THEN 'uncertain' WHEN quality = 1 THEN 'supported' ELSE 'unsupported' END AS human FROM d WHERE case_id % 9 <> 0)"


@query(f"WITH {_PACKET} SELECT case_id, 'missing' AS side FROM k WHERE case_id NOT IN (SELECT case_id FROM h) UNION ALL SELECT case_id, 'unexpected' FROM h WHERE case_id NOT IN (SELECT case_id FROM k)")
def label_differences(spark, sf):
    return metrics.key_differences(*_packet(spark, sf), ["case_id"])


@query(f"WITH {_PACKET}, j AS (SELECT human = 'supported' AS a, case_id * 31 % 100 >= 40 AS p FROM k JOIN h USING (case_id)), n AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM j) SELECT *, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 4) AS agreement, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall FROM n")
def reviewer_confusion(spark, sf):
    """Published against a person's label; uncertain counts as not supported."""
    cases, human = _packet(spark, sf)
    return measure.confusion(cases.join(human, "case_id"), F.col("case_id") * 31 % 100 >= 40, F.col("human") == "supported")


def _sheet(spark, sf):
    o = vw.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    rows = o.select(F.when(F.col("k") % 97 == 0, F.col("k") - 1).otherwise(F.col("k")).alias("random_id"), (F.col("c") % 6).alias("relevance"), F.when(F.col("k") % 41 == 0, None).otherwise(F.col("c") % 5 + 1).alias("clarity"), F.when(F.col("k") % 53 == 0, "maybe").when(F.col("c") % 2 == 0, "Yes").otherwise("no").alias("harmful"))
    return rows, o.where("k % 101 <> 0").select(F.col("k").alias("random_id"))


@query(
    """WITH s AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS random_id, o_custkey % 6 AS relevance, CASE WHEN o_orderkey % 41 <> 0 THEN o_custkey % 5 + 1 END AS clarity, CASE WHEN o_orderkey % 53 = 0 THEN 'maybe' WHEN o_custkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS harmful FROM orders),
    f AS (SELECT random_id, list_filter([CASE WHEN count(*) OVER (PARTITION BY random_id) > 1 THEN 'repeated' END, CASE WHEN random_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 101 <> 0) THEN 'unknown' END, CASE WHEN relevance < 1 THEN 'relevance' END, CASE WHEN clarity IS NULL THEN 'clarity' END, CASE WHEN harmful = 'maybe' THEN 'harmful' END], lambda x: x IS NOT NULL) AS faults FROM s)
    SELECT random_id, faults FROM f WHERE len(faults) > 0"""
)
def sheet_faults(spark, sf):
    sheet, known = _sheet(spark, sf)
    return metrics.sheet_faults(sheet, "random_id", ["relevance", "clarity"], "harmful", known)


@query("SELECT o_orderkey AS run, reviewer, substr(sha256(reviewer || '|' || o_orderkey), 1, 16) AS random_id FROM orders, (VALUES ('a'), ('b')) v(reviewer) WHERE o_orderstatus <> 'P'")
def review_packets(spark, sf):
    """Every good run for two reviewers under ids that only the key resolves."""
    good = vw.table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("run"))
    return metrics.blinded_order(good, ["run"], "a").withColumn("reviewer", F.lit("a")).unionByName(metrics.blinded_order(good, ["run"], "b").withColumn("reviewer", F.lit("b")))


@query("SELECT question_id, repetition, arm, count(*) AS disputes, max(abs(relevance_a - relevance_b)) AS widest FROM v_runs WHERE ok AND abs(relevance_a - relevance_b) >= 2 GROUP BY ALL")
def adjudication_packet(spark, sf):
    """Runs that two reviewers judge two grades apart or more."""
    gap = F.abs(F.col("relevance_a") - F.col("relevance_b"))
    return vw.runs(spark, sf).where("ok").where(gap >= 2).groupBy("question_id", "repetition", "arm").agg(F.count(F.lit(1)).alias("disputes"), F.max(gap).alias("widest"))


@query(
    f"""WITH {_VERDICTS_SQL} SELECT placement, count(*) AS judged, count(*) FILTER (verdict = 'supported') AS published, count(*) FILTER (verdict = 'supported' AND turn % 2 = 0) AS unsafe, count(*) FILTER (verdict <> 'supported' AND turn % 2 = 1) AS withheld, round(count(*) FILTER (verdict = 'supported') / count(*), 4) AS rate,
    count(*) FILTER (diagnosis <> '') AS diagnosed FROM v JOIN v_claims USING (claim_id) GROUP BY ROLLUP (placement)"""
)
def audit_counts(spark, sf):
    """Judged, published, wrongly published and wrongly withheld claims by placement and over all; claims of odd turns ought to be published."""
    rows = _verdicts(spark, sf).join(vw.claim_texts(spark, sf).select("claim_id", "placement", "turn"), "claim_id")
    yes, right = F.col("verdict") == "supported", F.col("turn") % 2 == 1
    return rows.rollup("placement").agg(F.count(F.lit(1)).alias("judged"), F.count_if(yes).alias("published"), F.count_if(yes & ~right).alias("unsafe"), F.count_if(~yes & right).alias("withheld"), F.round(F.count_if(yes) / F.count(F.lit(1)), 4).alias("rate"), F.count_if(F.col("diagnosis") != "").alias("diagnosed"))


@query(
    """SELECT c.claim_id, c.kind, c.pos, c.evidence_id, e.source_id, e.source_id IS NOT NULL AS resolved, CASE WHEN e.source_id IS NOT NULL THEN 'https://' || s.domain || '/' || s.doc_id END AS source_url
    FROM (SELECT claim_id, kind, CAST(generate_subscripts(evidence_ids, 1) - 1 AS INT) AS pos, unnest(evidence_ids) AS evidence_id FROM v_claims) c LEFT JOIN v_evidence e USING (evidence_id) LEFT JOIN v_sources s USING (source_id)"""
)
def published_citations(spark, sf):
    """Claims with their quotes and the pages of these; what doesn't resolve stays, marked."""
    claims, evidence = vw.cited(spark, sf)
    c = claims.select("claim_id", "kind", F.posexplode("evidence_ids").alias("pos", "evidence_id"))
    s = vw.sources(spark, sf).select("source_id", F.concat(F.lit("https://"), "domain", F.lit("/"), F.col("doc_id").cast("string")).alias("source_url"))
    return c.join(evidence.select("evidence_id", "source_id"), "evidence_id", "left").join(s, "source_id", "left").select("claim_id", "kind", "pos", "evidence_id", "source_id", F.col("source_id").isNotNull().alias("resolved"), "source_url")


@query(
    f"""WITH {_VERDICTS_SQL}, j AS (SELECT c.claim_id, c.kind, v.verdict, c.kind IN ('framing', 'extracted') OR c.turn % 4 = 1 AS shown FROM v_claims c LEFT JOIN v USING (claim_id))
    SELECT claim_id, CASE WHEN verdict = 'supported' THEN 'withheld though supported' ELSE 'shown though not supported' END AS disagreement FROM j WHERE kind = 'substantive' AND shown <> (verdict = 'supported')"""
)
def gate_disagreements(spark, sf):
    """Substantive claims whose showing (turns 1, 5, ...) goes against their verdict."""
    j = vw.claim_texts(spark, sf).where("kind = 'substantive'").select("claim_id", (F.col("turn") % 4 == 1).alias("shown")).join(_verdicts(spark, sf).select("claim_id", (F.col("verdict") == "supported").alias("ok")), "claim_id")
    return j.where("shown <> ok").select("claim_id", F.when(F.col("ok"), "withheld though supported").otherwise("shown though not supported").alias("disagreement"))


# --- Usage and limits ------------------------------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_PRICED}, r AS (SELECT role, seq, round((input_tokens * 15.0::DOUBLE + 700 * 15.0::DOUBLE) / 1000000 * CASE WHEN seq % 37 = 0 THEN 0.001::DOUBLE ELSE 1::DOUBLE END, 8) AS reserved, cost AS used FROM k)
    SELECT role, count(*) AS calls, round(sum(reserved), 6) AS reserved, round(sum(used), 6) AS used, round(sum(reserved - used), 6) AS given_back, count(*) FILTER (used > reserved + 1e-9) AS breaches, sum(used) <= sum(reserved) + 1e-9 AS sufficient FROM r GROUP BY 1"""
)
def settled_reservations(spark, sf):
    """Worst-case reservations of calls (too small for one in 37) against what they cost."""
    k = measure.priced(vw.attempts(spark, sf), PRICES)
    worst = F.round((F.col("input_tokens") * 15.0 + 700 * 15.0) / 1000000 * F.when(F.col("seq") % 37 == 0, 0.001).otherwise(1.0), 8)
    return accounts.settled(k.select("role", "seq", worst.alias("reserved"), F.col("cost").alias("used")), "role", "seq", "reserved", "used")


_REFUSED = """o AS (SELECT o_custkey AS k, o_orderkey AS seq, 1.0::DOUBLE AS requests, (o_orderkey % 5000 + 100)::DOUBLE AS input_tokens, (o_orderkey % 700)::DOUBLE AS output_tokens FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS i FROM o),
    f(k, i, seq, a, b, c, refused) AS (SELECT k, 0::BIGINT, NULL::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, NULL::VARCHAR FROM (SELECT DISTINCT k FROM o)
      UNION ALL SELECT n.k, n.i, n.seq, CASE WHEN x THEN a + requests ELSE a END, CASE WHEN x THEN b + input_tokens ELSE b END, CASE WHEN x THEN c + output_tokens ELSE c END, CASE WHEN a + requests > 8 THEN 'requests' WHEN b + input_tokens > 20000 THEN 'input_tokens' WHEN c + output_tokens > 2500 THEN 'output_tokens' END
      FROM f JOIN n ON n.k = f.k AND n.i = f.i + 1, LATERAL (SELECT a + requests <= 8 AND b + input_tokens <= 20000 AND c + output_tokens <= 2500 AS x))"""


@query(f"WITH RECURSIVE {_REFUSED} SELECT k AS custkey, seq, refused FROM f WHERE i > 0")
def refused_requests(spark, sf):
    """Requests of a client against ceilings of three dimensions; one that is refused takes nothing."""
    o = vw.table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("seq"), F.lit(1.0).alias("requests"), (F.col("o_orderkey") % 5000 + 100).cast("double").alias("input_tokens"), (F.col("o_orderkey") % 700).cast("double").alias("output_tokens"))
    return accounts.first_refused(o, "custkey", "seq", {"requests": 8, "input_tokens": 20000, "output_tokens": 2500})


@query(
    f"""WITH {_PRICED} SELECT role, count(*) AS requests, count(DISTINCT seq // 2) AS logical, round(count(*) / count(DISTINCT seq // 2), 3) AS requests_per_call,
    CASE WHEN count(*) FILTER (model LIKE '%3%') > 0 THEN '>= $' || printf('%.4f', sum(cost)) || ' (' || count(*) FILTER (model LIKE '%3%') || ' unpriced)' ELSE '$' || printf('%.4f', sum(cost)) END AS shown, round(sum(input_tokens * 2.0::DOUBLE + output_tokens * 8.0::DOUBLE) / 1e6, 6) AS flat FROM k GROUP BY 1"""
)
def usage_display(spark, sf):
    """Requests for each logical call (two attempts share one), the cost as shown, and the flat cost. Models with a 3 in their name count as unpriced."""
    k = measure.priced(vw.attempts(spark, sf), PRICES).withColumn("call", F.floor(F.col("seq") / 2))
    per = k.groupBy("role", "call").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("c"), F.count_if(F.col("model").contains("3")).alias("u"), F.sum(F.col("input_tokens") * 2.0 + F.col("output_tokens") * 8.0).alias("f"))
    out = per.groupBy("role").agg(F.sum("n").alias("requests"), F.count(F.lit(1)).alias("logical"), F.sum("c").alias("c"), F.sum("u").alias("u"), F.sum("f").alias("f"))
    return out.select("role", "requests", "logical", F.round(F.col("requests") / F.col("logical"), 3).alias("requests_per_call"), accounts.cost_display(F.col("c"), F.col("u")).alias("shown"), F.round(F.col("f") / 1e6, 6).alias("flat"))


@query(
    """SELECT conv_id, turn, CASE WHEN conv_id % 40 = 0 THEN 24 ELSE least(conv_id % 40, 24) END AS runs, 2 * greatest(turn % 5, conv_id % 7) AS claims_requested, greatest(2, conv_id % 30 // 2) AS sub_questions, CASE WHEN conv_id % 11 >= 4 THEN conv_id % 11 - 2 ELSE 0 END AS claim_budget,
    coalesce(['explain', 'numeric', NULL, 'definition'][turn % 4 + 1] IN ('explain', 'definition'), true) AS accountable FROM conversations"""
)
def run_limits(spark, sf):
    """Limits that only go down, claims asked for, sub-questions that sources pay for, claims that the calls left pay for, and whether accountable sources are preferred."""
    c, conv, turn = vw.table(spark, sf, "conversations"), F.col("conv_id"), F.col("turn")
    kind = F.element_at(F.array(F.lit("explain"), F.lit("numeric"), F.lit(None), F.lit("definition")), (turn % 4 + 1).cast("int"))
    return c.select(
        "conv_id", "turn", accounts.at_most(conv % 40, F.lit(24)).alias("runs"), (F.greatest(turn % 5, conv % 7) * 2).alias("claims_requested"), F.greatest(F.lit(2), F.floor(conv % 30 / 2)).alias("sub_questions"),
        F.when(conv % 11 >= 4, conv % 11 - 2).otherwise(0).alias("claim_budget"), F.coalesce(kind.isin("explain", "definition"), F.lit(True)).alias("accountable"),
    )


_ERRORS = (("HTTP 429 Too Many Requests", "the provider refused more calls"), ("Read timeout after 20 s", "a call took too long"), ("daily budget exhausted", "a limit was reached"), ("KeyError: 'x' at /srv/app.py", "an internal error"), ("", ""))


@query(
    f"""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'auth' WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'bad_request' WHEN 4 THEN 'unavailable' WHEN 5 THEN 'failed' ELSE 'rate_limited' END AS class, ([{", ".join("'" + r + "'" for _, r in _ERRORS)}])[event_id % 5 + 1] AS reason, event_id % 5 = 0 AS is_rate_limit FROM events"""
)
def error_classes(spark, sf):
    e = vw.table(spark, sf, "events")
    status = F.element_at(F.array(*(F.lit(s) for s in (204, 403, 429, 422, 503, 302, 432))), (F.col("event_id") % 7 + 1).cast("int"))
    said = F.element_at(F.array(*(F.lit(m) for m, _ in _ERRORS)), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", accounts.status_class(status).alias("class"), accounts.public_reason(said).alias("reason"), accounts.is_rate_limit(said).alias("is_rate_limit"))


# --- Corpora and texts -----------------------------------------------------------------------------------------------------------------------------------


@query(
    """WITH o AS (SELECT (SELECT count(*) FROM v_sources) AS sources, (SELECT count(*) FROM v_sources WHERE usable) AS usable, (SELECT count(*) FROM v_evidence) AS evidence, (SELECT count(*) FROM v_evidence WHERE quote_match = 'exact') AS citable, (SELECT count(*) FROM v_evidence WHERE source_id NOT IN (SELECT source_id FROM v_sources)) AS orphans) SELECT problem FROM o, (SELECT unnest([CASE WHEN NOT sources > 0 THEN 'no sources' END, CASE WHEN NOT usable = sources THEN 'unusable sources' END, CASE WHEN NOT citable > 0 THEN 'no citable evidence' END, CASE WHEN NOT citable = evidence THEN 'evidence without a sound quote' END, CASE WHEN NOT orphans = 0 THEN 'evidence without a source' END]) AS problem) WHERE problem IS NOT NULL"""
)
def corpus_problems(spark, sf):
    s, e = vw.sources(spark, sf), vw.evidence(spark, sf)
    lost = e.select("source_id").join(s.select("source_id"), "source_id", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    one = metrics.joined_rows(s.agg(F.count(F.lit(1)).alias("sources"), F.count_if("usable").alias("usable")), e.agg(F.count(F.lit(1)).alias("evidence"), F.count_if(F.expr("quote_match = 'exact'")).alias("citable")), lost)
    col = F.col
    return metrics.problems(one, [("no sources", col("sources") > 0), ("unusable sources", col("usable") == col("sources")), ("no citable evidence", col("citable") > 0), ("evidence without a sound quote", col("citable") == col("evidence")), ("evidence without a source", col("orphans") == 0)])


@query(
    """WITH c AS (SELECT doc_id, source, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}') AS row_hash, substr(sha256('{"depth":' || doc_id % 3 || ',"model":"m' || doc_id % 2 || '"}'), 1, 12) AS fingerprint FROM documents)
    SELECT doc_id, row_hash, fingerprint, row_hash = sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || (n_chars + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END) || '}') AS unchanged FROM c JOIN documents USING (doc_id)"""
)
def fingerprints(spark, sf):
    """Hashes of rows as JSON with sorted keys, the fingerprint of settings, and whether a row still has the hash that was recorded (one in ten has changed)."""
    d = vw.table(spark, sf, "documents")
    json = lambda n: F.sha2(F.to_json(F.struct("doc_id", "lang", n.alias("n_chars"))), 256)
    now, then = json(F.col("n_chars")), json(F.col("n_chars") + F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0))
    setting = F.left(F.sha2(F.to_json(F.struct((F.col("doc_id") % 3).alias("depth"), F.concat(F.lit("m"), (F.col("doc_id") % 2).cast("string")).alias("model"))), 256), F.lit(12))
    return d.select("doc_id", now.alias("row_hash"), setting.alias("fingerprint"), (now == then).alias("unchanged"))


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(l, '^\\s*> ?\\S') THEN '> [REDACTED: ' || length(l) || ' characters]' ELSE l END || chr(10) || 'end' AS quoted, CASE WHEN text = '' THEN '' ELSE '[REDACTED: ' || length(text) || ' characters]' END AS hidden, '<<' || doc_id || '>>' AS neutral,
    NOT regexp_matches(lower(text), 'idiot|clown|moron') AS unnamed, 'D' || (doc_id + 100) AS ordinal, doc_id % 50 AS number, 'S' || doc_id % 50 || 'x' AS id FROM (SELECT *, '> ' || split_part(text, chr(10), 1) AS l FROM documents)"""
)
def text_safety(spark, sf):
    d, t = vw.table(spark, sf, "documents"), F.col("text")
    first = F.substring_index(t, "\n", 1)
    key = tx.id_order(F.concat(F.lit("S"), (F.col("doc_id") % 50).cast("string"), F.lit("x")))
    quoted = tx.without_quotes(F.concat(F.lit("> "), first, F.lit("\nend")))
    marked = tx.neutralised(F.concat(F.lit("<<<<"), F.col("doc_id").cast("string"), F.lit(">>>")))
    return d.select("doc_id", quoted.alias("quoted"), tx.redacted(t).alias("hidden"), marked.alias("neutral"), tx.names_no(t, ["clown", "idiot", "moron"]).alias("unnamed"), tx.ordinal("D", 101, F.col("doc_id")).alias("ordinal"), key["number"].alias("number"), key["id"].alias("id"))


@query(
    """SELECT doc_id, item_id, place, CAST(length(regexp_extract(text, '^[ \\t\\r\\n\\f\\x0B]*')) + length(array_to_string(list_slice(regexp_extract_all(trim(text, chr(32) || chr(9) || chr(13) || chr(10) || chr(12) || chr(11)), '[ \\t\\r\\n\\f\\x0B]+|[^ \\t\\r\\n\\f\\x0B]'), 1, place), '')) AS INT) AS "offset"
    FROM (SELECT doc_id, item_id, CAST(place AS INT) AS place, text FROM v_held JOIN documents USING (doc_id))"""
)
def original_offsets(spark, sf):
    """Where the passages that documents hold stand in the matching form, and in the documents as they are, whole texts of any length."""
    d = vw.table(spark, sf, "documents").select("doc_id", tx.for_match(F.col("text")).alias("t"))
    b = vw.table(spark, sf, "benchmark").select("item_id", tx.for_match(F.col("text")).alias("q"))
    held = vw.quote_places(spark, sf, close=False).join(d, "doc_id").join(b, "item_id")
    return held.select("doc_id", "item_id", (F.instr("t", F.col("q")) - 1).alias("place"), "offset")


@query(
    """WITH s AS (SELECT source_id, quality, doc_id, row_number() OVER (ORDER BY quality DESC, doc_id) AS place FROM v_sources WHERE usable) SELECT source_id, quality, place FROM s WHERE place <= 120"""
)
def extraction_queue(spark, sf):
    """The first 120 usable sources by quality, earlier ones first among equals. The rows are cut in every task before they meet."""
    s = vw.sources(spark, sf).where("usable").select("source_id", "quality", "doc_id").orderBy(F.col("quality").desc(), "doc_id").limit(120)
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.col("quality").desc(), "doc_id")).cast("long")).select("source_id", "quality", "place")


@query(
    """WITH c AS (SELECT canonical_url, min(seq) AS seq FROM v_results WHERE canonical_url <> '' GROUP BY 1), f AS (SELECT canonical_url, arg_max(CASE WHEN seq % 4 = 0 THEN 'blocked' ELSE 'ok' END, seq) AS outcome, count(*) AS tries FROM v_results WHERE seq % 5 <> 0 AND canonical_url <> '' GROUP BY 1),
    r AS (SELECT c.*, row_number() OVER (ORDER BY c.seq) AS place FROM c) SELECT r.canonical_url, r.place, coalesce(outcome, 'not_fetched') AS outcome, coalesce(tries, 0) AS tries, (SELECT greatest(count(*) - 120, 0) FROM c) AS left_out FROM r LEFT JOIN f USING (canonical_url) WHERE place <= 120"""
)
def candidate_manifest(spark, sf):
    """The first 120 candidates with the last outcome of fetching each, and how many were left out."""
    rows = vw.results(spark, sf).where("canonical_url <> ''")
    c = rows.groupBy("canonical_url").agg(F.min("seq").alias("seq"))
    outcome = F.when(F.col("seq") % 4 == 0, "blocked").otherwise("ok")
    f = rows.where("seq % 5 <> 0").groupBy("canonical_url").agg(F.max_by(outcome, "seq").alias("outcome"), F.count(F.lit(1)).alias("tries"))
    first = c.orderBy("seq").limit(120).withColumn("place", F.row_number().over(Window.orderBy("seq")).cast("long"))
    out = first.join(f, "canonical_url", "left").select("canonical_url", "place", F.coalesce("outcome", F.lit("not_fetched")).alias("outcome"), F.coalesce("tries", F.lit(0)).alias("tries"))
    return out.withColumn("left_out", c.agg(F.greatest(F.count(F.lit(1)) - 120, F.lit(0))).scalar())


@query(
    """WITH s AS (SELECT source_id, sub_question_id, count(*) AS k FROM v_evidence GROUP BY ALL), q AS (SELECT 'SQ' || range AS sub_question_id FROM range(5)), u AS (SELECT DISTINCT source_id FROM v_evidence)
    SELECT 'all_open' AS strategy, source_id, sub_question_id FROM u, q UNION ALL SELECT 'retrieved_only', source_id, sub_question_id FROM s"""
)
def extraction_pairs(spark, sf):
    """Sources with the sub-questions that each strategy extracts for: all five open ones, or those that found the source."""
    e = vw.evidence(spark, sf).select("source_id", "sub_question_id").distinct()
    asked = F.explode(F.array(*(F.lit(f"SQ{i}") for i in range(5))))
    every = e.select("source_id").distinct().select(F.lit("all_open").alias("strategy"), "source_id", asked.alias("sub_question_id"))
    return every.unionByName(e.select(F.lit("retrieved_only").alias("strategy"), "source_id", "sub_question_id"))


@query(
    """WITH i AS (SELECT conv_id, turn, lower(trim(text)) AS q FROM conversations WHERE turn % 2 = 0), o AS (SELECT DISTINCT q FROM i WHERE conv_id % 3 = 0)
    SELECT min(conv_id * 100 + turn) AS first, q FROM i WHERE conv_id % 3 <> 0 AND q NOT IN (SELECT q FROM o) GROUP BY q"""
)
def new_queries(spark, sf):
    """Queries that were not issued before, whatever the case of letters: the first of each."""
    i = vw.table(spark, sf, "conversations").where("turn % 2 = 0").select("conv_id", "turn", F.lower(F.trim("text")).alias("q"))
    issued = i.where("conv_id % 3 = 0").select("q").distinct()
    return i.where("conv_id % 3 <> 0").join(issued, "q", "left_anti").groupBy("q").agg(F.min(F.col("conv_id") * 100 + F.col("turn")).alias("first"))
