"""Named queries that close a run: reconciliation, selection diagnostics, discovery, review joins, roll-ups, readiness checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestor.functions import wording
from attestor.operators import answers, dedup, metrics, selection
from attestor.operators import coverage as cv
from attestor.plans.language import expected, with_cases
from attestor.plans.queries import query
from attestor.plans.verification import _VERDICTS_SQL, _verdicts
from attestor.sources import ingest
from attestor.sources import views as vw

# --- Reconciliation ----------------------------------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_VERDICTS_SQL}, o AS (SELECT count(*) AS generated, count(*) FILTER (verdict <> 'unchecked') AS checked, count(*) FILTER (verdict = 'unchecked') AS not_checked, count(*) FILTER (verdict = 'supported') AS published, count(*) FILTER (verdict = 'unsupported') AS unsupported, count(*) FILTER (verdict = 'partial') AS partly FROM v)
    SELECT *, unsupported + partly AS withheld, published + unsupported + partly = checked AS adds_up FROM o"""
)
def claim_reconciliation(spark, sf):
    """Claims by what became of them. What was withheld is the sum of its parts, so that a miscount shows."""
    n = lambda kind: F.count_if(F.col("verdict") == kind)
    o = _verdicts(spark, sf).agg(F.count(F.lit(1)).alias("generated"), F.count_if(F.col("verdict") != "unchecked").alias("checked"), n("unchecked").alias("not_checked"), n("supported").alias("published"), n("unsupported").alias("unsupported"), n("partial").alias("partly"))
    return o.withColumn("withheld", F.col("unsupported") + F.col("partly")).withColumn("adds_up", F.col("published") + F.col("withheld") == F.col("checked"))


_CASES = "c AS (SELECT doc_id, doc_id % 13 AS case_id, max(quality) = 1 AS expected, doc_id * 31 % 100 >= 35 AS published, doc_id % 4 <> 0 AS relevant, doc_id % 6 = 0 AS misselected, (doc_id * 17 % 50 + 50) / 100.0::DOUBLE AS quality FROM labels GROUP BY 1)"


@query(
    f"""WITH {_CASES} SELECT count(*) AS claims, count(*) FILTER (published) AS published, count(*) FILTER (published AND NOT relevant) AS irrelevant, count(*) FILTER (expected AND NOT published) AS wrongly_withheld, count(*) FILTER (published AND misselected) AS wrong_selection,
    round(avg(quality) FILTER (published), 4) AS mean_quality, min(quality) FILTER (published) AS least_quality, (SELECT count(*) FROM (SELECT DISTINCT case_id FROM c) WHERE case_id NOT IN (SELECT case_id FROM c WHERE published AND doc_id % 2 = 0)) AS cases_without_findings FROM c"""
)
def quality_summary(spark, sf):
    """One row over a frozen set of cases: what was published, what should not or should have been, the quality of the evidence chosen, and cases that published nothing (of even ids)."""
    d, i = vw.table(spark, sf, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("expected")), F.col("doc_id")
    c = d.select("doc_id", (i % 13).alias("case_id"), "expected", (i * 31 % 100 >= 35).alias("published"), (i % 4 != 0).alias("relevant"), (i % 6 == 0).alias("misselected"), ((i * 17 % 50 + 50) / 100.0).alias("quality"))
    p = F.col("published")
    one = c.agg(
        F.count(F.lit(1)).alias("claims"), F.count_if(p).alias("published"), F.count_if(p & ~F.col("relevant")).alias("irrelevant"), F.count_if(F.col("expected") & ~p).alias("wrongly_withheld"), F.count_if(p & F.col("misselected")).alias("wrong_selection"),
        F.round(F.avg(F.when(p, F.col("quality"))), 4).alias("mean_quality"), F.min(F.when(p, F.col("quality"))).alias("least_quality"),
    )
    empty = c.select("case_id").distinct().join(c.where("published and doc_id % 2 = 0").select("case_id").distinct(), "case_id", "left_anti").agg(F.count(F.lit(1)).alias("cases_without_findings"))
    return metrics.joined_rows(one, empty)


# --- Selection and discovery ---------------------------------------------------------------------------------------------------------------------------------

_PICKED = """c AS (SELECT canonical_url, min(seq) AS seq, max(score) AS ranking FROM v_results WHERE canonical_url <> '' GROUP BY 1), k AS (SELECT *, 'SQ' || seq % 5 AS q, seq // 30 AS run_id FROM c),
    p AS (SELECT *, row_number() OVER (PARTITION BY run_id, q ORDER BY ranking DESC, canonical_url DESC) AS n FROM k), f AS (SELECT run_id, canonical_url, q FROM p WHERE n = 1), g AS (SELECT run_id, q, row_number() OVER (PARTITION BY run_id ORDER BY q) AS i FROM f), a AS (SELECT run_id, canonical_url, q FROM f JOIN g USING (run_id, q) WHERE i <= 3)"""


def _candidates(spark, sf):
    c = vw.results(spark, sf).where("canonical_url <> ''").groupBy("canonical_url").agg(F.min("seq").alias("seq"), F.max("score").alias("ranking"))
    return c.select(F.floor(F.col("seq") / 30).alias("run_id"), "canonical_url", "ranking", F.array(F.concat(F.lit("SQ"), (F.col("seq") % 5).cast("string"))).alias("sub_questions"))


@query(f"WITH {_PICKED}, m AS (SELECT run_id, count(*) AS have FROM a GROUP BY 1), r AS (SELECT run_id, q, canonical_url, ranking FROM p WHERE (run_id, canonical_url) NOT IN (SELECT run_id, canonical_url FROM a) AND n > 0), x AS (SELECT r.*, row_number() OVER (PARTITION BY run_id ORDER BY ranking DESC, canonical_url DESC) AS n2 FROM r), s AS (SELECT run_id, q FROM a UNION SELECT x.run_id, q FROM x JOIN m USING (run_id) WHERE n2 <= 3 - have) SELECT run_id, 'SQ' || i AS sub_question_id FROM (SELECT DISTINCT run_id FROM k), (SELECT unnest(range(5)) AS i) WHERE (run_id, 'SQ' || i) NOT IN (SELECT run_id, q FROM s)")
def starved_questions(spark, sf):
    """Sub-questions of a run for which none of three picks was made."""
    c = _candidates(spark, sf)
    asked = c.select("run_id").distinct().select("run_id", F.explode(F.array(*(F.lit(f"SQ{i}") for i in range(5)))).alias("sub_question_id"))
    return selection.starved(c, selection.allocate(c, 3), asked)


@query(
    """WITH f AS (SELECT canonical_url, sub_question_id, arg_min(query_id, seq) AS query_id, min(seq) AS seq FROM v_results WHERE sub_question_id <> '' AND canonical_url <> '' GROUP BY ALL) SELECT canonical_url, sub_question_id, query_id, seq = min(seq) OVER (PARTITION BY canonical_url) AS is_first FROM f"""
)
def discovery_paths(spark, sf):
    """The query that found a page first for each of its sub-questions, and which of these was the very first."""
    r = vw.results(spark, sf).where("sub_question_id <> '' and canonical_url <> ''")
    f = r.groupBy("canonical_url", "sub_question_id").agg(F.min_by("query_id", "seq").alias("query_id"), F.min("seq").alias("seq"))
    return f.select("canonical_url", "sub_question_id", "query_id", (F.col("seq") == F.min("seq").over(Window.partitionBy("canonical_url"))).alias("is_first"))


@query(
    """WITH u AS (SELECT * FROM v_sources WHERE usable), d AS (SELECT arg_min(source_id, doc_id) AS source_id FROM u GROUP BY content_hash), o AS (SELECT 'SQ' || i AS sub_question_id FROM (SELECT unnest(range(5)) AS i) WHERE i NOT IN (1, 3))
    SELECT source_id, sub_question_id FROM d JOIN v_sources USING (source_id), o WHERE doc_id % 2 = 0 AND (source_id, sub_question_id) NOT IN (SELECT source_id, sub_question_id FROM v_evidence)"""
)
def pending_extractions(spark, sf):
    """Usable sources, no duplicates, that were found (even ids) with the open sub-questions for which nothing was taken from them yet. Open questions are three."""
    s = vw.sources(spark, sf)
    fit = s.where("usable and doc_id % 2 = 0").select("source_id").join(dedup.by_content(s).where("duplicate_of is null").select("source_id"), "source_id")
    pairs = fit.select("source_id", F.explode(F.array(*(F.lit(f"SQ{i}") for i in (0, 2, 4)))).alias("sub_question_id"))
    return pairs.join(vw.evidence(spark, sf).select("source_id", "sub_question_id").distinct(), ["source_id", "sub_question_id"], "left_anti")


@query("SELECT evidence_id, confidence, place FROM (SELECT evidence_id, round(relevance, 3) AS confidence, row_number() OVER (ORDER BY round(relevance, 3) DESC, evidence_id) AS place FROM v_evidence WHERE quote_match = 'exact') WHERE place <= 12")
def fallback_evidence(spark, sf):
    """The twelve most certain citable quotes, for a report without claims."""
    e = vw.evidence(spark, sf).where("quote_match = 'exact'").select("evidence_id", F.round("relevance", 3).alias("confidence")).orderBy(F.col("confidence").desc(), "evidence_id").limit(12)
    return e.withColumn("place", F.row_number().over(Window.orderBy(F.col("confidence").desc(), "evidence_id")).cast("long"))


# --- Reviews -------------------------------------------------------------------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT o_orderkey AS run, substr(sha256('a|' || o_orderkey), 1, 16) AS random_id FROM orders), s AS (SELECT random_id, run % 5 + 1 AS score FROM r WHERE run % 19 <> 0), k AS (SELECT random_id, run FROM r WHERE run % 23 <> 0), o AS (SELECT run, run % 3 AS arm FROM r WHERE run % 29 <> 0)
    SELECT coalesce(s.random_id, k.random_id) AS random_id, o.run, o.arm, s.score, CASE WHEN s.random_id IS NULL THEN 'not reviewed' WHEN k.random_id IS NULL THEN 'no key' WHEN o.run IS NULL THEN 'no run' END AS fault FROM s FULL JOIN k ON s.random_id = k.random_id LEFT JOIN o ON k.run = o.run"""
)
def review_joins(spark, sf):
    """Reviews, unblinded by the key, with their runs. What lacks on one side stays, with its fault."""
    r = metrics.blinded_order(vw.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run")), ["run"], "a")
    s = r.where("run % 19 <> 0").select("random_id", (F.col("run") % 5 + 1).alias("score"))
    k = r.where("run % 23 <> 0").select("random_id", F.col("run").alias("k"))
    o = r.where("run % 29 <> 0").select("run", (F.col("run") % 3).alias("arm"))
    met = s.join(k, "random_id", "full").join(o, F.col("k") == F.col("run"), "left")
    fault = F.when(F.col("score").isNull(), "not reviewed").when(F.col("k").isNull(), "no key").when(F.col("run").isNull(), "no run")
    return met.select("random_id", "run", "arm", "score", fault.alias("fault"))


@query(
    """WITH l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY 1) SELECT doc_id, q = t AS agree, CASE WHEN q = t THEN 'settled' WHEN doc_id % 10 = 0 THEN 'third reader' ELSE 'discuss' END AS next FROM l"""
)
def second_opinions(spark, sf):
    """Two opinions on a case (its two labels): whether they agree, and what comes next."""
    two = vw.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    return two.select("doc_id", (F.col("q") == F.col("t")).alias("agree"), F.when(F.col("q") == F.col("t"), "settled").when(F.col("doc_id") % 10 == 0, "third reader").otherwise("discuss").alias("next"))


# --- Roll-ups and checks ---------------------------------------------------------------------------------------------------------------------------------------


@query(
    """SELECT (SELECT count(*) FROM v_sources) AS sources, (SELECT count(*) FROM v_sources WHERE usable) AS usable, (SELECT CAST(sum(word_count) AS BIGINT) FROM v_sources) AS words, (SELECT count(*) FROM v_evidence) AS evidence, (SELECT count(*) FROM v_evidence WHERE quote_match = 'exact') AS exact_quotes,
    (SELECT count(*) FROM v_claims) AS claims, (SELECT count(*) FROM v_claims WHERE kind = 'substantive') AS substantive, (SELECT count(*) FROM v_results) AS search_results, (SELECT count(*) FROM v_attempts) AS requests, (SELECT count(*) FROM v_attempts WHERE status = 'ok') AS answered, (SELECT count(*) FROM v_runs WHERE ok) AS good_runs"""
)
def run_rollup(spark, sf):
    """One row of the sizes of a run."""
    n = F.count(F.lit(1))
    return metrics.joined_rows(
        vw.sources(spark, sf).agg(n.alias("sources"), F.count_if("usable").alias("usable"), F.sum("word_count").alias("words")), vw.evidence(spark, sf).agg(n.alias("evidence"), F.count_if(F.expr("quote_match = 'exact'")).alias("exact_quotes")),
        vw.claim_texts(spark, sf).agg(n.alias("claims"), F.count_if(F.expr("kind = 'substantive'")).alias("substantive")), vw.results(spark, sf).agg(n.alias("search_results")), vw.attempts(spark, sf).agg(n.alias("requests"), F.count_if(F.expr("status = 'ok'")).alias("answered")), vw.runs(spark, sf).agg(F.count_if("ok").alias("good_runs")),
    )


@query(
    """WITH q AS (SELECT 'SQ' || range AS id FROM range(7)), c AS (SELECT sub_question_id AS id, count(DISTINCT source_id) FILTER (quote_match = 'exact' AND relevance >= 0.3) AS s, count(*) FILTER (quote_match = 'exact' AND relevance >= 0.3) AS f FROM v_evidence GROUP BY 1), g AS (SELECT id FROM q LEFT JOIN c USING (id) WHERE NOT (coalesce(s, 0) >= 2 AND coalesce(f, 0) >= 2))
    SELECT id AS sub_question_id, 'Not covered: ' || id AS line FROM g WHERE id IN ('SQ0', 'SQ3', 'SQ5', 'SQ6')"""
)
def coverage_limitations(spark, sf):
    """Lines on sub-questions that are not covered, for those that the plan has (others are dropped): five at most."""
    asked = spark.range(7).select(F.concat(F.lit("SQ"), F.col("id").cast("string")).alias("sub_question_id"))
    open_ = cv.coverage(vw.evidence(spark, sf), asked, F.col("relevance") >= 0.3).where("verdict <> 'covered'").select("sub_question_id")
    planned = spark.createDataFrame([(f"SQ{i}",) for i in (0, 3, 5, 6, 9)], "sub_question_id string")
    return open_.join(planned, "sub_question_id").orderBy("sub_question_id").limit(5).select("sub_question_id", F.concat(F.lit("Not covered: "), "sub_question_id").alias("line"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, user_id FROM events QUALIFY place <= 20")
def logical_calls(spark, sf):
    """The first twenty calls of each user; the rows are cut before they meet."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return vw.table(spark, sf, "events").select("event_id", "user_id", F.row_number().over(w).cast("long").alias("place")).where("place <= 20").select("event_id", "place", "user_id")


# labels of a model in its order, two probe scores; position of entailment and contradiction, ready
READY_CASES = [
    (["CONTRADICTION", "neutral", "Entailment"], 0.99, 0.97, 2, 0, True), (["entail_yes", "neutr", "contra_x"], 0.99, 0.5, 0, 2, False), (["LABEL_0", "LABEL_1", "LABEL_2"], 0.99, 0.99, None, None, False), (["neutral", "entailment", "contradiction"], 0.4, 0.99, 1, 2, False),
]


@query(expected([c[3:] for c in READY_CASES], "entailment, contradiction, ready"))
def scorer_readiness(spark, sf):
    """Where a model's labels stand, read by how they begin, and whether it passes its two probes."""
    rows = with_cases(spark, sf, [c[:3] for c in READY_CASES], "labels array<string>, sure double, opposed double")
    at = lambda start: F.nullif(F.array_position(F.transform("labels", lambda x: F.lower(x).startswith(start)), F.lit(True)).cast("int"), F.lit(0)) - 1
    ready = at("entail").isNotNull() & at("contra").isNotNull() & (F.col("sure") >= 0.9) & (F.col("opposed") >= 0.9)
    return rows.select("conv_id", "turn", at("entail").alias("entailment"), at("contra").alias("contradiction"), ready.alias("ready"))


# type, slot; core (or unknown), may discharge a core slot
ROLE_CASES = [("comparison", "direct_contrast", True, True), ("comparison", "relationship", False, True), ("comparison", "dimension", False, False), ("definition", "distinguishing_property", False, False), ("definition", "steps", True, True), ("list", "", True, True), ("causal", "causal_evidence", True, True), ("causal", "effect_direction", False, False)]


@query(expected([c[2:] for c in ROLE_CASES], "decisive, discharges"))
def slot_roles(spark, sf):
    """Whether a judge may withhold a claim of a slot: one the answer turns on, an unknown one, none; and whether a claim of it can discharge a core slot."""
    rows = with_cases(spark, sf, [c[:2] for c in ROLE_CASES], "kind string, slot string")
    known = F.create_map(*(x for k, own in answers.SLOTS.items() for x in (F.lit(k), F.array(*(F.lit(s) for s, _ in own)))))[F.col("kind")]
    core = F.create_map(*(x for k, own in answers.SLOTS.items() for x in (F.lit(k), F.array(*(F.lit(s) for s, c in own if c)))))[F.col("kind")]
    decisive = (F.col("slot") == "") | ~F.array_contains(known, F.col("slot")) | F.array_contains(core, F.col("slot"))
    return rows.select("conv_id", "turn", decisive.alias("decisive"), (decisive | ((F.col("kind") == "comparison") & (F.col("slot") == "relationship"))).alias("discharges"))


# question, entities; subjects to span, context
SPAN_CASES = [("Kafka vs Redis for {z}", ["Apache Kafka", "redis", "{z}"], ["Apache Kafka", "redis"], ["{z}"]), ("What is {z}?", ["{z}", "Kafka"], ["{z}", "Kafka"], []), ("Kafka vs Redis", [], ["Kafka", "Redis"], [])]


@query(expected([c[2:] for c in SPAN_CASES], "subjects, context"))
def answer_subjects(spark, sf):
    """The subjects an answer must span, the sides of a comparison or else the entities, and the entities that are only its setting."""
    rows = with_cases(spark, sf, [c[:2] for c in SPAN_CASES], "question string, entities array<string>").withColumn("sides", wording.comparison_sides("question"))
    named = wording.reconciled_sides(F.col("sides"), F.col("entities"))
    subjects = F.when(F.size("sides") >= 2, named).otherwise(wording.distinct_by_case(F.col("entities")))
    low = F.transform(subjects, lambda s: F.lower(s))
    return rows.select("conv_id", "turn", subjects.alias("subjects"), F.filter("entities", lambda e: ~F.array_contains(low, F.lower(e))).alias("context"))


@query("SELECT conv_id, bool_or(role = 'assistant' AND turn % 4 = 1) AS verified, max(turn) >= 5 AS timed_out, NOT (max(turn) >= 5 AND NOT bool_or(role = 'assistant' AND turn % 4 = 1)) AS shown FROM conversations GROUP BY 1")
def deadline_reports(spark, sf):
    """Runs whose time ran out (six turns and more) show a report only if it was verified."""
    c = vw.table(spark, sf, "conversations").groupBy("conv_id").agg(F.bool_or((F.col("role") == "assistant") & (F.col("turn") % 4 == 1)).alias("verified"), (F.max("turn") >= 5).alias("timed_out"))
    return c.withColumn("shown", ~(F.col("timed_out") & ~F.col("verified")))


# --- Records, pages, links ---------------------------------------------------------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM conversations),
    a AS (SELECT conv_id, count(*) AS pages, count(*) FILTER (i <= 3 AND o + n <= 900) AS kept, CAST(coalesce(sum(n) FILTER (i <= 3 AND o + n <= 900), 0) AS BIGINT) AS chars FROM p GROUP BY 1) SELECT *, kept < pages AS cut, chars < 40 * least(pages, 3) AS scanned FROM a"""
)
def page_summaries(spark, sf):
    """Conversations as documents whose turns are pages: three pages and 900 characters are kept at most."""
    return ingest.page_summaries(vw.table(spark, sf, "conversations"), "conv_id", "turn", "text", 3, 900)


@query(
    f"""WITH {_VERDICTS_SQL} SELECT v.claim_id, c.kind, len(c.evidence_ids) AS cited, v.verdict, v.best_evidence, v.reason, CASE WHEN v.entailment IS NULL THEN 'not scored' WHEN v.entailment < 0.98 THEN 'below 0.98 (' || printf('%.4f', floor(v.entailment * 10000 + 0.0000001::DOUBLE) / 10000) || ')' ELSE 'at or over 0.98' END AS shown,
    substr(sha256(c.text || '|' || array_to_string(c.evidence_ids, ',')), 1, 12) AS claim_key FROM v JOIN v_claims c USING (claim_id)"""
)
def claim_judgments(spark, sf):
    """The record of each judged claim: its key, what it cites, verdict, reason, and its score shown so that one under the threshold never reads as at it."""
    claims, evidence = vw.cited(spark, sf)
    c = claims.select("claim_id", "kind", F.size("evidence_ids").cast("long").alias("cited"), F.left(F.sha2(F.concat("text", F.lit("|"), F.array_join("evidence_ids", ",")), 256), F.lit(12)).alias("claim_key"))
    floor = F.format_string("%.4f", F.floor(F.col("entailment") * 10000 + 1e-7) / 10000)
    shown = F.when(F.col("entailment").isNull(), "not scored").when(F.col("entailment") < 0.98, F.concat(F.lit("below 0.98 ("), floor, F.lit(")"))).otherwise("at or over 0.98")
    return _verdicts(spark, sf, claims, evidence).join(c, "claim_id").select("claim_id", "kind", "cited", "verdict", "best_evidence", "reason", shown.alias("shown"), "claim_key")


@query(
    """WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="(/[^"#?]*)', 1))) AS target FROM pages), k AS (SELECT DISTINCT regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS target FROM pages) SELECT page_id, target FROM l WHERE target NOT IN (SELECT target FROM k)"""
)
def broken_links(spark, sf):
    """Links inside pages to paths that no page has."""
    p = vw.table(spark, sf, "pages")
    links = p.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[^"#?]*)'), 1))).alias("target"))
    known = p.select(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("target")).distinct()
    return links.join(known, "target", "left_anti").select("page_id", "target")


@query(f"WITH {_PICKED}, m AS (SELECT run_id, count(*) AS have FROM a GROUP BY 1), x AS (SELECT p.*, row_number() OVER (PARTITION BY run_id ORDER BY ranking DESC, canonical_url DESC) AS n2 FROM p WHERE (run_id, canonical_url) NOT IN (SELECT run_id, canonical_url FROM a)) SELECT x.run_id, x.canonical_url, CASE WHEN x.ranking < 0.3 THEN 'low score' ELSE 'limit reached' END AS reason FROM x JOIN m USING (run_id) WHERE n2 > 3 - have")
def dropped_candidates(spark, sf):
    """Candidates that were not among the three picks of their run, and why."""
    c = _candidates(spark, sf)
    return c.join(selection.allocate(c, 3).select("run_id", "canonical_url"), ["run_id", "canonical_url"], "left_anti").select("run_id", "canonical_url", F.when(F.col("ranking") < 0.3, "low score").otherwise("limit reached").alias("reason"))
