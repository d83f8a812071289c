"""Named queries of the verification gate and its metrics, and joins around it."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import lexicon as lx
from attestor.functions import text as tx
from attestor.operators import coverage as cv
from attestor.operators import gate, measure
from attestor.operators import resolve as rs
from attestor.plans.queries import _RESOLVED, _TERMS, query
from attestor.sources import views as vw


def _scores(pairs):
    c, s = F.col("claim_id"), F.length("evidence_id")
    e = ((c * 37 + s * 11) % 100) / 100.0
    e = F.when(e >= 0.9, 0.99).otherwise(e)
    rest = F.lit(1) - e
    scored = pairs.where((c + s) % 13 != 0)
    return scored.select("claim_id", "evidence_id", e.alias("entailment"), (rest * 0.25).alias("neutral"), (rest * F.when(c % 17 == 0, 0.5).otherwise(0.75)).alias("contradiction"), (c % 5 != 0).alias("guards_passed"), ((c + s) % 19 == 0).alias("truncated"))


_PAIRS_SQL = """k AS (SELECT DISTINCT claim_id, unnest(evidence_ids) AS evidence_id FROM v_claims WHERE kind = 'substantive'), p AS (SELECT k.*, e.source_id FROM k JOIN v_evidence e USING (evidence_id) WHERE quote_match = 'exact')"""
_VERDICTS_SQL = f"""{_PAIRS_SQL},
    s0 AS (SELECT *, CASE WHEN ((claim_id * 37 + length(evidence_id) * 11) % 100) / 100.0::DOUBLE >= 0.9::DOUBLE THEN 0.99::DOUBLE ELSE ((claim_id * 37 + length(evidence_id) * 11) % 100) / 100.0::DOUBLE END AS en FROM p),
    s AS (SELECT s0.*, (claim_id + length(evidence_id)) % 13 <> 0 AS has, (1 - en) * 0.25::DOUBLE AS ne, (1 - en) * CASE WHEN claim_id % 17 = 0 THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END AS co, claim_id % 5 <> 0 AND NOT (claim_id + length(evidence_id)) % 19 = 0 AS g, quality FROM s0 LEFT JOIN v_sources USING (source_id)),
    f AS (SELECT *, has AND abs(en + ne + co - 1) <= 0.02 AS valid FROM s),
    a AS (SELECT claim_id, arg_max(evidence_id, {{'q': coalesce(quality, 0), 'e': en, 'i': evidence_id}}) FILTER (valid AND g AND en >= 0.98) AS best_evidence, max(en) FILTER (valid) AS entailment, max(co) FILTER (valid) AS contradiction,
      count(*) FILTER (valid AND g AND en >= 0.98) AS supporting, count(*) FILTER (valid) AS scored, count(*) FILTER (valid AND en >= 0.98 AND NOT g) AS guarded, count(*) AS quotes FROM f GROUP BY 1),
    v AS (SELECT c.claim_id, CASE WHEN supporting > 0 THEN 'supported' WHEN coalesce(scored, 0) = 0 THEN 'unchecked' WHEN entailment >= 0.5 THEN 'partial' ELSE 'unsupported' END AS verdict, best_evidence, round(entailment, 4) AS entailment, coalesce(quotes, 0) AS quotes, coalesce(supporting, 0) AS supporting,
      CASE WHEN supporting > 0 THEN '' WHEN coalesce(quotes, 0) = 0 THEN 'no sound quote' WHEN scored = 0 THEN 'no valid score' WHEN guarded > 0 THEN 'guard failed' ELSE 'below threshold' END AS reason,
      CASE WHEN contradiction >= 0.5 THEN 'contradicted' WHEN entailment < 0.05 THEN 'unrelated' ELSE '' END AS diagnosis FROM v_claims c LEFT JOIN a USING (claim_id) WHERE kind = 'substantive')"""


def _verdicts(spark, sf, claims=None, evidence=None):
    if claims is None or evidence is None:
        claims, evidence = vw.cited(spark, sf)
    pairs = gate.scoring_pairs(claims, evidence)
    ranks = vw.sources(spark, sf).select("source_id", F.lit(0).alias("rank"), "quality")
    return gate.verdicts(claims, pairs, _scores(pairs), ranks)


@query(f"WITH {_PAIRS_SQL} SELECT claim_id, evidence_id, source_id FROM p")
def scoring_pairs(spark, sf):
    return gate.scoring_pairs(*vw.cited(spark, sf)).select("claim_id", "evidence_id", "source_id")


@query(f"WITH {_VERDICTS_SQL} SELECT * FROM v")
def claim_verdicts(spark, sf):
    return _verdicts(spark, sf)


@query(f"WITH {_VERDICTS_SQL} SELECT verdict, reason, count(*) AS claims, round(count(*) / (SELECT count(*) FROM v), 4) AS share FROM v GROUP BY ALL")
def support_breakdown(spark, sf):
    v = _verdicts(spark, sf)
    total = v.agg(F.count(F.lit(1))).scalar()
    return v.groupBy("verdict", "reason").agg(F.count(F.lit(1)).alias("claims")).withColumn("share", F.round(F.col("claims") / total, 4))


@query(
    f"""WITH {_VERDICTS_SQL}, d AS (SELECT conv_id % 11 AS contradiction_id, conv_id // 50 % 2 AS side, max(CASE WHEN v.verdict = 'supported' THEN 1 ELSE 0 END) AS ok FROM v_claims c LEFT JOIN v USING (claim_id) GROUP BY ALL),
    b AS (SELECT contradiction_id, count(*) >= 2 AND sum(ok) = count(*) AS sound FROM d GROUP BY 1) SELECT * FROM b"""
)
def sound_contradictions(spark, sf):
    """Whether both sides of a disagreement, each with the claims of several conversations, have a supported one."""
    claims = vw.claim_texts(spark, sf)
    sides = claims.select((F.col("conv_id") % 11).alias("contradiction_id"), (F.floor(F.col("conv_id") / 50) % 2).alias("side"), "claim_id")
    sound = gate.both_sides(sides, _verdicts(spark, sf)).withColumn("s", F.lit(True))
    return sides.select("contradiction_id").distinct().join(sound, "contradiction_id", "left").select("contradiction_id", F.coalesce("s", F.lit(False)).alias("sound"))


@query(
    f"""WITH {_RESOLVED}, a AS (SELECT sum(cited) AS c, sum(sound) AS s, count(*) FILTER (kind <> 'framing') AS b, count(*) FILTER (kind <> 'framing' AND sound > 0) AS o FROM n JOIN v_claims USING (claim_id)),
    m AS (SELECT 'citation_integrity' AS name, coalesce(round(s / nullif(c, 0), 4), 1.0::DOUBLE) AS value, true AS higher_is_better FROM a UNION ALL SELECT 'citation_coverage', round(o / nullif(b, 0), 4), true FROM a
      UNION ALL SELECT 'source_concentration', (SELECT round(max(k) FILTER (domain <> '') / sum(k), 4) FROM (SELECT domain, count(*) AS k FROM v_sources GROUP BY 1)), false)
    SELECT name, value, higher_is_better, CASE WHEN value IS NULL THEN 'n/a' WHEN value BETWEEN 0 AND 1 THEN printf('%.0f', value * 100) || '%' ELSE printf('%.2f', value) END AS shown FROM m"""
)
def run_metrics(spark, sf):
    one = rs.integrity(*vw.cited(spark, sf)).withColumn("concentration", cv.domain_concentration(vw.sources(spark, sf)).select("concentration").scalar())
    return gate.metric_rows(one, [("citation_integrity", "citation_integrity", True), ("citation_coverage", "citation_coverage", True), ("source_concentration", "concentration", False)])


@query(
    f"""WITH d AS (SELECT doc_id, {_TERMS("text")} AS t FROM documents), b AS (SELECT item_id, {_TERMS("text")} AS t FROM benchmark), x AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM d), y AS (SELECT item_id, len(t) AS n, unnest(t) AS w FROM b),
    j AS (SELECT doc_id AS source_id, item_id AS question_id, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) AS similarity FROM x JOIN y USING (w) GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY similarity DESC, question_id) AS INT) AS place FROM j) SELECT * FROM r WHERE place <= 2"""
)
def adjacent_questions(spark, sf):
    s = vw.table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), lx.salient_terms(F.col("text")).alias("terms"))
    q = vw.table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), lx.salient_terms(F.col("text")).alias("terms"))
    return gate.adjacent(s, q, 2)


@query(
    """SELECT DISTINCT conv_id AS question_id, CASE WHEN conv_id % 7 = 0 THEN 'never queried' WHEN conv_id % 5 = 0 THEN 'no results' WHEN conv_id % 3 = 0 THEN 'no page fetched' ELSE 'nothing extracted' END AS cause FROM conversations"""
)
def gap_causes(spark, sf):
    q = vw.table(spark, sf, "conversations").select(F.col("conv_id").alias("question_id"))
    return gate.gap_causes(q.distinct(), q.where("question_id % 7 <> 0"), q.where("question_id % 5 <> 0"), q.where("question_id % 3 <> 0"))


@query(
    """WITH a AS (SELECT DISTINCT question_id, repetition FROM v_runs WHERE arm = 'cloud' AND repetition % 7 <> 0), b AS (SELECT DISTINCT question_id, repetition FROM v_runs WHERE arm = 'local' AND repetition % 11 <> 0)
    SELECT coalesce(a.question_id, b.question_id) AS question_id, coalesce(a.repetition, b.repetition) AS repetition, a.question_id IS NOT NULL AS in_cloud, b.question_id IS NOT NULL AS in_local FROM a FULL JOIN b ON a.question_id = b.question_id AND a.repetition = b.repetition WHERE a.question_id IS NULL OR b.question_id IS NULL"""
)
def unmatched_keys(spark, sf):
    """Keys that only one arm has; the cloud arm was not run for every 7th repetition, the local one not for every 11th."""
    r = vw.runs(spark, sf).where(F.col("repetition") % F.when(F.col("arm") == "cloud", 7).otherwise(11) != 0)
    side = lambda arm, name: r.where(F.col("arm") == arm).select("question_id", "repetition").distinct().withColumn(name, F.lit(True))
    out = side("cloud", "in_cloud").join(side("local", "in_local"), ["question_id", "repetition"], "full").fillna(False, ["in_cloud", "in_local"])
    return out.where("not (in_cloud and in_local)")


@query(
    f"""WITH t AS (SELECT doc_id, {vw.spaced_sql("text")} AS t FROM documents), c AS (SELECT doc_id, t, substr(t, 1, 80) AS h FROM t)
    SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE CASE WHEN regexp_extract(h, '^(.*)[ \\n]', 1) = '' THEN h ELSE rtrim(regexp_extract(h, '^(.*)[ \\n]', 1)) END || '…' END AS clipped,
    CASE WHEN length(t) <= 120 THEN length(t) WHEN instr(reverse(substr(t, 1, 120)), ' .') > 0 AND 120 - instr(reverse(substr(t, 1, 120)), ' .') > 72 THEN 120 - instr(reverse(substr(t, 1, 120)), ' .') ELSE length(rtrim(substr(t, 1, 120))) END AS cut FROM c"""
)
def text_cuts(spark, sf):
    t = tx.one_spaced(F.col("text"))
    return vw.table(spark, sf, "documents").select("doc_id", tx.clipped(t, 80).alias("clipped"), F.length(tx.truncated(t, 120)).cast("long").alias("cut"))


@query("SELECT quote_match, stance, count(*) AS items, round(avg(relevance), 4) AS relevance, round(avg(round(relevance * CASE quote_match WHEN 'exact' THEN 1.0::DOUBLE WHEN 'fuzzy' THEN 0.4::DOUBLE ELSE 0.15::DOUBLE END, 3)), 4) AS confidence FROM v_evidence GROUP BY ALL")
def quote_fidelity(spark, sf):
    factor = F.when(F.col("quote_match") == "exact", 1.0).when(F.col("quote_match") == "fuzzy", 0.4).otherwise(0.15)
    rows = vw.evidence(spark, sf).withColumn("c", measure.rounded(F.col("relevance") * factor, 3))
    return rows.groupBy("quote_match", "stance").agg(F.count(F.lit(1)).alias("items"), measure.rounded(F.avg("relevance"), 4).alias("relevance"), measure.rounded(F.avg("c"), 4).alias("confidence"))
