"""The verification gate: claims against scored quotes. Closed by default: what has no score, no sound quote or a failed guard isn't supported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import matching, wording
from attestor.operators.resolve import cited

#: Entailment from which a quote supports a claim, and the two marks of the diagnosis.
SUPPORT, CONTRADICTED, UNRELATED = 0.98, 0.5, 0.05


def scoring_pairs(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id, evidence_id, source_id of each sound quote that a substantive claim cites."""
    e = evidence.where("quote_match = 'exact'").select("evidence_id", "source_id")
    return cited(claims.where("kind = 'substantive'")).select("claim_id", "evidence_id").distinct().join(e, "evidence_id")


def is_distribution(entailment: Column, neutral: Column, contradiction: Column) -> Column:
    """Finite, each in [0, 1], together 1 up to 0.02."""
    ok = F.abs(entailment + neutral + contradiction - 1) <= 0.02
    for p in (entailment, neutral, contradiction):
        ok = ok & p.between(0, 1) & ~F.isnan(p)
    return F.coalesce(ok, F.lit(False))


def verdicts(claims: DataFrame, pairs: DataFrame, scores: DataFrame, ranks: DataFrame, threshold: float = SUPPORT) -> DataFrame:
    """One row a substantive claim: verdict, the best supporting quote, the highest entailment, reason and diagnosis.

    scores: claim_id, evidence_id, entailment, neutral, contradiction, guards_passed, truncated. ranks: source_id, rank, quality. A quote supports when its score is a distribution at or over the
    threshold, all guards passed and nothing was cut; the best is that of the highest rank, quality, entailment and id.
    """
    valid = is_distribution(F.col("entailment"), F.col("neutral"), F.col("contradiction"))
    guards = F.coalesce(F.col("guards_passed") & ~F.col("truncated"), F.lit(False))
    rows = pairs.join(scores, ["claim_id", "evidence_id"], "left").join(ranks, "source_id", "left")
    rows = rows.withColumn("_valid", valid).withColumn("_guards", guards).withColumn("_supports", valid & guards & F.coalesce(F.col("entailment") >= threshold, F.lit(False)))
    order = F.struct(F.coalesce("rank", F.lit(0)).alias("r"), F.coalesce("quality", F.lit(0.0)).alias("q"), F.col("entailment").alias("e"), F.col("evidence_id").alias("i"))
    per = rows.groupBy("claim_id").agg(
        F.max_by("evidence_id", F.when(F.col("_supports"), order)).alias("best_evidence"), F.max(F.when(F.col("_valid"), F.col("entailment"))).alias("entailment"), F.max(F.when(F.col("_valid"), F.col("contradiction"))).alias("contradiction"),
        F.count_if("_supports").alias("supporting"), F.count_if("_valid").alias("scored"), F.count_if(F.col("_valid") & (F.col("entailment") >= threshold) & ~F.col("_guards")).alias("guarded"), F.count(F.lit(1)).alias("quotes"),
    )
    out = claims.where("kind = 'substantive'").select("claim_id").join(per, "claim_id", "left").fillna(0, ["supporting", "scored", "guarded", "quotes"])
    verdict = F.when(F.col("supporting") > 0, "supported").when(F.col("scored") == 0, "unchecked").when(F.col("entailment") >= 0.5, "partial").otherwise("unsupported")
    reason = F.when(F.col("supporting") > 0, "").when(F.col("quotes") == 0, "no sound quote").when(F.col("scored") == 0, "no valid score").when(F.col("guarded") > 0, "guard failed").otherwise("below threshold")
    diagnosis = F.when(F.col("contradiction") >= CONTRADICTED, "contradicted").when(F.col("entailment") < UNRELATED, "unrelated").otherwise("")
    return out.select("claim_id", verdict.alias("verdict"), "best_evidence", F.round("entailment", 4).alias("entailment"), "quotes", "supporting", reason.alias("reason"), diagnosis.alias("diagnosis"))


def both_sides(contradictions: DataFrame, verdicts_: DataFrame) -> DataFrame:
    """contradiction_id of those (contradiction_id, side, claim_id) whose every side has a supported claim."""
    v = verdicts_.select("claim_id", (F.col("verdict") == "supported").alias("ok"))
    sides = contradictions.join(v, "claim_id", "left").groupBy("contradiction_id", "side").agg(F.max(F.coalesce(F.col("ok"), F.lit(False)).cast("int")).alias("ok"))
    return sides.groupBy("contradiction_id").agg(F.count(F.lit(1)).alias("sides"), F.sum("ok").alias("sound")).where("sides >= 2 and sound = sides").select("contradiction_id")


def metric_rows(one: DataFrame, metrics: list[tuple[str, str, bool]]) -> DataFrame:
    """A one-row table of values as rows name, value, higher_is_better, shown: percent within [0, 1], else two digits, n/a for null."""
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value"), F.lit(h).alias("higher_is_better")) for n, c, h in metrics))).alias("m")).select("m.*")
    shown = F.when(F.col("value").isNull(), "n/a").when(F.col("value").between(0, 1), F.concat(F.format_string("%.0f", F.col("value") * 100), F.lit("%"))).otherwise(F.format_string("%.2f", "value"))
    return rows.withColumn("shown", shown)


def adjacent(sources: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The k questions closest to each source by Jaccard similarity of their terms, over those that share a term: source_id, question_id, similarity, place. Both: id, terms array. Terms are joined, not pairs of rows."""
    s = sources.select("source_id", F.size("terms").alias("n_s"), F.explode("terms").alias("term"))
    q = questions.select("question_id", F.size("terms").alias("n_q"), F.explode("terms").alias("term"))
    shared = s.join(q, "term").groupBy("source_id", "question_id", "n_s", "n_q").agg(F.count(F.lit(1)).alias("both"))
    scored = shared.withColumn("similarity", F.round(F.col("both") / (F.col("n_s") + F.col("n_q") - F.col("both")), 6))
    w = Window.partitionBy("source_id").orderBy(F.col("similarity").desc(), "question_id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("source_id", "question_id", "similarity", "place")


def gap_causes(questions: DataFrame, queried: DataFrame, results: DataFrame, fetched: DataFrame) -> DataFrame:
    """Why a question has no evidence: the first that fits of no query, no result, no fetched page, nothing extracted. Each table but the first holds question_id, repeats allowed."""
    out = questions.select("question_id")
    for name, table in (("q", queried), ("r", results), ("f", fetched)):
        out = out.join(table.select("question_id").distinct().withColumn(name, F.lit(True)), "question_id", "left")
    cause = F.when(F.col("q").isNull(), "never queried").when(F.col("r").isNull(), "no results").when(F.col("f").isNull(), "no page fetched").otherwise("nothing extracted")
    return out.select("question_id", cause.alias("cause"))


def verify(claims: DataFrame, quotes: DataFrame, scores: DataFrame, threshold: float = SUPPORT) -> DataFrame:
    """The whole gate for claims (claim_id, text): claim_id, parts, supported_parts, supported, best_quote, failed (names of guards that refused a quote scored high enough), reason.

    A claim is parted into its propositions; each must be supported by a quote of its own: one that entails it at the threshold and whose guards all pass on that part. quotes: claim_id, quote_id, quote, domain, rank, quality;
    scores: claim_id, part (from 0), quote_id, entailment, neutral, contradiction. Closed by default: no part, no quote, no score or no distribution means no support.
    """
    parts = claims.select("claim_id", F.posexplode(matching.propositions("text")).alias("part", "said"))
    rows = parts.join(quotes.hint("merge"), "claim_id", "left").join(scores.hint("merge"), ["claim_id", "part", "quote_id"], "left")
    valid = is_distribution(F.col("entailment"), F.col("neutral"), F.col("contradiction"))
    rows = rows.withColumn("_high", valid & F.coalesce(F.col("entailment") >= threshold, F.lit(False)))
    rows = rows.repartition(4 * claims.sparkSession.sparkContext.defaultParallelism, "claim_id", "part")  # few bytes, much work: dealt over the cores
    guards = F.when(F.col("_high"), wording.run_guards(F.col("said"), F.col("quote"), F.col("domain")))  # only for what scored high enough
    rows = rows.withColumn("_failed", F.transform(F.filter(guards, lambda g: ~g["passed"]), lambda g: g["name"])).withColumn("_ok", F.col("_high") & (F.size("_failed") == 0))
    order = F.struct("rank", "quality", "entailment", "quote_id")
    per = rows.groupBy("claim_id", "part").agg(F.max(F.col("_ok").cast("int")).alias("ok"), F.max(F.when(F.col("_ok"), order)).alias("best"), F.max(valid.cast("int")).alias("scored"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_failed")))).alias("failed"))
    each = per.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("ok").alias("supported_parts"), F.max("best").alias("best"), F.min(F.coalesce("scored", F.lit(0))).alias("scored"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("ok") == 0, F.col("failed")))))).alias("failed"),
    )
    out = claims.select("claim_id").join(each.hint("merge"), "claim_id", "left").fillna(0, ["parts", "supported_parts", "scored"])
    supported = (F.col("parts") > 0) & (F.col("supported_parts") == F.col("parts"))
    failed = F.coalesce("failed", F.array().cast("array<string>"))
    reason = F.when(supported, "").when(F.col("parts") == 0, "states nothing").when(F.col("scored") == 0, "a part has no valid score").when(F.size(failed) > 0, F.concat(F.lit("withheld by deterministic guards: "), F.array_join(failed, ", "))).otherwise("below threshold")
    return out.select("claim_id", "parts", "supported_parts", supported.alias("supported"), F.when(supported, F.col("best.quote_id")).alias("best_quote"), failed.alias("failed"), reason.alias("reason"))
