"""The whole verification of a report's claims as one run over tables, with one re-entrant repair.

resolve citations -> count -> drop repeats -> structure -> entailment and guards -> relevance -> one rewrite, which goes through entailment, guards and relevance again -> judgement -> publication.

A claim leaves the run at the first step that refuses it; its row says at which and why. Each step is a join with a table that is written once, so a lost executor repeats a step and not the run. Closed by default: what has no score, no
judgement in a slot that the answer turns on, or no rewrite, isn't published.

Joins are shuffled ones by hint: claims and quotes say the same over and over and compress well, so that files small enough for a broadcast may fill the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import matching, wording
from attestor.operators import dedup, gate, publishing
from attestor.operators import resolve as rs
from attestor.sources import store

#: Fixed value: quotes that one claim may rest on.
MOST_QUOTES = 8
#: Slots of a question type that can fill a core slot without being one.
STAND_INS = {"comparison": ("relationship",)}


def turns_on(slot: Column, slots: Column, core: Column, question_type: Column) -> Column:
    """Whether a judgement may withhold a claim of this slot: a core one, one that may stand in for it, and none or an unknown one."""
    own = F.coalesce(slot, F.lit(""))
    out = (own == "") | ~F.array_contains(slots, own) | F.array_contains(core, own)
    for kind, names in STAND_INS.items():
        out = out | ((question_type == kind) & own.isin(*names))
    return F.coalesce(out, F.lit(True))


def _entailment(claims: DataFrame, quotes: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """claim_id, supported, checked, reason, entailed (each part has a quote at the threshold, whatever the guards say)."""
    verdict = gate.verify(claims.select("claim_id", "text"), quotes, scores, threshold)
    parts = claims.select("claim_id", F.posexplode(matching.propositions("text")).alias("part", "_said")).select("claim_id", "part")
    sound = scores.where(gate.is_distribution(F.col("entailment"), F.col("neutral"), F.col("contradiction"))).join(quotes.select("claim_id", "quote_id").hint("merge"), ["claim_id", "quote_id"], "left_semi")
    entailed = publishing.parts_supported(parts, sound, threshold).select("claim_id", F.col("supported").alias("entailed"))
    checked = ~F.col("reason").isin("a part has no valid score", "states nothing")
    return verdict.join(entailed.hint("merge"), "claim_id", "left").select("claim_id", "supported", checked.alias("checked"), "reason", F.coalesce("entailed", F.lit(False)).alias("entailed"))


def _relevance(claims: DataFrame, quotes: DataFrame, contracts: DataFrame) -> DataFrame:
    """claim_id, fault of relevance (null: none). A claim's quotes are at most MOST_QUOTES."""
    said = quotes.groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("quote_id", "quote"))), lambda x: x["quote"]), " ").alias("_said"))
    rows = claims.join(said.hint("merge"), "claim_id", "left").join(contracts.hint("merge"), "question_id", "left").withColumn("_usable", F.coalesce("usable", F.lit(False)))
    fault = wording.relevance(F.col("text"), F.col("slot"), F.col("_said"), F.col("question"), F.col("question_type"), F.col("entities"), F.col("slots"), F.col("_usable"))
    return rows.select("claim_id", fault.alias("fault"))


def run(claims: DataFrame, evidence: DataFrame, contracts: DataFrame, scores: DataFrame, rewrites: DataFrame, judgements: DataFrame, threshold: float = gate.SUPPORT) -> DataFrame:
    """One row a claim: claim_id, question_id, kind, text (as published or refused last), repaired, state, reason.

    claims: claim_id, question_id, placement, kind, slot, text, evidence_ids. evidence: evidence_id, source_id, quote, quote_match, domain, rank, quality. contracts: question_id, question, question_type, entities, slots, core, usable.
    scores: claim_id, attempt (0: the claim, 1: its rewrite), part, quote_id, entailment, neutral, contradiction. rewrites: claim_id, rewritten. judgements: claim_id, relevant, why.
    Of several rewrites or judgements of a claim the smallest counts. States: published, passed (kinds that aren't checked), duplicate, no evidence, too many quotes, not checked, unsupported, irrelevant, repair refused, withheld.
    """
    resolved = store.written(rs.resolved(claims, evidence), "resolved")
    sound = resolved.where("issue is null").groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("pos", "evidence_id"))), lambda x: x["evidence_id"]).alias("evidence_ids"))
    rows = claims.drop("evidence_ids").join(sound.hint("merge"), "claim_id", "left").withColumn("evidence_ids", F.array_distinct(F.coalesce("evidence_ids", F.array().cast("array<string>"))))
    rows = store.written(rows, "resolved_claims")
    stays = dedup.claims(rows).where("stays").select("claim_id")
    kept = rows.join(stays.hint("merge"), "claim_id", "left_semi").where("kind = 'substantive'")
    n = F.size("evidence_ids")
    structure = F.when(n == 0, "no evidence").when(n > MOST_QUOTES, "too many quotes")
    candidates = store.written(kept.withColumn("_state", structure), "candidates")
    checkable = candidates.where("_state is null").drop("_state")

    e = evidence.select(F.col("evidence_id").alias("quote_id"), "quote", "domain", "rank", "quality")
    quotes = store.written(checkable.select("claim_id", F.explode("evidence_ids").alias("quote_id")).join(e.hint("merge"), "quote_id"), "quotes")
    first = store.written(_entailment(checkable, quotes, scores.where("attempt = 0").drop("attempt"), threshold), "first_pass")
    fault = _relevance(checkable.join(first.where("supported").hint("merge"), "claim_id", "left_semi"), quotes, contracts)
    first = store.written(first.join(fault.hint("merge"), "claim_id", "left"), "first_pass_judged")

    may = first.where(~F.col("supported") & F.col("checked") & wording.is_repairable(F.col("reason"), F.col("entailed"))).select("claim_id")
    offered = rewrites.groupBy("claim_id").agg(F.min("rewritten").alias("rewritten"))
    tried = checkable.join(may.hint("merge"), "claim_id", "left_semi").join(offered.hint("merge"), "claim_id", "left")
    wrong = F.when(F.col("rewritten").isNull(), "no rewrite").otherwise(wording.rewrite_fault(F.col("text"), F.col("rewritten")))
    tried = store.written(tried.withColumn("_wrong", wrong), "rewrites")
    again = tried.where("_wrong is null").withColumn("text", F.trim("rewritten")).drop("rewritten", "_wrong")
    second = _entailment(again, quotes, scores.where("attempt = 1").drop("attempt"), threshold).select("claim_id", F.col("supported").alias("healed"), F.col("reason").alias("still"))
    second = second.join(_relevance(again, quotes, contracts).select("claim_id", F.col("fault").alias("second_fault")).hint("merge"), "claim_id", "left")
    repair = tried.select("claim_id", "rewritten", "_wrong").join(second.hint("merge"), "claim_id", "left")
    refusal = (
        F.when(F.col("_wrong").isNotNull(), F.col("_wrong")).when(~F.coalesce("healed", F.lit(False)), F.concat(F.lit("still unsupported: "), F.coalesce("still", F.lit("")))).when(F.col("second_fault").isNotNull(), F.concat(F.lit("still irrelevant: "), "second_fault"))
    )
    repair = store.written(repair.select("claim_id", F.trim("rewritten").alias("rewritten"), refusal.alias("refusal"), refusal.isNull().alias("repaired")), "repairs")

    judged = judgements.groupBy("claim_id").agg(F.min(F.struct("relevant", "why")).alias("j")).select("claim_id", F.col("j.relevant").alias("answers"), F.col("j.why").alias("why"))
    asked = contracts.select("question_id", "question_type", "slots", "core")
    met = checkable.join(first.hint("merge"), "claim_id").join(repair.hint("merge"), "claim_id", "left").join(judged.hint("merge"), "claim_id", "left").join(asked.hint("merge"), "question_id", "left").withColumn("repaired", F.coalesce("repaired", F.lit(False)))
    sound_now = F.col("supported") | F.col("repaired")
    vetoed = ~F.coalesce("answers", F.lit(False)) & turns_on(F.col("slot"), F.col("slots"), F.col("core"), F.col("question_type"))
    state = (
        F.when(~sound_now & ~F.col("checked"), "not checked").when(~sound_now & F.col("refusal").isNotNull(), "repair refused").when(~sound_now, "unsupported")
        .when(F.col("supported") & F.col("fault").isNotNull(), "irrelevant").when(vetoed, "withheld").otherwise("published")
    )
    why = (
        F.when(state == "repair refused", F.concat(F.col("reason"), F.lit("; "), F.col("refusal"))).when(~sound_now, F.col("reason")).when(state == "irrelevant", F.col("fault"))
        .when(state == "withheld", F.coalesce("why", F.lit("no judgement"))).otherwise("")
    )
    decided = met.select("claim_id", F.when(F.col("repaired"), F.col("rewritten")).otherwise(F.col("text")).alias("last"), "repaired", state.alias("state"), why.alias("reason"))
    structural = candidates.where("_state is not null").select("claim_id", F.col("text").alias("last"), F.lit(False).alias("repaired"), F.col("_state").alias("state"), F.lit("").alias("reason"))
    ended = decided.unionByName(structural)
    out = rows.join(ended.hint("merge"), "claim_id", "left")
    other = F.when(F.col("kind") != "substantive", "passed").otherwise("duplicate")
    return out.select("claim_id", "question_id", "kind", F.coalesce("last", "text").alias("text"), F.coalesce("repaired", F.lit(False)).alias("repaired"), F.coalesce("state", other).alias("state"), F.coalesce("reason", F.lit("")).alias("reason"))


def counts(ended: DataFrame) -> DataFrame:
    """By question: generated = duplicates + structural + checkable; checkable = not_checked + checked; checked = supported + unsupported; supported = published + irrelevant + withheld; repaired ones among the supported."""
    state, n = F.col("state"), lambda *names: F.count_if(F.col("state").isin(*names))
    return ended.where(state != "passed").groupBy("question_id").agg(
        F.count(F.lit(1)).alias("generated"), n("duplicate").alias("duplicates"), n("no evidence", "too many quotes").alias("structural"),
        n("not checked", "unsupported", "repair refused", "irrelevant", "withheld", "published").alias("checkable"), n("not checked").alias("not_checked"),
        n("unsupported", "repair refused", "irrelevant", "withheld", "published").alias("checked"), n("irrelevant", "withheld", "published").alias("supported"), n("unsupported", "repair refused").alias("unsupported"),
        n("irrelevant").alias("irrelevant"), n("withheld").alias("withheld"), F.count_if("repaired").alias("repaired"), n("repair refused").alias("refused_repairs"), n("published").alias("published"),
    )
