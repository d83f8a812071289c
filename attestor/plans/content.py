"""Named queries of the wording functions over what tables hold: claims made of passages, their quotes, questions, and the turns of conversations. What they say of single sentences is held against hand-written cases by `plans/language.py`;
here tests hold them against plain code."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import matching, wording
from attestor.operators import answers, publishing
from attestor.plans import gated
from attestor.plans.queries import query
from attestor.sources import store
from attestor.sources import views as vw


def _texts(spark, sf):
    """Every turn of a conversation and every passage: kind, id, text."""
    turns = vw.table(spark, sf, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return turns.unionByName(vw.table(spark, sf, "benchmark").select(F.lit("passage").alias("kind"), F.col("item_id").cast("long").alias("id"), "text"))


@query()
def passage_guards(spark, sf):
    """What each of the nine guards says of each claim and quote that it cites."""
    i = gated.inputs(spark, sf)
    quotes = i.evidence.select(F.col("evidence_id").alias("quote_id"), "quote", "domain")
    met = store.written(i.claims.select("claim_id", "text", F.explode("evidence_ids").alias("quote_id")).join(quotes, "quote_id"), "cited_quotes")
    # Guards read the wording alone, so each case of it is judged once; the cases are few bytes and much work, so they are dealt over the cores.
    keys = ["text", "quote", "domain"]
    cases = met.select(*keys).distinct().repartition(4 * spark.sparkContext.defaultParallelism)
    judged = store.written(cases.select(*(F.col(k).alias(f"_{k}") for k in keys), wording.run_guards(F.col("text"), F.col("quote"), F.col("domain")).alias("guards")), "judged_quotes")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return met.join(judged, same).select("claim_id", "quote_id", F.explode("guards").alias("g")).select("claim_id", "quote_id", "g.name", "g.passed")


@query()
def text_clauses(spark, sf):
    """Parts, sentences, compound reasons and markers of every turn and passage."""
    t = F.col("text")
    return _texts(spark, sf).select("kind", "id", matching.propositions("text").alias("parts"), wording.sentence_count(t).alias("sentences"), wording.compound_reasons(t).alias("reasons"), wording.compound_markers(t).alias("markers"))


@query()
def text_forms_of_speech(spark, sf):
    """Shape, sides, relationship, causation and strength of every turn and passage, read as a question and as a claim."""
    t = F.col("text")
    rows = _texts(spark, sf).withColumn("sides", wording.comparison_sides("text"))
    return rows.select("kind", "id", wording.shape(t, F.col("sides")).alias("shape"), "sides", wording.relation(t).alias("relation"), wording.states_causation(t).alias("causation"), wording.modality_level(t).alias("strength"))


@query()
def claim_subjects(spark, sf):
    """For every claim: why it can't answer its question, the first subject that the question doesn't name, and the question's entities that it speaks about, with their aliases."""
    i = gated.inputs(spark, sf)
    rows = i.claims.join(i.contracts, "question_id")
    groups = wording.alias_groups(F.col("question"), F.col("entities"))
    fault = wording.relevance(F.col("text"), F.col("slot"), F.col("text"), F.col("question"), F.col("question_type"), F.col("entities"), F.col("slots"), F.col("usable"))
    about = F.filter("entities", lambda e: wording.speaks_about(F.col("text"), e, groups))
    return rows.select("claim_id", fault.alias("fault"), wording.competing_subject(F.col("text"), F.col("question"), F.col("entities")).alias("other"), about.alias("about"), groups.alias("groups"))


@query()
def rewrite_faults(spark, sf):
    """What each offered rewrite does that it may not, and the strength of both wordings."""
    i = gated.inputs(spark, sf)
    rows = i.claims.select("claim_id", "text").join(i.rewrites, "claim_id")
    return rows.select("claim_id", wording.rewrite_fault(F.col("text"), F.col("rewritten")).alias("fault"), wording.modality_level(F.col("text")).alias("before"), wording.modality_level(F.col("rewritten")).alias("after"))


@query()
def run_answers(spark, sf):
    """By conversation: what its answer asks for, which slots the claims that the run has published fill, whether it is answered, and what is said of its gaps."""
    i = gated.inputs(spark, sf)
    ended = store.written(i.ended(), "ended")
    published = ended.where("state = 'published'").join(i.claims.select("claim_id", "slot"), "claim_id").select("question_id", "slot", "text")
    required = answers.slots(i.contracts.where("usable").select("question_id", "question_type"))
    counted = required.join(published.groupBy("question_id", "slot").agg(F.count(F.lit(1)).alias("claims")), ["question_id", "slot"], "left").fillna(0, ["claims"])
    causal = published.where(wording.states_causation(F.col("text"))).select("question_id")
    none = published.limit(0).select("question_id")
    filled = answers.discharged(counted, causal, none, published.where((F.col("slot") == "relationship") & wording.relation(F.col("text")).isin(*wording.DISCHARGING)))
    slots = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col("slot"))))
    per = filled.groupBy("question_id").agg(
        slots(F.col("filled")).alias("filled"), slots(~F.col("filled") & F.col("core")).alias("missing_core"), slots(~F.col("filled") & ~F.col("core")).alias("missing"), slots(F.col("claims") > 1).alias("repeated"),
    )
    answered = F.size("missing_core") == 0
    rows = per.select("*", answered.alias("answered"), (~answered & (F.size("filled") > 0)).alias("partly"), F.array().cast("array<string>").alias("absent"))
    return rows.join(publishing.limitations(rows), "question_id").select("question_id", "filled", "missing_core", "missing", "answered", "partly", "lines")
