"""Named queries that run in rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import rounds
from attestor.plans.queries import query
from attestor.sources import store
from attestor.sources import views as vw


@query()
def research_rounds(spark, sf):
    """What a bounded search over the recorded results has covered when it stops: domains, results taken and queries of each sub-question, and why it stopped. Rounds depend on what rounds before have found, so SQL has no form of it;
    a test runs it in plain loops, and stops and resumes it."""
    found = store.written(vw.results(spark, sf).where("canonical_url <> '' and sub_question_id <> ''").select("canonical_url", "domain", "sub_question_id", "seq"), "recorded_results")
    questions = found.select("sub_question_id").distinct()
    tables, why = rounds.research(spark, store.fresh_path(spark, "research"), found, questions, rounds.Limits(enough=40, rounds=6, queries=60, sources=100_000), each=12)
    return tables["coverage"].join(tables["asked"], "sub_question_id").select("sub_question_id", "domains", "queries", "taken", "round", F.lit(why).alias("stop"))
