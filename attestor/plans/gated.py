"""Named queries of the whole verification run, over claims that are made from the passages of the benchmark and cite the documents that hold these."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions import matching
from attestor.functions import text as tx
from attestor.operators import answers, gate_run
from attestor.plans.queries import query
from attestor.sources import store
from attestor.sources import views as vw

#: What a claim adds to the sentence that it takes from its passage, and what its rewrite says instead ({s}: the sentence). One in as many claims of a conversation's turns each.
TURNS_OF_PHRASE = (
    ("{s}", None), ("{s} by 47%", "{s}"), ("{s}, according to Acme Research", "{s}"), ("{s} only", "{s}"), ("{s} by 12%", "{s} by 31%"), ("{s} by 9%", None), ("{s} by 5%", "Zebulon says {s}"), ("This must always hold: {s}", "{s}"),
)


@dataclass
class Inputs:
    claims: DataFrame
    evidence: DataFrame
    contracts: DataFrame
    scores: DataFrame
    rewrites: DataFrame
    judgements: DataFrame

    def ended(self) -> DataFrame:
        """The run over all of them. It reads the scores twice, so they are written here; queries of the wording alone don't make them."""
        return gate_run.run(self.claims, self.evidence, self.contracts, store.written(self.scores, "scores"), self.rewrites, self.judgements)


def inputs(spark, sf: str) -> Inputs:
    """Every assistant turn makes a claim of a sentence of the passage that its conversation is about: the wording turns by its ids. It cites the first items of evidence of that passage, one more each turn. Scores say whether the
    sentence stands in the quote, and are missing for one conversation in thirteen; judgements are missing for one in seven."""
    held = vw.evidence(spark, sf)
    base = vw.claims(spark, sf, held).withColumnRenamed("conv_id", "question_id")
    n = vw.table(spark, sf, "benchmark").agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    passages = vw.table(spark, sf, "benchmark").select("item_id", F.filter(F.transform(F.split(F.trim(tx.one_spaced(F.col("text"))), r"(?<=[.])\s+"), lambda s: F.rtrim(s, F.lit("."))), lambda s: s != "").alias("sentences")).where("size(sentences) > 0")
    case = ((F.col("question_id") * 5 + F.col("turn")) % len(TURNS_OF_PHRASE)).cast("int")
    wording_of = lambda i: F.element_at(F.array(*(F.lit(c[i]) for c in TURNS_OF_PHRASE)), case + 1)
    met = base.withColumn("item_id", (F.col("question_id") + F.when(F.col("question_id") % 11 == 0, 1).otherwise(0)) % n).join(passages, "item_id").withColumn("s", F.element_at("sentences", (F.col("turn") % F.size("sentences") + 1).cast("int")))
    kinds = F.array(*(F.lit(k) for k in answers.SLOTS))
    kind = F.element_at(kinds, (F.col("question_id") % len(answers.SLOTS) + 1).cast("int"))
    table = F.create_map(*(x for k, own in answers.SLOTS.items() for x in (F.lit(k), F.array(*(F.lit(s) for s, _ in own)))))
    core = F.create_map(*(x for k, own in answers.SLOTS.items() for x in (F.lit(k), F.array(*(F.lit(s) for s, c in own if c)))))
    slot = F.when(F.col("turn") % 7 == 5, F.lit("unheard_of")).otherwise(F.element_at(table[kind], (F.col("turn") % F.size(table[kind]) + 1).cast("int")))
    claims = met.select(
        F.col("claim_id"), "question_id", "placement", "kind", slot.alias("slot"), F.replace(wording_of(0), F.lit("{s}"), F.col("s")).alias("text"), "evidence_ids", F.replace(wording_of(1), F.lit("{s}"), F.col("s")).alias("rewritten"), "s",
    )
    claims = store.written(claims, "gated_claims")
    entity = F.element_at(F.array_sort(F.split("s", " "), lambda a, b: F.length(b) - F.length(a)), 1)
    first = claims.groupBy("question_id").agg(F.min_by("s", "claim_id").alias("s"))
    questions = first.select("question_id", F.concat(F.lit("What is said of "), entity, F.lit("?")).alias("question"), kind.alias("question_type"), F.when(F.col("question_id") % 6 == 0, F.array(entity)).otherwise(F.array().cast("array<string>")).alias("entities"))
    contracts = questions.select("*", table[F.col("question_type")].alias("slots"), core[F.col("question_type")].alias("core"), (F.col("question_id") % 17 != 0).alias("usable"))
    domains = vw.sources(spark, sf).select("source_id", "domain", "quality")
    evidence = held.join(domains.hint("merge"), "source_id").select("evidence_id", "source_id", "quote", "quote_match", "domain", F.lit(0).alias("rank"), "quality")

    quotes = claims.select("claim_id", "question_id", "text", "rewritten", "s", F.explode("evidence_ids").alias("quote_id")).join(evidence.select(F.col("evidence_id").alias("quote_id"), "quote").hint("merge"), "quote_id")
    told = quotes.select("*", F.explode(F.array(F.struct(F.lit(0).alias("attempt"), F.col("text").alias("t")), F.struct(F.lit(1).alias("attempt"), F.col("rewritten").alias("t")))).alias("a")).where("a.t is not null and question_id % 13 <> 0")
    parts = told.select("claim_id", "question_id", "quote_id", "quote", "s", "a.attempt", F.posexplode(matching.propositions("a.t")).alias("part", "said"))
    # The scorer is outside; its table is made of whether the quote holds the words of the part.
    words = F.split(F.lower(F.regexp_replace("said", r"[^\p{L}]+", " ")), " ")
    shared = F.size(F.array_intersect(words, F.split(F.lower(F.regexp_replace("quote", r"[^\p{L}]+", " ")), " "))) / F.size(F.array_distinct(words))
    entailment = F.when(shared >= 0.6, 0.99).otherwise(F.round(shared * 0.5, 4))
    scores = parts.select("claim_id", "attempt", "part", "quote_id", entailment.alias("entailment"), F.round(1 - entailment, 4).alias("neutral"), F.lit(0.0).alias("contradiction"))
    judged = claims.where("question_id % 7 <> 3").select("claim_id", (F.col("question_id") % 5 != 2).alias("relevant"), F.lit("off the point").alias("why"))
    return Inputs(claims.drop("rewritten", "s"), evidence, contracts, scores, claims.where("rewritten is not null").select("claim_id", "rewritten"), judged)


def _ended(spark, sf: str) -> DataFrame:
    return inputs(spark, sf).ended()


@query()
def gated_claims(spark, sf):
    """Where each claim leaves the run, with the text it leaves with. Guards and relevance have no SQL form; tests replay the run claim by claim."""
    return _ended(spark, sf)


@query()
def gate_counts(spark, sf):
    """By conversation: how many claims were generated, and how many were left at each step."""
    return gate_run.counts(_ended(spark, sf))
