"""Claims against evidence and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cited(claims: DataFrame) -> DataFrame:
    return claims.select("claim_id", F.posexplode("evidence_ids").alias("pos", "evidence_id"))


def resolved(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row for each citation: the source, and the issue (unknown evidence, quote not verified) or null."""
    e = evidence.select("evidence_id", "source_id", "quote_match")
    issue = F.when(F.col("source_id").isNull(), "unknown_evidence").when(F.col("quote_match") != "exact", "quote_unverified")
    return cited(claims).join(e.hint("merge"), "evidence_id", "left").select("claim_id", "pos", "evidence_id", "source_id", issue.alias("issue"))


def citations(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id, source_ids (of sound citations, distinct, in order) and counts. A claim cites a bounded list, so its rows meet in one group of that size."""
    rows = resolved(claims, evidence)
    sound = F.when(F.col("issue").isNull(), F.struct(F.col("pos").alias("o"), F.col("source_id").alias("v")))
    return rows.groupBy("claim_id").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(sound)), lambda p: p["v"])).alias("source_ids"),
        F.count(F.lit(1)).alias("cited"), F.count_if(F.col("issue").isNull()).alias("sound"), F.count_if(F.col("issue") == "unknown_evidence").alias("unknown"), F.count_if(F.col("issue") == "quote_unverified").alias("unverified"),
    )


def unused_sources(sources: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    used = resolved(claims, evidence).where("issue is null").select("source_id").distinct()
    return sources.where("usable").select("source_id").join(used, "source_id", "left_anti")


def integrity(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: citations, sound ones, claims with and without any, and the rates; a rate over nothing is 1 for integrity, null for coverage."""
    per = citations(claims, evidence).join(claims.select("claim_id", "kind"), "claim_id")
    out = per.agg(F.sum("cited").alias("citations"), F.sum("sound").alias("sound"), F.sum("unknown").alias("unknown"), F.count_if(F.expr("kind <> 'framing'")).alias("substantive"), F.count_if((F.col("kind") != "framing") & (F.col("sound") > 0)).alias("covered"))
    return out.select("*", F.coalesce(F.round(F.try_divide("sound", "citations"), 4), F.lit(1.0)).alias("citation_integrity"), F.round(F.try_divide("covered", "substantive"), 4).alias("citation_coverage"))


def published(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The publication gate, closed by default: framing and extracted claims pass, others need the verdict `supported` for exactly their text and evidence."""
    v = verdicts.groupBy("text", "evidence_ids").agg(F.max_by("verdict", F.col("verdict") != "supported").alias("verdict"))  # of several the one that supports least
    joined = claims.join(v, ["text", "evidence_ids"], "left")
    return joined.select("claim_id", F.coalesce(F.col("kind").isin("framing", "extracted") | (F.col("verdict") == "supported"), F.lit(False)).alias("published"), F.coalesce("verdict", F.lit("unchecked")).alias("verdict"))
