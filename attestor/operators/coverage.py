"""Coverage of sub-questions, evidence packages, and diversity of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUFFICIENT, CONCENTRATED = 0.7, 0.6


def coverage(evidence: DataFrame, sub_questions: DataFrame, bears: Column | None = None) -> DataFrame:
    """For each sub-question: items, exact ones that bear on it, their sources, contradiction, verdict and cause. `bears`: whether an item can bear on the question; default: all do."""
    ok = F.col("quote_match") == "exact"
    fits = ok & (bears if bears is not None else F.lit(True))
    # By source first: distinct sources are then a plain count.
    per = evidence.groupBy("sub_question_id", "source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("exact"), F.count_if(fits).alias("fit"), F.max((F.col("stance") == "contradicts").cast("int")).alias("c"))
    agg = per.groupBy("sub_question_id").agg(F.sum("n").alias("items"), F.sum("exact").alias("exact"), F.sum("fit").alias("fitting"), F.count_if(F.col("fit") > 0).alias("sources"), (F.max("c") == 1).alias("contradicted"))
    rows = sub_questions.select("sub_question_id").join(agg, "sub_question_id", "left").fillna(0, ["items", "exact", "fitting", "sources"]).withColumn("contradicted", F.coalesce("contradicted", F.lit(False)))
    verdict = F.when((F.col("sources") >= 2) & (F.col("fitting") >= 2), "covered").when(F.col("fitting") > 0, "weak").otherwise("uncovered")
    cause = F.when(verdict == "covered", "").when(verdict == "weak", "evidence insufficient").when(F.col("exact") > 0, "retrieved source did not discuss this sub-question").otherwise("no evidence attributed")
    return rows.withColumn("off_topic", F.col("exact") - F.col("fitting")).withColumn("verdict", verdict).withColumn("cause", cause)


def assessment(covered: DataFrame, concentration: DataFrame) -> DataFrame:
    """One row: ratio of covered sub-questions, whether it suffices, and the warning for sources of few domains, of more than two sources."""
    a = covered.agg(F.count(F.lit(1)).alias("sub_questions"), F.count_if(F.expr("verdict = 'covered'")).alias("covered"), F.count_if(F.expr("verdict = 'uncovered'")).alias("missing"), F.sum("items").alias("items"))
    ratio = F.round(F.try_divide("covered", "sub_questions"), 4)
    a = a.withColumn("ratio", ratio).withColumn("sufficient", (F.col("ratio") >= SUFFICIENT) & (F.col("missing") == 0) & (F.col("items") > 0))
    a = a.withColumn("concentration", concentration.select("concentration").scalar())
    return a.withColumn("diversity_warning", (F.col("concentration") > CONCENTRATED) & (concentration.select("rows").scalar() > 2))


def domain_concentration(rows: DataFrame) -> DataFrame:
    """One row: the largest number of rows of one non-empty domain over all rows."""
    per = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.round(F.max(F.when(F.col("domain") != "", F.col("n"))) / F.sum("n"), 4).alias("concentration"), F.count_if(F.expr("domain <> ''")).alias("domains"), F.sum("n").alias("rows"))


def packages(evidence: DataFrame, source_rank: DataFrame, most: int = 8, least_confidence: float = 0.25) -> DataFrame:
    """The best `most` citable items of each sub-question: contradictions first, then confidence in tenths, source rank, confidence, id. Row numbers up to a bound are kept before the shuffle."""
    factor = F.when(F.col("quote_match") == "exact", 1.0).when(F.col("quote_match") == "fuzzy", 0.4).otherwise(0.15)
    rows = evidence.withColumn("confidence", F.round(F.col("relevance") * factor, 3)).where((F.col("quote_match") == "exact") & (F.col("confidence") >= least_confidence)).join(source_rank, "source_id", "left")
    rows = rows.withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    w = Window.partitionBy("sub_question_id").orderBy((F.col("stance") == "contradicts").desc(), F.round("confidence", 1).desc(), F.col("rank").desc(), F.col("confidence").desc(), "evidence_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("sub_question_id", "place", "evidence_id", "confidence", "rank")
