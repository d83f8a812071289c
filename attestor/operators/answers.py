"""Whether claims answer what a question asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The slots of each type of question, (name, whether it is core).
SLOTS = {
    "definition": (("definition", True), ("distinguishing_property", False)),
    "comparison": (("direct_contrast", True), ("dimension", False), ("relationship", False)),
    "causal": (("causal_evidence", True), ("effect_direction", False), ("limitations", False)),
    "causal_drivers": (("candidate_drivers", True), ("mechanism", False), ("causation_limits", False)),
    "numeric": (("measured_value", True), ("measurement_conditions", False), ("limitations", False)),
    "temporal": (("figure_for_period", True), ("period_confirmation", False)),
    "procedural": (("steps", True), ("preconditions", False)),
    "recommendation": (("recommendation", True), ("tradeoffs", False)),
    "list": (("items", True), ("completeness", False)),
    "synthesis": (("part_answer", True),),
}
#: The slot of a comparison that pairs of sides and relationships may fill.
CONTRAST = "direct_contrast"


def slots(questions: DataFrame) -> DataFrame:
    """question_id, slot, core for questions (question_id, question_type); unknown types have no slot."""
    table = F.create_map(*(x for kind, own in SLOTS.items() for x in (F.lit(kind), F.array(*(F.struct(F.lit(s).alias("slot"), F.lit(c).alias("core")) for s, c in own)))))
    return questions.select("question_id", F.explode(table[F.col("question_type")]).alias("s")).select("question_id", "s.slot", "s.core")


def answer_coverage(required: DataFrame, published: DataFrame) -> DataFrame:
    """By question: slots with a published claim, missing ones, missing core ones, and whether it is answered (there are core slots and none is missing) or partly so."""
    have = published.groupBy("question_id", "slot").agg(F.count(F.lit(1)).alias("claims"))
    rows = required.join(have, ["question_id", "slot"], "left")
    missing = F.col("claims").isNull()
    out = rows.groupBy("question_id").agg(F.count_if(~missing).alias("filled"), F.count_if(missing).alias("missing"), F.count_if(missing & F.col("core")).alias("missing_core"), F.count_if("core").alias("core"), F.coalesce(F.sum(F.col("claims") - 1), F.lit(0)).alias("repeats"))
    answered = (F.col("core") > 0) & (F.col("missing_core") == 0)
    return out.withColumn("answered", answered).withColumn("partly", ~F.col("answered") & (F.col("filled") > 0))


def discharged(coverage: DataFrame, causal: DataFrame, pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """coverage (question_id, slot, core, claims: how many were published for it, 0 if none) with `filled`.

    The slot causal_evidence needs a claim that states causation (causal: question_id). The slot CONTRAST is also filled by a complete pair of sides (pairs: question_id) or by a relationship that makes a contrast needless
    (relations: question_id).
    """
    flag = lambda t, name: t.select("question_id").distinct().withColumn(name, F.lit(True))
    rows = coverage.join(flag(causal, "_causal"), "question_id", "left").join(flag(pairs, "_pair"), "question_id", "left").join(flag(relations, "_related"), "question_id", "left")
    own = (F.col("claims") > 0) & ((F.col("slot") != "causal_evidence") | F.col("_causal").isNotNull())
    other = (F.col("slot") == CONTRAST) & (F.col("_pair").isNotNull() | F.col("_related").isNotNull())
    return rows.select("question_id", "slot", "core", "claims", (own | other).alias("filled"))


def complete_pairs(claims: DataFrame, subjects: Column) -> DataFrame:
    """question_id, slot, n of the slots in which every subject is spoken of by some claim. claims: question_id, slot, about (array of the subjects that a claim speaks of); subjects: array of those to be spanned, at least two."""
    per = claims.select("question_id", "slot", subjects.alias("_all"), F.explode("about").alias("subject")).groupBy("question_id", "slot", "_all", "subject").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("question_id", "slot", "_all").agg(F.count(F.lit(1)).alias("spoken"), F.sum("n").alias("n"))
    return out.where((F.size("_all") >= 2) & (F.col("spoken") == F.size("_all"))).select("question_id", "slot", "n")


def covering(claims: DataFrame, by: str, subject: str, subjects: list[str]) -> DataFrame:
    """Values of `by` whose claims speak of all subjects."""
    per = claims.where(F.col(subject).isin(*subjects)).groupBy(by, subject).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(by).agg(F.count(F.lit(1)).alias("subjects"), F.sum("n").alias("claims")).where(F.col("subjects") == len(set(subjects)))
