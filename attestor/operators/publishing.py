"""From judged claims to a report: stages of the gate, answer contracts, what is said about gaps, rendered lines; measurements of extraction strategies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import lexicon as lx
from attestor.operators import answers


def parts_supported(parts: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """claim_id, parts, sound (parts with a score at or over the threshold), supported (all are). parts: claim_id, part; scores: claim_id, part, entailment. A part without a score is not sound."""
    best = scores.groupBy("claim_id", "part").agg(F.max(F.when(~F.isnan("entailment"), F.col("entailment"))).alias("best"))
    rows = parts.join(best.hint("merge"), ["claim_id", "part"], "left").groupBy("claim_id").agg(F.count(F.lit(1)).alias("parts"), F.count_if(F.col("best") >= threshold).alias("sound"))
    return rows.withColumn("supported", (F.col("parts") > 0) & (F.col("sound") == F.col("parts")))


def stages(claims: DataFrame) -> DataFrame:
    """claim_id, stage: where a claim's way ends. claims: claim_id, supported, repairable, repair_supported, fault (of relevance), core (whether its slot is one the answer turns on), judged (true, false or null).

    An unsupported claim may be reworded once, if only its wording was at fault. A negative or missing judgement withholds claims of core slots only; what other slots hold is for the answer's coverage to weigh.
    """
    sound = F.col("supported") | (F.col("repairable") & F.coalesce("repair_supported", F.lit(False)))
    stage = (
        F.when(~sound, "withheld: entailment").when(F.col("fault").isNotNull(), "withheld: relevance").when(F.col("core") & F.col("judged").isNull(), "withheld: no judgement").when(F.col("core") & ~F.col("judged"), "withheld: judgement")
        .when(~F.col("supported"), "published: repaired").otherwise("published")
    )
    return claims.select("claim_id", stage.alias("stage"))


def off_subject(claims: DataFrame, quotes: DataFrame) -> DataFrame:
    """claim_id, off_subject: whether no quote that a claim cites is on its own subject; false without quotes. claims: claim_id, text; quotes: claim_id, quote."""
    met = claims.select("claim_id", "text").join(quotes, "claim_id")
    per = met.groupBy("claim_id").agg(F.max(lx.plausible(F.col("text"), F.col("quote")).cast("int")).alias("on"))
    return claims.select("claim_id").join(per, "claim_id", "left").select("claim_id", F.coalesce(F.col("on") == 0, F.lit(False)).alias("off_subject"))


def contracts(questions: DataFrame) -> DataFrame:
    """question_id, question_type, slots, core, usable, why_not. questions: question_id, told (the analyst's type or null), shape (that of the wording or null), entities, ambiguous.

    The wording decides over the analyst. Without a type, for an ambiguous question, or for a comparison of fewer than two, there is no contract, and the reason is given instead of a default.
    """
    kind = F.coalesce("shape", "told")
    table = F.create_map(*(x for k, own in answers.SLOTS.items() for x in (F.lit(k), F.array(*(F.struct(F.lit(s).alias("slot"), F.lit(c).alias("core")) for s, c in own)))))
    own = F.coalesce(table[kind], F.array().cast("array<struct<slot:string,core:boolean>>"))
    why = F.when(F.col("ambiguous"), "ambiguous").when(kind.isNull() | (F.size(own) == 0), "no known type").when((kind == "comparison") & (F.size("entities") < 2), "nothing to compare")
    slots = F.when(why.isNull(), own).otherwise(F.array().cast("array<struct<slot:string,core:boolean>>"))
    return questions.select("question_id", kind.alias("question_type"), F.transform(slots, lambda s: s["slot"]).alias("slots"), F.transform(F.filter(slots, lambda s: s["core"]), lambda s: s["slot"]).alias("core"), why.isNull().alias("usable"), F.coalesce(why, F.lit("")).alias("why_not"))


def limitations(coverage: DataFrame, most: int = 5) -> DataFrame:
    """question_id, lines: what an answer lacks, distinct, the first `most`. coverage: question_id, answered, partly, missing_core (array), missing (array), absent (array of entities), repeated (array of slots)."""
    said = F.concat(
        F.array(F.when(~F.col("answered") & ~F.col("partly"), "The question was not answered.").when(~F.col("answered"), "The question was answered in part.")),
        F.transform("missing_core", lambda s: F.concat(F.lit("No published claim gives the "), s, F.lit("."))), F.transform("missing", lambda s: F.concat(F.lit("Nothing was found on the "), s, F.lit("."))),
        F.transform("absent", lambda s: F.concat(F.lit("No source speaks of "), s, F.lit("."))), F.transform("repeated", lambda s: F.concat(F.lit("Claims on the "), s, F.lit(" may repeat each other."))),
    )
    return coverage.select("question_id", F.slice(F.array_distinct(F.array_compact(said)), 1, most).alias("lines"))


def first_shown(rows: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """rows whose key stands in no earlier row."""
    at = F.struct(*order)
    first = rows.groupBy(key.alias("_key")).agg(F.min(at).alias("_first"))
    return rows.withColumn("_key", key).withColumn("_at", at).join(first, "_key").where(F.col("_at") == F.col("_first")).drop("_key", "_at", "_first")


def pair_table(pairs: DataFrame) -> DataFrame:
    """question_id, dimension, line: the rows of a comparison table. pairs: question_id, dimension, subject, text. Named dimensions come first in order, then the generic `dimension` (place)."""
    cells = pairs.groupBy("question_id", "dimension").agg(F.array_sort(F.collect_list(F.struct("subject", "text"))).alias("cells"))
    line = F.concat(F.lit("| "), "dimension", F.lit(" | "), F.array_join(F.transform("cells", lambda c: F.concat(c["subject"], F.lit(": "), F.replace(c["text"], F.lit("|"), F.lit("\\|")))), " | "), F.lit(" |"))
    w = Window.partitionBy("question_id").orderBy(F.col("dimension") == "dimension", "dimension")
    return cells.select("question_id", "dimension", line.alias("line"), F.row_number().over(w).alias("place"))


def strategy_measures(evidence: DataFrame, found: DataFrame) -> DataFrame:
    """By strategy: items, citable ones, sources used, sub-questions covered, items attributed to a sub-question that did not find their source, and the share of these. evidence: strategy, evidence_id, source_id, sub_question_id, citable; found: source_id, sub_question_id."""
    e = evidence.join(found.select("source_id", "sub_question_id").distinct().withColumn("_own", F.lit(True)), ["source_id", "sub_question_id"], "left")
    citable = F.col("citable")
    per = e.groupBy("strategy", "source_id", "sub_question_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(citable).alias("c"), F.count_if(citable & F.col("_own").isNull()).alias("x"))
    sums = per.groupBy("strategy").agg(F.sum("n").alias("items"), F.sum("c").alias("citable"), F.sum("x").alias("cross_attributed"))
    distinct = lambda name, column: per.where("c > 0").select("strategy", column).distinct().groupBy("strategy").agg(F.count(F.lit(1)).alias(name))
    out = sums.join(distinct("sources_used", "source_id"), "strategy", "left").join(distinct("sub_questions", "sub_question_id"), "strategy", "left").fillna(0, ["sources_used", "sub_questions"])
    return out.withColumn("cross_share", F.round(F.try_divide("cross_attributed", "citable"), 4)).withColumn("breach", (F.col("strategy") == "retrieved_only") & (F.col("cross_attributed") > 0))


def numeric_anchor(claim: Column, evidence: Column) -> Column:
    """The numbers of a claim, and which of them the evidence holds; '' without any."""
    own, held = lx.literals(claim), lx.literals(evidence)
    listed = lambda a: F.when(F.size(a) > 0, F.array_join(a, ", ")).otherwise("none")
    return F.when(F.size(own) == 0, "").otherwise(F.concat(F.lit("claim: "), listed(own), F.lit("; found: "), listed(F.array_intersect(own, held)), F.lit("; missing: "), listed(F.array_except(own, held))))
