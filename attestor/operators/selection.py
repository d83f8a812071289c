"""Which candidates are fetched: at least one for each sub-question, then the best of the rest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def allocate(candidates: DataFrame, limit: int, group: str = "run_id") -> DataFrame:
    """candidates: group, canonical_url, ranking, sub_questions. Returns group, canonical_url, pick (from 1), for_sub_question (null in the second pass).

    First each sub-question in order gets its best candidate, unless an earlier pick serves it too; then the best remaining ones follow up to the limit. Equal rankings: the larger URL first.
    Picks depend on earlier picks, so a group is decided in one place; beforehand it is cut to the candidates that can be picked at all, `limit` for each sub-question and `limit` overall.
    """
    order = (F.col("ranking").desc(), F.col("canonical_url").desc())
    long = candidates.withColumn("_sq", F.explode_outer("sub_questions"))
    by_question = Window.partitionBy(group, "_sq").orderBy(*order)
    able = long.withColumn("_n", F.row_number().over(by_question)).where(F.col("_n") <= limit).select(group, "canonical_url", "ranking", "sub_questions").distinct()
    kinds = dict(candidates.dtypes)

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        pool = sorted(zip(rows["ranking"], rows["canonical_url"], rows["sub_questions"], strict=True), key=lambda r: (r[0], r[1]), reverse=True)
        served: set[str] = set()
        taken: dict[str, str | None] = {}
        for question in sorted({q for _, _, qs in pool for q in qs}):
            if len(taken) < limit and question not in served:
                _, url, qs = next(r for r in pool if question in r[2] and r[1] not in taken)
                taken[url] = question
                served |= set(qs)
        for _, url, _ in pool:
            if len(taken) < limit and url not in taken:
                taken[url] = None
        return pd.DataFrame({group: rows[group].iloc[0], "canonical_url": list(taken), "pick": range(1, len(taken) + 1), "for_sub_question": list(taken.values())})

    return able.groupBy(group).applyInPandas(pick, f"{group} {kinds[group]}, canonical_url string, pick int, for_sub_question string")


def starved(candidates: DataFrame, picks: DataFrame, sub_questions: DataFrame, group: str = "run_id") -> DataFrame:
    """Sub-questions of a group for which nothing was picked."""
    served = picks.join(candidates, [group, "canonical_url"]).select(group, F.explode("sub_questions").alias("sub_question_id")).distinct()
    return sub_questions.join(served, [group, "sub_question_id"], "left_anti")


def interleaved(queries: DataFrame, budget: int) -> DataFrame:
    """Query ids in the order in which they are issued: all first queries before any second one, by priority and id, up to the budget."""
    depth = Window.partitionBy("sub_question_id").orderBy("query_id")
    rows = queries.withColumn("depth", F.row_number().over(depth)).where(F.col("depth") <= budget)  # cut in every task before they meet
    return rows.orderBy("depth", "priority", "sub_question_id").limit(budget)
