"""Recorded runs: JSON payloads walked to paths, what may not be in them, traces cut to known fields, and the index of what is fit to show; results of scorers and checks of what they return."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keys and value shapes of credentials; keys and wording of inner reasoning; where quoted text may hold such wording.
SECRET_KEYS = ("api_key", "openai_api_key", "tavily_api_key", "brave_api_key", "nli_api_key", "hf_token", "huggingface_token", "authorization", "token", "bearer")
SECRET_SHAPES = (
    r"\bsk-proj-[A-Za-z0-9_-]{20,}", r"\bsk-[A-Za-z0-9]{32,}", r"\btvly-[A-Za-z0-9]{16,}", r"\bBSA[A-Za-z0-9_-]{20,}", r"\bghp_[A-Za-z0-9]{36}", r"\bhf_[A-Za-z0-9]{30,}", r"\bAKIA[0-9A-Z]{16}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
)
REASONING_KEYS = ("strategy", "strategy_note", "rationale", "reasoning", "thinking")
SELF_TALK = r"(?i)\b(the user (?:wants|asked|is asking|needs) me|I (?:need|have|want|will|shall|should|would|could|can|must|am)\b|I'(?:ll|m|ve|d)\b|let me\b|let's\b|as an AI\b|my task\b|first,? I\b)"
QUOTED_PATHS = r"^\$(\.result\.evidence\[\d+\]\.quote|\.result\.sources\[\d+\]\.title|\.result\.markdown|\.meta\.question|\.trace\[\d+\]\.(query|title))$"
# Fields of each kind of event that a reader may see.
TRACE_FIELDS = {
    "started": "query", "analyzing_query": "query", "query_analyzed": "intent format", "planning": "", "plan_generated": "count questions", "generating_queries": "round sub_questions", "queries_generated": "count queries round",
    "search_completed": "query query_id results", "search_failed": "query_id", "sources_deduplicated": "results unique avoided selected", "source_retrieved": "source_id title", "source_failed": "source_id status",
    "sources_registered": "usable duplicates extracting", "evidence_extracted": "source_id items", "assessing_coverage": "round", "coverage_evaluated": "round ratio covered total weak missing sufficient", "synthesizing": "evidence",
    "synthesized": "sections findings", "verifying_citations": "", "citations_verified": "total evidence_integrity support exhaustive", "completed": "stop_reason",
}
SCHEMA_VERSIONS = (1, 2)
SAFE_ID = r"^[a-z0-9][a-z0-9-]{0,63}$"


def _walk(where: str, node: object) -> Iterator[tuple[str, str | None, str | None]]:
    """(path, key, text) of every named node and every string of a parsed payload."""
    if isinstance(node, dict):
        for key, value in node.items():
            yield f"{where}.{key}", str(key), None
            yield from _walk(f"{where}.{key}", value)
    elif isinstance(node, list):
        for i, value in enumerate(node):
            yield from _walk(f"{where}[{i}]", value)
    elif isinstance(node, str):
        yield where, None, node


def json_nodes(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """key, path, name (of a named node) or text (of a string): a row for every such node of each payload; what is no JSON gives one row with path null."""
    kind = dict(payloads.dtypes)[key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, raw in b.itertuples(index=False):
                try:
                    found = list(_walk("$", json.loads(raw)))
                except (TypeError, ValueError):
                    found = [(None, None, None)]
                if found:
                    yield pd.DataFrame([(k, *f) for f in found], columns=[key, "path", "name", "text"])

    return payloads.select(key, body).mapInPandas(work, f"{key} {kind}, path string, name string, text string")


def payload_faults(nodes: DataFrame, key: str) -> DataFrame:
    """key, path and fault of nodes that may not be shown: unreadable, forbidden key, credential, reasoning key, self-talk outside quoted text."""
    name, text = F.lower("name"), F.col("text")
    fault = (
        F.when(F.col("path").isNull(), "unreadable").when(name.isin(*SECRET_KEYS), "forbidden key").when(text.rlike("|".join(SECRET_SHAPES)), "credential").when(name.isin(*REASONING_KEYS), "reasoning key")
        .when(text.rlike(SELF_TALK) & ~F.col("path").rlike(QUOTED_PATHS), "self-talk")
    )
    return nodes.select(key, "path", fault.alias("fault")).where("fault is not null")


def shown_trace(events: DataFrame, fields: str = "fields") -> DataFrame:
    """events (event, fields map<string,string>) of known kinds with the fields that may be seen."""
    table = F.create_map(*(x for k, v in TRACE_FIELDS.items() for x in (F.lit(k), F.array(*(F.lit(f) for f in v.split())).cast("array<string>"))))
    allowed = table[F.col("event")]
    return events.where(allowed.isNotNull()).withColumn(fields, F.map_filter(fields, lambda k, _: F.array_contains(allowed, k)))


def index(recordings: DataFrame, faults: DataFrame) -> DataFrame:
    """recording_id, place of those fit to show: a safe id, a known schema, no fault; in the curator's order (99 where unset), then by id."""
    fit = recordings.where(F.col("recording_id").rlike(SAFE_ID) & F.col("schema_version").isin(*SCHEMA_VERSIONS)).join(faults.select("recording_id").distinct(), "recording_id", "left_anti")
    order = Window.orderBy(F.coalesce("curated", F.lit(99)), "recording_id")  # a list that people curate
    return fit.select("recording_id", F.row_number().over(order).cast("long").alias("place"))


def score_faults(asked: DataFrame, returned: DataFrame) -> DataFrame:
    """pair_id, fault: pairs without a score, scores nobody asked for, pairs with several. asked, returned: pair_id."""
    back = returned.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"))
    both = asked.select("pair_id").distinct().withColumn("a", F.lit(True)).join(back, "pair_id", "full")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return both.select("pair_id", fault.alias("fault")).where("fault is not null")


def stop_reason(round_number: Column, most_rounds: int, sufficient: Column, queries: Column, most_queries: int, sources: Column, most_sources: int, followups: Column, missing: Column) -> Column:
    """Why a run stops after a round, the first that holds; null if it goes on."""
    return (
        F.when(sufficient, "coverage sufficient").when(round_number >= most_rounds, "max rounds reached").when(queries >= most_queries, "query budget spent").when(sources >= most_sources, "source budget spent")
        .when((followups == 0) & (missing == 0), "no actionable gaps")
    )


def back_off(attempt: Column, retry_after: Column, most: float = 30.0) -> Column:
    """Seconds before the next attempt: what the provider asks for, else 1, 2, 4, ..., at most `most`."""
    return F.least(F.coalesce(retry_after.cast("double"), F.pow(F.lit(2.0), attempt - 1)), F.lit(most))
