"""From raw documents to token ids: toxic documents go, documents of low quality go, one document of each group of near-duplicates stays, sources are mixed to
their target weights, and what the mix takes is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Columns besides doc_id, text, lang, source
and n_chars pass through unread, whatever their names. Rows with null text are documents without words; an empty text is neither toxic nor a near-duplicate.
Texts of any length are read whole. Of repeated rows, and of rows with one doc_id, the near-duplicate stage keeps one; between copies the smaller doc_id stays.
Every stage turns an empty table into an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import bpe, mixing, near_dedup, quality, toxicity
from attestor.llm.common import scratch, written

OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _aside(docs: DataFrame) -> DataFrame:
    """docs with the columns that no stage knows under names that no operator uses."""
    return docs.toDF(*(c if c in OWN else f"extra_column_{i}" for i, c in enumerate(docs.columns)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _aside(docs)
    judged = toxicity.judged(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("not toxic").select(*rows.columns).toDF(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only labelled texts are described for the fit; all are in the pass that scores them."""
    rows = _aside(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    with scratch(spark) as keep:
        known = keep(labels.where("doc_id is not null and quality is not null").select("doc_id").distinct(), "labelled_ids")
        model = quality.fit(keep(quality.described(rows.join(near_dedup.bounded(known), "doc_id", "left_semi")), "document_stats"), labels)
    return quality.with_score(rows, model).where("score >= 0.5").select(*rows.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group; rows of one doc_id are one group, whatever their texts, and the one with the smallest hash of its text stays."""
    rows = _aside(docs)
    found = near_dedup.near_duplicates(rows, percent=80)
    lost = written(found.where("not kept").select("doc_id").distinct(), "lost_ids")
    again = written(found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated_ids")
    kept = rows.join(near_dedup.bounded(lost), "doc_id", "left_anti")
    if not again.isEmpty():
        whole, order = F.struct(*rows.columns), F.struct(F.xxhash64("text"), F.col("text"))
        one = kept.join(near_dedup.bounded(again), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, order).alias("row")).select("row.*")
        kept = kept.join(near_dedup.bounded(again), "doc_id", "left_anti").unionByName(one)
    return kept.select(*rows.columns).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix runs through a document; the last of a source may end inside one."""
    rows = _aside(docs)
    return mixing.mixed(rows).select(*rows.columns).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids: the token ids of every row."""
    return bpe.encoded(_aside(docs), bpe.tokenizer_path(spark), keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Model fitting, MinHash and byte-pair encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
