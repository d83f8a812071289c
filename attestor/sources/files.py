"""Files of runs: snapshots of corpora, artifacts without source texts, review sheets, checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a served result may hold, by table; other columns are never written.
PUBLIC = {"sources": ("source_id", "domain", "title", "word_count", "quality"), "evidence": ("evidence_id", "source_id", "sub_question_id", "quote", "quote_match"), "claims": ("claim_id", "text", "kind", "placement", "evidence_ids")}


def save_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Each table under its name; a snapshot that is there already is not touched."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def load_snapshot(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def public_columns(df: DataFrame, name: str) -> DataFrame:
    """The columns of a table that may be served, in the list's order."""
    return df.select(*(c for c in PUBLIC[name] if c in df.columns))


def write_artifacts(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """The public columns of each table as JSON, under its name and the run's id."""
    for name, df in tables.items():
        public_columns(df, name).withColumn("run_id", F.lit(run_id)).write.mode("overwrite").partitionBy("run_id").json(f"{path}/{name}")


def review_sheet(spark: SparkSession, path: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of a review sheet in CSV with a header, keys that stand there more than once)."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows, rows.groupBy(key).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, sha256 of the files of a folder. Files are read whole, one by one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def checksum_lines(sums: DataFrame) -> DataFrame:
    """Lines of a checksums file, in the order of names."""
    return sums.orderBy("name").select(F.concat("sha256", F.lit("  "), "name").alias("line"))
