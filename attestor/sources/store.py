"""Tables written on the way, in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset: a temporary folder in local mode, else a folder of the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.startswith("local["):
        named = "file://" + tempfile.mkdtemp(prefix="attestor-")
        spark.conf.set("spark.checkpoint.dir", named)
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_attestor").rstrip("/")


#: Rows of a table of ids and numbers that is broadcast at most.
BROADCAST_ROWS = 500_000


def bounded(small: DataFrame) -> DataFrame:
    """small (ids and numbers) for a broadcast if it has few rows, else as it is."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/attestor/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table there, read back with its schema: computed once, however often it is used."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
