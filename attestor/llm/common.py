"""What the operators of this folder share: the folder for intermediate tables, tables written there, and ordered prefix sums without a window over a whole group."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets that a group's key space is cut into for prefix sums.
BUCKET_BITS = 12


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset: a temporary folder in local mode, else a folder of the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.startswith("local["):
            named = "file://" + tempfile.mkdtemp(prefix="attestor-")
        else:
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_attestor"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """While it lasts, at most `rows` rows go to a Python worker at once, so that texts of some kilobytes each take a few megabytes there and in the JVM's buffers. The session's setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/attestor/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read back with the same schema."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A function like `written` whose tables lie in one folder, which is deleted at the end. What is returned to the outside must be written with `written`."""
    base = f"{shared_dir(spark)}/attestor/{uuid.uuid4().hex}"
    made = 0

    def keep(df: DataFrame, name: str) -> DataFrame:
        nonlocal made
        made += 1
        path = f"{base}/{made:03d}_{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        remove(spark, base)


def prefix_sums(df: DataFrame, group: list[str], key: str, ties: list[Column], weight: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of weight over the rows of the same group that stand before this one, by key (a long) and then ties.

    The key space is cut into 2**BUCKET_BITS ranges. The sums of (group, range) are small and give each range its start; the window runs inside one
    range of one group only, so a group that holds a third of all rows is spread over as many tasks as there are ranges. df is read twice: give it
    written or cheap. Columns of group must not be null. A column of df named `out` is replaced; helper columns have names that df lacks.
    """
    cut_name, weight_name, start, total = (free_name(df, n) for n in ("range", "weight", "range_start", "sum"))
    cut = [*group, cut_name]
    rows = df.withColumn(cut_name, F.shiftright(F.col(key), 64 - BUCKET_BITS)).withColumn(weight_name, weight)
    before = Window.partitionBy(*group).orderBy(cut_name).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*cut).agg(F.sum(weight_name).alias(total)).select(*cut, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(*cut).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(starts, cut).withColumn(out, F.col(start) + F.coalesce(F.sum(weight_name).over(inside), F.lit(0))).drop(cut_name, weight_name, start)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `_name` that df doesn't have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    out = "_" + name
    while out.lower() in taken:
        out = "_" + out
    return out


def passing(columns: Iterable[str], new: Iterable[str]) -> list[str]:
    """The columns that stay beside the new ones: those that no new one is named like, whatever the case of letters."""
    taken = {c.lower() for c in new}
    return [c for c in columns if c.lower() not in taken]
