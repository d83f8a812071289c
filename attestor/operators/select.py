"""Values of given ranks, exact, by counts over ranges that close in on them: no group's values ever meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.sources import store

#: Ranges that each round cuts what is left into.
PARTS = 1024


def at_ranks(rows: DataFrame, by: str, value: str, ranks: DataFrame) -> DataFrame:
    """by, rank, value: the value (a whole number) of each asked rank, from 0, of the ascending values of its group. ranks: by, rank, within the group's size. Null values take no part.

    Each round counts the rows of the range that holds the rank in PARTS parts, and the part with the rank is the next range; the range of 64 bits is done after seven rounds at most, rows are read once a round, and PARTS rows for
    each asked rank are all that meets.
    """
    values = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).cast("decimal(20,0)").alias("v"))
    ends = values.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    asked = ranks.select(F.col(by).alias("g"), F.col("rank").alias("asked")).distinct().join(ends, "g").select("g", "asked", F.col("asked").cast("long").alias("rank"), "low", "high")
    while True:
        asked = store.written(asked, "ranges")
        if asked.where("low < high").isEmpty():
            return asked.select(F.col("g").alias(by), F.col("asked").alias("rank"), F.col("low").cast("long").alias("value"))
        width = F.ceil((F.col("high") - F.col("low") + 1) / PARTS).cast("decimal(20,0)")
        met = values.join(store.bounded(asked), "g").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        part = F.floor((F.col("v") - F.col("low")) / width).cast("int")
        counts = met.groupBy("g", "asked", "rank", "low", "high", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("g", "asked").orderBy("part")))
        here = upto.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        start = (F.col("low") + F.col("part") * width).cast("decimal(20,0)")
        asked = here.select("g", "asked", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), start.alias("low"), F.least(F.col("high"), (start + width - 1).cast("decimal(20,0)")).alias("high"))


def medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, median (double) of each group's whole numbers: the mean of the two middle ones of an even number. Groups of nulls have none; a null group has none."""
    sizes = rows.where(F.col(value).isNotNull() & F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    middle = sizes.select(by, F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2).cast("long"), F.floor(F.col("n") / 2).cast("long")))).alias("rank"))
    found = at_ranks(rows, by, value, middle)
    return found.groupBy(by).agg((F.sum(F.col("value").cast("decimal(20,0)")).cast("decimal(24,1)") / F.count(F.lit(1))).cast("double").alias("median"))
