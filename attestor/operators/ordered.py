"""Work in the order of a key within groups of any size: running sums and as-of lookups without a window over a whole group.

The order's range is cut at quantiles, so that each cut holds about the same number of rows. Windows run inside one cut of one group; a summary of a row for each group and cut, CUTS rows a group
at most, gives every cut what the ones before have left. Rows of one group with the same order stay in one cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = 64


def cut_points(df: DataFrame, order: str, cuts: int = CUTS) -> list[float]:
    """Values that cut the rows into `cuts` parts of about equal size, from a sketch of the column (null order is left out)."""
    if cuts < 2:
        return []
    found = df.agg(F.percentile_approx(F.col(order).cast("double"), F.array(*(F.lit(i / cuts) for i in range(1, cuts))), F.lit(4 * cuts)).alias("p")).first()
    return sorted(set(found["p"] or []))


def cut_of(order: Column, points: list[float]) -> Column:
    """The number of the cut that a value lies in; null stands before all."""
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, points)), lambda x: x <= order.cast("double"))), F.lit(-1)) if points else F.lit(0)


def running_sums(df: DataFrame, by: list[str], order: str, ties: list[str], sums: dict[str, Column], cuts: int = CUTS) -> DataFrame:
    """df with, for each name, the sum of a column over the rows of the same group up to and with this one, by order and ties (together unique within a group). Null sums as 0. df is read three times: give it written or cheap."""
    points = cut_points(df, order, cuts)
    rows = df.withColumn("_cut", cut_of(F.col(order), points))
    keys = [*by, "_cut"]
    total = rows.groupBy(*keys).agg(*(F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()))
    before = Window.partitionBy(*by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = total.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_from_{n}") for n in sums))
    met = rows.join(starts, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    inside = Window.partitionBy(*keys).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    made = {n: F.col(f"_from_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}
    return met.select(*(c for c in df.columns if c not in sums), *(c.alias(n) for n, c in made.items()))


def as_of(points: DataFrame, starts: DataFrame, by: list[str], at: str, start: str, take: list[str], cuts: int = CUTS) -> DataFrame:
    """points with the columns `take` of the last row of starts, in the same group, whose `start` is at most `at`; null where there is none, and for null `at`. Of equal starts the one with the greatest `take` counts.

    Points and starts are laid in one order, a start before a point of the same place, and the last start is carried forward inside each cut; points before a cut's first start get the last one of an earlier cut."""
    value = F.struct(F.col(start).alias("_s"), *take)
    known = starts.where(F.col(start).isNotNull()).select(*by, F.col(start).cast("double").alias("_at"), value.alias("_start"), F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("_point"))
    asked = points.select(*by, F.col(at).cast("double").alias("_at"), F.lit(None).cast(known.schema["_start"].dataType).alias("_start"), F.struct("*").alias("_point"))
    both = known.unionByName(asked)
    rows = both.withColumn("_cut", cut_of(F.col("_at"), cut_points(both, "_at", cuts)))
    last = rows.where("_start is not null").groupBy(*by, "_cut").agg(F.max("_start").alias("_last"))
    every = rows.select(*by, "_cut").distinct().join(last, [*by, "_cut"], "left")
    before = Window.partitionBy(*by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*by, "_cut", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    inside = Window.partitionBy(*by, "_cut").orderBy(F.col("_at").asc_nulls_first(), F.col("_point").isNotNull(), "_start")
    met = rows.withColumn("_here", F.last("_start", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))).where("_point is not null").join(carried, [*by, "_cut"], "left")
    found = F.when(F.col("_at").isNotNull(), F.coalesce("_here", "_before"))
    return met.select("_point.*", *(found[c].alias(c) for c in take))
