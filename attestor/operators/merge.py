"""How tables that several writers fill are merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(writes: DataFrame, key: str, order: str) -> DataFrame:
    """The last write of each key, with first_seen, the order of its first."""
    rest = [c for c in writes.columns if c not in (key, order)]
    rows = writes.groupBy(key).agg(F.min(order).alias("first_seen"), F.max_by(F.struct(*rest), order).alias("_last"))
    return rows.select(key, "first_seen", *(F.col(f"_last.{c}").alias(c) for c in rest))


def appended(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """existing and those incoming rows whose key isn't there yet."""
    return existing.unionByName(incoming.join(existing.select(key), key, "left_anti").select(*existing.columns))


def summed(counters: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """A map of name to sum for each key."""
    per = counters.groupBy(key, name).agg(F.sum(value).alias("v"))
    return per.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name), F.col("v"))))).alias("counters"))


def drift(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ, or that stand on one side only."""
    e, a = expected.select(key, F.col(value).alias("expected")), actual.select(key, F.col(value).alias("actual"))
    return e.join(a, key, "full").where(~F.col("expected").eqNullSafe(F.col("actual")))


def table_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a hash that doesn't depend on row order. Row hashes are sorted and hashed inside the 16**6 groups of their first six digits, these groups' hashes inside the 16**3 of their first three, and those at the end: a task holds some thousands at 10**11 rows."""
    h = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    level = rows.select(h.alias("g"), h.alias("gh"), F.lit(1).cast("long").alias("n"))
    for digits in (6, 3, 0):
        ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "gh"))), lambda x: x["gh"]), "")
        level = level.groupBy(F.left("g", F.lit(digits)).alias("p")).agg(F.sha2(ordered, 256).alias("gh"), F.sum("n").alias("n")).select(F.col("p").alias("g"), "gh", "n")
    return level.select(F.col("n").alias("rows"), F.col("gh").alias("hash"))
