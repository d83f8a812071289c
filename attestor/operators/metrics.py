"""Metrics of runs, corpora and reviews: rates that say what they count, and checks that list what is wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators.measure import rate


def ratio_rows(one: DataFrame, metrics: Sequence[tuple[Column | str, str, str, bool]]) -> DataFrame:
    """A one-row table of counts as rows name, value, detail, higher_is_better for (name, part, whole, higher_is_better); over nothing the value is null."""
    def row(name: Column | str, part: str, whole: str, higher: bool) -> Column:
        n, d = F.col(part).cast("long"), F.col(whole).cast("long")
        label = F.lit(name) if isinstance(name, str) else name
        return F.struct(label.alias("name"), rate(n, d).alias("value"), F.concat(n.cast("string"), F.lit("/"), d.cast("string")).alias("detail"), F.lit(higher).alias("higher_is_better"))

    return one.select(F.explode(F.array(*(row(*m) for m in metrics))).alias("m")).select("m.*")


def joined_rows(*tables: DataFrame) -> DataFrame:
    """Tables of one row each side by side."""
    out = tables[0]
    for t in tables[1:]:
        for c in t.columns:
            out = out.withColumn(c, t.select(c).scalar())
    return out


def problems(one: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """The names of the checks that fail on a one-row table, in their order."""
    return one.select(F.explode(F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks)))).alias("problem"))


def key_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that one side lacks, with `side`: missing (on the right) or unexpected (there only)."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("unexpected")))


def sheet_faults(sheet: DataFrame, key: str, scores: Sequence[str], flag: str, known: DataFrame, low: int = 1, high: int = 5) -> DataFrame:
    """key and faults of the rows of a review sheet that have any: repeated id, unknown id, a score out of range, a flag that is neither yes nor no."""
    times = sheet.groupBy(key).agg(F.count(F.lit(1)).alias("_times"))
    rows = sheet.join(times, key, "left").join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    found = [F.when(F.col("_times") > 1, "repeated"), F.when(F.col("_known").isNull(), "unknown")]
    found += [F.when(~F.coalesce(F.col(s).between(low, high), F.lit(False)), F.lit(s)) for s in scores]
    found.append(F.when(~F.coalesce(F.lower(F.col(flag)).isin("yes", "no"), F.lit(False)), F.lit(flag)))
    return rows.select(key, F.array_compact(F.array(*found)).alias("faults")).where(F.size("faults") > 0)


def blinded_order(rows: DataFrame, key: Sequence[str], seed: str) -> DataFrame:
    """rows with random_id, a digest of seed and key: as good as random, the same in every run, and another for each reviewer's seed."""
    return rows.withColumn("random_id", F.left(F.sha2(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in key)), 256), F.lit(16)))


def means(rows: DataFrame, category: str, values: Sequence[str]) -> DataFrame:
    """Mean and number of each value by category, and over all (category null)."""
    long = rows.unpivot([category], list(values), "metric", "value").where("value is not null")
    return long.groupingSets([[F.col("metric")], [F.col(category), F.col("metric")]], category, "metric").agg(F.round(F.avg("value"), 4).alias("mean"), F.count("value").alias("n"))
