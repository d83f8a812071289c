"""Calibration, A/B comparison, metrics, ledgers and quotas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.operators import ordered
from attestor.sources import store


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp with or without zone, in UTC."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def rounded(x: Column, digits: int) -> Column:
    """x to some digits as the SQL engine does it: scaled first, then to the nearest whole. F.round goes by the shortest decimal that x prints as, so 0.49 * 0.15 = 0.0735 may come out otherwise."""
    return F.round(x * 10**digits) / 10**digits


def rate(part: Column, whole: Column, empty: float | None = None) -> Column:
    """part / whole to 4 digits; over nothing: `empty`, or null."""
    out = rounded(F.try_divide(part, whole), 4)
    return out if empty is None else F.coalesce(out, F.lit(empty))


def confusion(cases: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, agreement, precision, recall."""
    c = cases.select(F.coalesce(predicted, F.lit(False)).alias("p"), F.coalesce(actual, F.lit(False)).alias("a"))
    out = c.agg(F.count_if(F.expr("p and a")).alias("tp"), F.count_if(F.expr("p and not a")).alias("fp"), F.count_if(F.expr("not p and a")).alias("fn"), F.count_if(F.expr("not p and not a")).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return out.select("*", rate(tp + tn, tp + fp + fn + tn).alias("agreement"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"))


def sweep(cases: DataFrame, low: int = 50, high: int = 99) -> DataFrame:
    """tp, fp, fn, tn at thresholds low..high hundredths, from counts by hundredth: cases are read once and never multiplied. cases: score, guards_passed, supported."""
    step = F.when(F.col("guards_passed"), F.least(F.greatest(F.floor(F.round(F.col("score") * 100, 6)), F.lit(low - 1)), F.lit(high))).otherwise(F.lit(low - 1)).cast("int")
    counts = cases.groupBy(step.alias("step")).agg(F.count_if(F.expr("supported")).alias("pos"), F.count_if(F.expr("not supported")).alias("neg"))
    spark = cases.sparkSession
    grid = spark.range(low - 1, high + 1).select(F.col("id").cast("int").alias("step")).join(counts, "step", "left").fillna(0)
    below = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = grid.select("step", F.coalesce(F.sum("pos").over(below), F.lit(0)).alias("fn"), F.coalesce(F.sum("neg").over(below), F.lit(0)).alias("tn"), F.sum("pos").over(whole).alias("allpos"), F.sum("neg").over(whole).alias("allneg"))
    return out.where(F.col("step") >= low).select((F.col("step") / 100).alias("threshold"), (F.col("allpos") - F.col("fn")).alias("tp"), (F.col("allneg") - F.col("tn")).alias("fp"), "fn", "tn")


def chosen_threshold(swept: DataFrame) -> DataFrame:
    """The threshold without false positives and with most true ones, the highest of equals."""
    return swept.where("fp = 0").orderBy(F.col("tp").desc(), F.col("threshold").desc()).limit(1)


def paired(runs: DataFrame, arms: tuple[str, str] = ("cloud", "local")) -> DataFrame:
    """question_id, repetition, arms, and whether both arms have a good run."""
    good = runs.where("ok").groupBy("question_id", "repetition").agg(F.array_sort(F.collect_set("arm")).alias("arms"))
    return good.withColumn("is_paired", F.col("arms") == F.array(*(F.lit(a) for a in sorted(arms))))


def paired_means(runs: DataFrame, dimensions: list[str]) -> DataFrame:
    """Mean of each dimension by arm over paired and unpaired repetitions."""
    both = paired(runs).select("question_id", "repetition", "is_paired")
    long = runs.where("ok").join(both, ["question_id", "repetition"]).unpivot(["is_paired", "arm"], dimensions, "dimension", "value")
    return long.groupBy("is_paired", "arm", "dimension").agg(F.round(F.avg("value"), 4).alias("mean"), F.count("value").alias("n"))


def priced(attempts: DataFrame, prices: Mapping[str, tuple[float, float]]) -> DataFrame:
    """attempts with the price of the longest model name that begins theirs (`*` fits all) and the cost in dollars. The price list is a parameter, held in the plan."""
    found_in, found_out, name = F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("string")
    for prefix in sorted(prices, key=len):
        fits = F.lit(True) if prefix == "*" else F.col("model").startswith(prefix)
        found_in = F.when(fits, prices[prefix][0]).otherwise(found_in)
        found_out = F.when(fits, prices[prefix][1]).otherwise(found_out)
        name = F.when(fits, prefix).otherwise(name)
    rows = attempts.withColumn("price_of", name)
    return rows.withColumn("cost", F.round((F.col("input_tokens") * found_in + F.col("output_tokens") * found_out) / 1e6, 8))


def usage(attempts: DataFrame) -> DataFrame:
    """Totals by role: calls, outcomes, tokens, cost and calls without a price."""
    return attempts.groupBy("role").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.expr("status = 'ok'")).alias("ok"), F.count_if(F.expr("status = 'rate_limited'")).alias("rate_limited"), F.count_if(F.expr("status = 'error'")).alias("errors"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 8).alias("cost"), F.count_if(F.expr("cost is null")).alias("unpriced"),
    )


def ledger(rows: DataFrame, key: str, order: str, cost: str, ceiling: float) -> DataFrame:
    """Running sum of cost inside each key, headroom before the row, and whether the row still fits. The order is a number, unique within a key; a key's rows are summed in ranges of it."""
    total = F.round("cumulative", 8)
    summed = ordered.running_sums(store.written(rows, "ledger"), [key], order, [], {"cumulative": F.col(cost)})
    return summed.withColumn("cumulative", total).withColumn("headroom", F.round(F.lit(ceiling) - (total - F.col(cost)), 8)).withColumn("fits", total <= ceiling)


def daily_quota(events: DataFrame, limit: int) -> DataFrame:
    """Admits the first `limit` events of each UTC day, by time and id: the day's rows are cut to the limit before they meet (the rest are refused by an anti join's other side)."""
    day = events.withColumn("day", F.to_date("ts"))
    w = Window.partitionBy("day").orderBy("ts", "event_id")
    first = day.select("event_id", "day", "ts").withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("event_id", "place")
    return day.select("event_id", "day").join(first, "event_id", "left").withColumn("admitted", F.col("place").isNotNull()).drop("place")


def rolling_hour(events: DataFrame, limit: int) -> DataFrame:
    """Events of the same user in the hour up to each event, and whether they are within the limit. Refused events count here; the stateful form in streaming leaves them out."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return events.withColumn("in_hour", F.count(F.lit(1)).over(w)).withColumn("within", F.col("in_hour") <= limit)


def sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """user_id, session number from 1, start, end, events: a gap longer than gap_seconds ends a session."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce((seconds(F.col("ts")) - F.lag(seconds(F.col("ts"))).over(w)) > gap_seconds, F.lit(True))
    rows = events.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("events"))
