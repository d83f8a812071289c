"""Reservations against ceilings, cost of calls, and who a client is."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_fold(rows: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], start: Callable[[], Any], step: Callable[..., Any], into: str, kind: str) -> DataFrame:
    """key, the columns `order` and `into`: what step(state, *columns) gives for each row of a key in order. state is a mutable object made by start() for each key. Rows stream through the task that has their key; nothing of it is held but the state."""
    kinds = dict(rows.dtypes)
    kept = [key, *order]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for b in batches:
            out = []
            for k, *values in zip(b[key], *(b[c] for c in columns), strict=True):
                if state is None or k != last:
                    last, state = k, start()
                out.append(step(state, *values))
            yield b[kept].assign(**{into: out})

    dealt = rows.select(*kept, *(c for c in columns if c not in kept)).repartition(key).sortWithinPartitions(*kept)
    return dealt.mapInPandas(work, ", ".join(f"{c} {kinds[c]}" for c in kept) + f", {into} {kind}")


def reservations(requests: DataFrame, key: str, order: str, cost: str, ceiling: float) -> DataFrame:
    """key, order, granted: a request is granted if it fits under the ceiling beside those granted before; a refused one takes nothing. A key stands for one run or day."""

    def step(used: list[float], c: float) -> bool:
        fits = used[0] + c <= ceiling + 1e-9
        used[0] += c if fits else 0.0
        return fits

    return ordered_fold(requests, key, [order], [cost], lambda: [0.0], step, "granted", "boolean")


def first_refused(requests: DataFrame, key: str, order: str, ceilings: Mapping[str, float]) -> DataFrame:
    """key, order, refused: the first dimension whose ceiling a request would break beside those admitted before, in the order of `ceilings`; null if it is admitted. A refused request takes nothing of any dimension."""
    names = list(ceilings)

    def step(used: list[float], *wanted: float) -> str | None:
        for i, name in enumerate(names):
            if used[i] + wanted[i] > ceilings[name] + 1e-9:
                return name
        for i, w in enumerate(wanted):
            used[i] += w
        return None

    return ordered_fold(requests, key, [order], names, lambda: [0.0] * len(names), step, "refused", "string")


def settled(calls: DataFrame, key: str, order: str, reserved: str, actual: str) -> DataFrame:
    """By key: what was reserved and used, the balance that settling gives back (or takes), and how many calls broke their reservation."""
    over = F.col(actual) > F.col(reserved) + 1e-9
    return calls.groupBy(key).agg(
        F.count(order).alias("calls"), F.round(F.sum(reserved), 6).alias("reserved"), F.round(F.sum(actual), 6).alias("used"), F.round(F.sum(F.col(reserved) - F.col(actual)), 6).alias("given_back"),
        F.count_if(over).alias("breaches"), (F.sum(F.col(actual)) <= F.sum(F.col(reserved)) + 1e-9).alias("sufficient"),
    )


def at_most(configured: Column, ceiling: Column) -> Column:
    """The smaller of the two; 0 and null mean unset."""
    return F.when(F.coalesce(configured, F.lit(0)) <= 0, ceiling).otherwise(F.least(configured, ceiling))


def cost_display(cost: Column, unpriced: Column) -> Column:
    """The cost in dollars; why it is incomplete where calls have no price."""
    return F.when(cost.isNull(), "n/a").when(unpriced > 0, F.concat(F.lit(">= $"), F.format_string("%.4f", cost), F.lit(" ("), unpriced.cast("string"), F.lit(" unpriced)"))).otherwise(F.concat(F.lit("$"), F.format_string("%.4f", cost)))


def status_class(status: Column) -> Column:
    """The class of a provider's answer: ok, auth, rate_limited, bad_request, unavailable, failed."""
    return (
        F.when(status.between(200, 299), "ok").when(status.isin(401, 403), "auth").when(status.isin(429, 432, 433), "rate_limited").when(status.between(400, 499), "bad_request").when(status >= 500, "unavailable").otherwise("failed")
    )


def public_reason(error: Column) -> Column:
    """What a reader may be told of a failure."""
    low = F.lower(F.coalesce(error, F.lit("")))
    return F.when(low == "", "").when(is_rate_limit(error), "the provider refused more calls").when(low.rlike("time.?out|deadline"), "a call took too long").when(low.rlike("quota|budget|ceiling"), "a limit was reached").otherwise("an internal error")


def call_cost(input_tokens: Column, output_tokens: Column, cached: Column, cache_write: Column, price_in: float, price_out: float, price_cached: float | None, price_write: float | None) -> tuple[Column, Column]:
    """(cost in dollars, whether it is complete): cached and written tokens are part of the input and have prices of their own; where one is missing, they count at the input price and the cost is incomplete."""
    hit, put = F.coalesce(cached, F.lit(0)), F.coalesce(cache_write, F.lit(0))
    plain = F.greatest(input_tokens - hit - put, F.lit(0))
    total = plain * price_in + output_tokens * price_out + hit * (price_in if price_cached is None else price_cached) + put * (price_in if price_write is None else price_write)
    complete = ((hit == 0) | F.lit(price_cached is not None)) & ((put == 0) | F.lit(price_write is not None)) & (hit + put <= input_tokens)
    return F.round(total / 1e6, 8), complete


def client_key(peer: Column, forwarded: Column, trusted_hops: int) -> Column:
    """The address that the last trusted proxy saw: the entry trusted_hops from the right of the header. Without trusted proxies, with too few entries or something that is no IPv4 address: the peer."""
    entries = F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda x: F.trim(x))
    picked = F.try_element_at(entries, F.lit(-trusted_hops)) if trusted_hops > 0 else F.lit(None).cast("string")
    return F.when(F.coalesce(picked.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.lit(False)), picked).otherwise(peer)


def runs_affordable(quota: Column, worst_case: Column) -> Column:
    """Whole runs that a daily quota pays for; 0 if none or if the worst case is unknown."""
    return F.when((worst_case > 0) & (quota >= worst_case), F.floor(quota / worst_case)).otherwise(0).cast("long")


def is_rate_limit(error: Column) -> Column:
    return F.coalesce(F.lower(error).rlike(r"(rate.?limit|too many requests|\b429\b|quota exceeded|resource.?exhausted)"), F.lit(False))


def leaks(rows: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key and the forbidden terms that a text holds, for rows that hold any."""
    found = F.array_compact(F.array(*(F.when(F.lower(F.col(text)).contains(t.lower()), F.lit(t)) for t in terms)))
    return rows.select(key, found.alias("found")).where(F.size("found") > 0)
