"""Admission with release over a stream, and rows on silence: stateful processors with maps and timers.

Both need the RocksDB state store (`with_rocksdb`). Rows of one key are taken in the order of time and id within a micro-batch, and batches in their order, so what comes later than a batch that is done counts from then on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

REQUESTS = "event_id long, ts double, instance string, client string, run string, kind string"
DECISIONS = "instance string, event_id long, run string, kind string, outcome string, retry_after double, active int"
BEATS = "run string, kind string, event_id long, at_ms long"
#: Admissions of a client within an hour, runs of an instance at once, what a caller of a full instance is told to wait, the least wait of a client over its limit.
PER_HOUR, AT_ONCE, BUSY_WAIT, LEAST_WAIT, HOUR = 10, 2, 60.0, 60.0, 3600.0


def with_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def refusal(active: int, stamps: list[float], at: float, per_hour: int, at_once: int) -> tuple[str, float]:
    """('admitted', 0) or why not, with the seconds to wait. stamps: when the client's admissions within the hour were, ascending."""
    if active >= at_once:
        return "instance busy", BUSY_WAIT
    if len(stamps) >= per_hour:
        return "client limit", max(LEAST_WAIT, float(int(HOUR - (at - stamps[0])) + 1))
    return "admitted", 0.0


class Admissions(StatefulProcessor):
    """One instance. Held runs are a map from the run to its client and time; the times of a client's admissions a map from the client. A release frees the run's slot; `give_back` also takes the admission off the client's hour. A run that
    isn't held, because it never was, was refused or has been released, frees nothing. A slot that is held longer than the lease is free again."""

    def __init__(self, per_hour: int, at_once: int, lease: float) -> None:
        self.per_hour, self.at_once, self.lease = per_hour, at_once, lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "run string", "client string, ts double")
        self.stamps = handle.getMapState("stamps", "client string", "ts array<double>")

    def times_of(self, client: str, at: float) -> list[float]:
        own = list(self.stamps.getValue((client,))[0]) if self.stamps.containsKey((client,)) else []
        return [t for t in own if t > at - HOUR]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        held = {run[0]: (client, ts) for run, (client, ts) in self.held.iterator()}
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples(index=False):
            for run in [x for x, (_, ts) in held.items() if ts <= r.ts - self.lease]:
                del held[run]
                self.held.removeKey((run,))
            wait = 0.0
            if r.kind == "request":
                times = self.times_of(r.client, r.ts)
                outcome, wait = ("held already", 0.0) if r.run in held else refusal(len(held), times, r.ts, self.per_hour, self.at_once)
                if outcome == "admitted":
                    held[r.run] = (r.client, r.ts)
                    self.held.updateValue((r.run,), (r.client, r.ts))
                    self.stamps.updateValue((r.client,), ([*times, r.ts],))
            elif r.run in held:
                client, ts = held.pop(r.run)
                self.held.removeKey((r.run,))
                outcome = "released"
                if r.kind == "give_back":
                    times = self.times_of(client, r.ts)
                    if ts in times:
                        times.remove(ts)
                        self.stamps.updateValue((client,), (times,))
                    outcome = "given back"
            else:
                outcome = "not held"
            out.append((key[0], r.event_id, r.run, r.kind, outcome, wait, len(held)))
        for client, (ts,) in list(self.stamps.iterator()):  # clients whose hour is over leave the state
            if not ts or max(ts) <= r.ts - HOUR:
                self.stamps.removeKey(client)
        yield pd.DataFrame(out, columns=["instance", "event_id", "run", "kind", "outcome", "retry_after", "active"])

    def close(self) -> None:
        pass


def admissions(requests: DataFrame, per_hour: int = PER_HOUR, at_once: int = AT_ONCE, lease: float = HOUR) -> DataFrame:
    """requests (REQUESTS; kind: request, release or give_back) with the outcome of each, DECISIONS. An instance is one key, for its slots are shared; its state is at most `at_once` runs and `per_hour` times for each client of the hour."""
    return requests.groupBy("instance").transformWithStateInPandas(Admissions(per_hour, at_once, lease), DECISIONS, "Append", "None")


class Beats(StatefulProcessor):
    """Passes the events of a run on; after `silence` ms without one it says `heartbeat`, again and again, and `deadline` once the run is `limit` ms old, after which the run is over: later events of it are dropped. An event of the kind `result`
    ends the run."""

    def __init__(self, silence: int, limit: int) -> None:
        self.silence, self.limit = silence, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.began = handle.getValueState("began", "ms long")
        self.over = handle.getValueState("over", "flag boolean")

    def next_timer(self, now: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(min(now + self.silence, self.began.get()[0] + self.limit))

    def finish(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.began.clear()
        self.over.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        now = timerValues.getCurrentProcessingTimeInMs()
        out = []
        for r in pd.concat(list(rows)).sort_values("event_id").itertuples(index=False):
            if self.over.exists():
                break
            if not self.began.exists():
                self.began.update((now,))
            out.append((key[0], r.kind, r.event_id, now))
            if r.kind == "result":
                self.finish()
        if self.began.exists():
            self.next_timer(now)
        yield pd.DataFrame(out, columns=["run", "kind", "event_id", "at_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        now = timerValues.getCurrentProcessingTimeInMs()
        kind = "deadline" if now >= self.began.get()[0] + self.limit else "heartbeat"
        if kind == "deadline":
            self.finish()
        else:
            self.next_timer(now)
        yield pd.DataFrame([(key[0], kind, None, now)], columns=["run", "kind", "event_id", "at_ms"]).astype({"event_id": "Int64"})

    def close(self) -> None:
        pass


def beats(events: DataFrame, silence: int = 15_000, limit: int = 600_000) -> DataFrame:
    """events (run, event_id, kind) with heartbeats and deadlines where nothing comes: BEATS."""
    return events.select("run", "event_id", "kind").groupBy("run").transformWithStateInPandas(Beats(silence, limit), BEATS, "Append", "ProcessingTime")


def request_columns(events: DataFrame) -> DataFrame:
    """Events (event_id, ts, user_id, event_type) as requests and releases of runs: a run is asked for by an event with an even id, and the next id is its end, now as a release, now given back, now never."""
    n = F.col("event_id")
    kind = F.when(n % 2 == 0, "request").when(n % 7 == 1, "give_back").otherwise("release")
    return events.select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.concat(F.lit("i"), (F.col("user_id") % 5).cast("string")).alias("instance"), F.concat(F.lit("c"), (F.col("user_id") % 20).cast("string")).alias("client"), F.concat(F.lit("r"), F.floor(n / 2).cast("string")).alias("run"), kind.alias("kind"))
