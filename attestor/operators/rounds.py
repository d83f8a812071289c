"""Bounded rounds over tables that resume: one committed folder a round, with the tables as they are after it and a line that says how it went.

A round's folder is written elsewhere and renamed, so rounds/<n> is whole or not there; a run that was stopped goes on after the last whole one, and of two runs that write one round the second takes what the first has left. Tables
grow by reducers: `append` keeps what is known and adds new keys, `latest` replaces by key, `sum` adds up by key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.sources import store

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Reducer:
    """How a table takes in what a round adds. key: its key columns; kind: append, latest (by the column `order`, the greatest) or sum (of all other columns)."""

    kind: str
    key: tuple[str, ...]
    order: str = ""

    def merged(self, known: DataFrame, new: DataFrame) -> DataFrame:
        new = new.select(*known.columns)
        key = list(self.key)
        if self.kind == "append":
            once = new.dropDuplicates(key)
            return known.unionByName(once.join(known.select(*key), key, "left_anti").select(*known.columns))
        if self.kind == "latest":
            rest = [c for c in known.columns if c not in key]
            rows = known.unionByName(new).groupBy(*key).agg(F.max_by(F.struct(*rest), self.order).alias("_last"))
            return rows.select(*key, *(F.col(f"_last.{c}").alias(c) for c in rest)).select(*known.columns)
        rest = [c for c in known.columns if c not in key]
        return known.unionByName(new).groupBy(*key).agg(*(F.sum(c).alias(c) for c in rest)).select(*known.columns)


class Rounds:
    """The committed rounds under one path of the shared store."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, path: str):  # noqa: ANN202  (a Hadoop path and its file system)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def last(self) -> int | None:
        """The number of the last whole round; None before the first."""
        at, files = self._files(f"{self.path}/rounds")
        return max((int(s.getPath().getName()) for s in files.listStatus(at)), default=None) if files.exists(at) else None

    def tables(self, number: int, names: list[str]) -> Tables:
        return {n: self.spark.read.parquet(f"{self.path}/rounds/{number}/{n}") for n in names}

    def manifest(self) -> DataFrame:
        """number, stop (why the run ended with it, null where it went on), rows of each table (a map)."""
        return self.spark.read.schema("number int, stop string, rows map<string,bigint>").parquet(*(f"{self.path}/rounds/{n}/manifest" for n in range((self.last() or 0) + 1)))

    def commit(self, number: int, tables: Tables, stop: Callable[[Tables], str | None]) -> None:
        own = f"{self.path}/unfinished/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{own}/{name}")
        written = {n: self.spark.read.parquet(f"{own}/{n}") for n in tables}
        rows = {n: df.count() for n, df in written.items()}
        self.spark.createDataFrame([(number, stop(written), rows)], "number int, stop string, rows map<string,bigint>").coalesce(1).write.parquet(f"{own}/manifest")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        to, files = self._files(f"{self.path}/rounds/{number}")
        files.mkdirs(to.getParent())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf).rename(self._files(own)[0], to, none)
        except Exception:
            if not files.exists(to):
                raise
            files.delete(self._files(own)[0], True)  # another run has committed this round


def run(spark: SparkSession, path: str, start: Callable[[], Tables], step: Callable[[int, Tables], Tables], reducers: dict[str, Reducer], stop: Callable[[int, Tables], str | None]) -> tuple[Tables, str]:
    """The tables after the last round and why it was the last.

    start: the tables before the first round. step(number, tables): what a round adds, by table. stop(number, tables): why no further round follows, or None; asked once for each round, and its answer is committed with it.
    """
    rounds = Rounds(spark, path)
    names = list(reducers)
    number = rounds.last()
    if number is None:
        rounds.commit(0, start(), lambda t: stop(0, t))
        number = 0
    while True:
        tables = rounds.tables(number, names)
        why = rounds.manifest().where(F.col("number") == number).first()["stop"]
        if why is not None:
            return tables, why
        new = step(number + 1, tables)
        after = {n: reducers[n].merged(tables[n], new[n]) if n in new else tables[n] for n in names}
        number += 1
        rounds.commit(number, after, lambda t, n=number: stop(n, t))


@dataclass(frozen=True)
class Limits:
    """The four stops of a research loop, in the order in which they count: enough covered, rounds, queries, sources, and nothing left to ask."""

    enough: int
    rounds: int
    queries: int
    sources: int


def research(spark: SparkSession, path: str, results: DataFrame, questions: DataFrame, limits: Limits, each: int) -> tuple[Tables, str]:
    """Rounds of search over recorded results (canonical_url, domain, sub_question_id, seq): a round asks, for each question that is covered by fewer than `enough` domains, for its next `each` results by seq, keeps new sources, and
    counts. Tables: sources (canonical_url, domain, sub_question_id, round), asked (sub_question_id, queries, taken), coverage (sub_question_id, domains, round)."""

    def covered(sources: DataFrame) -> DataFrame:
        domains = sources.select("sub_question_id", "domain").distinct().groupBy("sub_question_id").agg(F.count(F.lit(1)).alias("domains"))
        return questions.join(domains, "sub_question_id", "left").select("sub_question_id", F.coalesce("domains", F.lit(0)).cast("long").alias("domains"))

    def start() -> Tables:
        asked = questions.select("sub_question_id", F.lit(0).cast("long").alias("queries"), F.lit(0).cast("long").alias("taken"))
        none = results.limit(0).select("canonical_url", "domain", "sub_question_id", F.lit(0).alias("round"))
        return {"sources": none, "asked": asked, "coverage": covered(none).withColumn("round", F.lit(0))}

    def gaps(tables: Tables) -> DataFrame:
        left = results.groupBy("sub_question_id").agg(F.count(F.lit(1)).alias("there"))
        open_ = tables["coverage"].where(F.col("domains") < limits.enough).select("sub_question_id")
        return open_.join(tables["asked"], "sub_question_id").join(left, "sub_question_id").where("taken < there").select("sub_question_id", "taken")

    def step(number: int, tables: Tables) -> Tables:
        place = F.row_number().over(Window.partitionBy("sub_question_id").orderBy("seq", "canonical_url"))
        met = results.join(store.bounded(gaps(tables)), "sub_question_id")
        # The rows before a question's next ones are cut by a limit on the place, which tasks apply before they meet.
        new = met.withColumn("place", place).where(F.col("place") <= each * number).where((F.col("place") > F.col("taken")) & (F.col("place") <= F.col("taken") + each))
        new = new.select("canonical_url", "domain", "sub_question_id", F.lit(number).alias("round"), "taken")
        counts = new.groupBy("sub_question_id").agg(F.lit(1).cast("long").alias("queries"), F.count(F.lit(1)).alias("taken"))
        found = new.groupBy("canonical_url").agg(F.min(F.struct("sub_question_id", "domain", "round")).alias("r")).select("canonical_url", "r.domain", "r.sub_question_id", "r.round")
        sources = REDUCERS["sources"].merged(tables["sources"], found)
        return {"sources": found, "asked": counts, "coverage": covered(sources).withColumn("round", F.lit(number))}

    def stop(number: int, tables: Tables) -> str | None:
        if tables["coverage"].where(F.col("domains") < limits.enough).isEmpty():
            return "coverage sufficient"
        if number >= limits.rounds:
            return "max rounds reached"
        if (tables["asked"].agg(F.sum("queries").alias("n")).first()["n"] or 0) >= limits.queries:
            return "query budget spent"
        if tables["sources"].count() >= limits.sources:
            return "source budget spent"
        return "no actionable gaps" if gaps(tables).isEmpty() else None

    return run(spark, path, start, step, REDUCERS, stop)


REDUCERS = {"sources": Reducer("append", ("canonical_url",)), "asked": Reducer("sum", ("sub_question_id",)), "coverage": Reducer("latest", ("sub_question_id",), "round")}
