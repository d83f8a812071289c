"""Operator 6: token counts as rollups that signed deltas maintain.

A batch of changes is turned into signed rows (an insert adds a document and its tokens, a delete takes both away, a revised count takes the old and adds the new),
summed by source, language and tokenizer version before and after the shuffle, and written as one delta under the batch's id. Totals are the sum of the
deltas, so the order of batches doesn't matter. A batch id counts once: a delta is written aside and renamed to its id, which fails where the id exists; what a lost
job left aside is read by nobody. (On a store without atomic rename, one writer a batch id is required.) compact() folds the deltas of many batches into one and remembers their ids; a delta goes away one compaction later.

Cases: null source, language and version are groups of their own; null counts are 0; an unknown or null op is an error; an empty batch is committed
without rows; totals of nothing are an empty table; groups whose documents and tokens are both 0 are left out of totals; columns of the feed that the operator doesn't name are ignored, and token_counts replaces none; repeated rows and ties are documents of their own; texts of any length are counted whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm.bpe import encoded, tokenizer_path
from attestor.llm.common import fresh_path, remove, scratch
from attestor.llm.mixing import word_count

GROUP = ("source", "lang", "tokenizer_version")
DELTA = T.StructType([*(T.StructField(c, T.StringType()) for c in GROUP), T.StructField("documents", T.LongType()), T.StructField("tokens", T.LongType())])
FEED = ("op", *GROUP, "tokens", "old_source", "old_lang", "old_tokenizer_version", "old_tokens")


def signed(changes: DataFrame) -> DataFrame:
    """changes: op (insert, delete, revise), the group and tokens of the new state, and the same with old_ in front. The signed rows of DELTA."""

    def side(sign: int, prefix: str) -> Column:
        parts = [F.col(prefix + c).cast("string").alias(c) for c in GROUP]
        return F.struct(*parts, F.lit(sign).cast("long").alias("documents"), (F.lit(sign) * F.coalesce(F.col(prefix + "tokens"), F.lit(0))).cast("long").alias("tokens"))

    plus, minus = side(1, ""), side(-1, "old_")
    rows = F.when(F.col("op") == "insert", F.array(plus)).when(F.col("op") == "delete", F.array(minus)).when(F.col("op") == "revise", F.array(plus, minus))
    checked = F.coalesce(rows, F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
    return changes.select(F.explode(checked).alias("r")).select("r.*")


def inserts(counts: DataFrame) -> DataFrame:
    """counts (GROUP, tokens) as a feed of inserts."""
    old = [F.lit(None).cast("string").alias("old_" + c) for c in GROUP]
    return counts.select(F.lit("insert").alias("op"), *GROUP, "tokens", *old, F.lit(None).cast("long").alias("old_tokens"))


def changes_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """The feed that leads from the counts `before` to `after`: both doc_id, GROUP, tokens, with one row for a document and version. Unchanged documents are left out."""
    a = after.select(F.col("doc_id").alias("_a"), *GROUP, F.col("tokens").cast("long").alias("tokens"), F.lit(True).alias("_new"))
    b = before.select(F.col("doc_id").alias("_b"), *(F.col(c).alias("old_" + c) for c in GROUP), F.col("tokens").cast("long").alias("old_tokens"), F.lit(True).alias("_old"))
    met = a.join(b, F.col("_a").eqNullSafe(F.col("_b")) & F.col("tokenizer_version").eqNullSafe(F.col("old_tokenizer_version")), "full")
    same = F.col("_new").isNotNull() & F.col("_old").isNotNull()
    for c in ("source", "lang", "tokens"):
        same = same & F.col(c).eqNullSafe(F.col("old_" + c))
    op = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").otherwise("revise")
    return met.where(~same).select(op.alias("op"), *FEED[1:])


class Rollup:
    """The deltas under one path of the shared store: deltas/<batch> and compacted/<number>/{sums, ids}. A folder under one of these names is whole, for it is written elsewhere and renamed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):  # noqa: ANN202  (a Hadoop path and its file system)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[str]:
        at, files = self._at(path)
        return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []

    def _rename(self, source: str, target: str) -> bool:
        """False if the target exists: of two writers of one batch, one wins."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        to, files = self._at(target)
        files.mkdirs(to.getParent())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf).rename(self._at(source)[0], to, none)
        except Exception:
            if not files.exists(to):
                raise
            return False
        return True

    def _folded(self, number: int | None = None) -> int:
        """The newest compaction, or the one asked for; 0: none."""
        return max((int(n) for n in self._list(f"{self.path}/compacted")), default=0) if number is None else number

    def _ids(self, number: int) -> DataFrame:
        """The ids of the batches in a compaction: a table, for they only ever grow."""
        return self.spark.read.schema("id string").parquet(f"{self.path}/compacted/{number}/ids") if number else self.spark.createDataFrame([], "id string")

    def _among(self, number: int, names: list[str]) -> set[str]:
        """Which of some names are in a compaction."""
        if not number or not names:
            return set()
        asked = self.spark.createDataFrame([(n,) for n in names], "id string")
        return {r["id"] for r in self._ids(number).join(F.broadcast(asked), "id", "left_semi").distinct().collect()}

    def batches(self) -> DataFrame:
        """id of every batch."""
        deltas = self._list(f"{self.path}/deltas")  # before the compaction is looked up: what has left the list since is in it
        return self._ids(self._folded()).unionByName(self.spark.createDataFrame([(n,) for n in deltas], "id string")).distinct()

    def has(self, batch: str) -> bool:
        at, files = self._at(f"{self.path}/deltas/{batch}")
        return files.exists(at) or bool(self._among(self._folded(), [batch]))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds the batch; False if it is there already. Ids: letters, digits, `-`, `_` and `.`."""
        if not batch or not all(c.isalnum() or c in "-_." for c in batch) or batch[0] in "._":
            raise ValueError(f"bad batch id {batch!r}")
        if self.has(batch):
            return False
        sums = signed(changes).groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        own = f"{self.path}/unfinished/{uuid.uuid4().hex}"
        sums.write.parquet(own)
        if self._rename(own, f"{self.path}/deltas/{batch}"):
            return True
        remove(self.spark, own)
        return False

    def _totals(self, folded: int, deltas: list[str]) -> DataFrame:
        """The compaction and those of the listed deltas that are not in it."""
        ids = self._among(folded, deltas)
        paths = [f"{self.path}/deltas/{n}" for n in deltas if n not in ids] + ([f"{self.path}/compacted/{folded}/sums"] if folded else [])
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        sums = rows.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        deltas = self._list(f"{self.path}/deltas")  # before the compaction is looked up: what has left the list since is in it
        return self._totals(self._folded(), deltas)

    def compact(self) -> None:
        """Folds the deltas listed at the start, and no others, into one table with their ids. The deltas of the compaction before, and older compactions, are removed; readers have had a whole generation to finish."""
        deltas = self._list(f"{self.path}/deltas")
        folded = self._folded()
        ids = self._among(folded, deltas)
        new = [n for n in deltas if n not in ids]
        if not new:
            return
        own = f"{self.path}/unfinished/{uuid.uuid4().hex}"
        self._totals(folded, deltas).write.parquet(f"{own}/sums")
        self._ids(folded).unionByName(self.spark.createDataFrame([(n,) for n in new], "id string")).write.parquet(f"{own}/ids")
        if not self._rename(own, f"{self.path}/compacted/{folded + 1}"):
            return remove(self.spark, own)  # another has compacted meanwhile
        for n in ids:
            remove(self.spark, f"{self.path}/deltas/{n}")
        for n in self._list(f"{self.path}/compacted"):
            if int(n) < folded:
                remove(self.spark, f"{self.path}/compacted/{n}")


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source, lang, tokenizer_version, tokens of docs, for two versions: `words-1`, runs of other than white space, and `byte_bpe_50k`, ids of the byte-pair coder."""
    docs = docs.select("doc_id", "source", "lang", "text", word_count(F.col("text")).alias("_words"))
    counted = encoded(docs, tokenizer, keep=("doc_id", "source", "lang", "_words"), ids=False)
    versions = F.array(F.struct(F.lit("words-1").alias("tokenizer_version"), F.col("_words").alias("tokens")), F.struct(F.lit("byte_bpe_50k").alias("tokenizer_version"), F.col("n_tokens").alias("tokens")))
    return counted.select("doc_id", "source", "lang", F.explode(versions).alias("v")).select("doc_id", "source", "lang", "v.tokenizer_version", "v.tokens")


def settled(counts: DataFrame) -> DataFrame:
    """The feed that settles the estimates of `counts` (doc_id, source, lang, n_bytes, words, ids): the word count of every document is revised, its count of bytes deleted, and its count of ids inserted. No join, so rows of one doc_id stay apart."""
    none, group = F.lit(None).cast("string"), ("source", "lang")

    def change(op: str, version: str | None, tokens: Column | None, old_version: str | None, old_tokens: Column | None) -> Column:
        new = [(F.col(c) if version else none).alias(c) for c in group]
        old = [(F.col(c) if old_version else none).alias("old_" + c) for c in group]
        number = lambda x: F.lit(None).cast("long") if x is None else x
        return F.struct(F.lit(op).alias("op"), *new, F.lit(version).cast("string").alias("tokenizer_version"), number(tokens).alias("tokens"), *old, F.lit(old_version).cast("string").alias("old_tokenizer_version"), number(old_tokens).alias("old_tokens"))

    words, size, ids = F.col("words"), F.col("n_bytes"), F.col("ids")
    each = F.array(change("revise", "words-1", words, "words-1", estimated_words(size)), change("delete", None, None, "bytes-0", size), change("insert", "byte_bpe_50k", ids, None, None))
    return counts.select(F.explode(each).alias("c")).select("c.*")


def estimated_words(n_bytes: Column) -> Column:
    return F.ceil(n_bytes / 6).cast("long")


def loaded(counts: DataFrame) -> DataFrame:
    """The feed of the first load, before anything is counted: for every document its bytes, and an estimate of its words from them."""
    first = F.array(F.struct(F.lit("bytes-0").alias("tokenizer_version"), F.col("n_bytes").alias("tokens")), F.struct(F.lit("words-1").alias("tokenizer_version"), estimated_words(F.col("n_bytes")).alias("tokens")))
    return inserts(counts.select("source", "lang", F.explode(first).alias("v")).select("source", "lang", "v.tokenizer_version", "v.tokens"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents by words and by ids, reached by deltas: a load of estimates (inserts), then a batch that revises the word counts, deletes the byte counts and inserts the id counts. The second comes first, each comes twice, and the deltas are compacted in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    sized = docs.withColumn("words", word_count(F.col("text"))).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    rollup = Rollup(spark, fresh_path(spark, "token_counts"))
    with scratch(spark) as keep:
        counts = keep(encoded(sized, tokenizer_path(spark), keep=("doc_id", "source", "lang", "n_bytes", "words"), ids=False).withColumnRenamed("n_tokens", "ids"), "counts")
        rollup.commit("settled", settled(counts))
        rollup.compact()
        for batch, feed in (("loaded", loaded(counts)), ("settled", settled(counts)), ("loaded", loaded(counts))):
            rollup.commit(batch, feed)
    return rollup.totals()
