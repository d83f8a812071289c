"""Rows against tables of rules of any size: the longest suffix of a host, with wildcards and exceptions, and the longest prefix of a name, with a wildcard for the rest.

Rules and rows meet by equality: every distinct host is written out as its suffixes, label by label, every distinct name as its prefixes of the lengths that rules have. Distinct keys are met once and joined back, so a host of a third of all
rows is walked once. Rules are broadcast up to BROADCAST_RULES; beyond, each stands once for each of SALTS salts, so that a suffix that most hosts end with (com) is met in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_RULES = 200_000
SALTS = 32
EXACT, WILDCARD, EXCEPTION = "exact", "wildcard", "exception"


def suffix_rules(lines: DataFrame) -> DataFrame:
    """rule (without its mark), kind of the lines (`value`) of a suffix list: `//` begins a comment, `*.` a wildcard of one label, `!` an exception; a rule ends at white space."""
    rule = F.lower(F.regexp_extract(F.trim("value"), r"^(\S*)", 1))
    rows = lines.select(rule.alias("rule")).where("rule <> '' and not startswith(rule, '//')").distinct()
    kind = F.when(F.startswith("rule", F.lit("!")), EXCEPTION).when(F.startswith("rule", F.lit("*.")), WILDCARD).otherwise(EXACT)
    return rows.select(F.regexp_replace("rule", r"^(!|\*\.)", "").alias("rule"), kind.alias("kind"))


def read_suffix_rules(spark: SparkSession, path: str, private: bool = True) -> DataFrame:
    """Rules of a file in the format of public suffix lists; the part between the lines that name PRIVATE DOMAINS counts only with `private`. The file is read as one text, as its order says which part a line is of."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "value"))
    if private:
        return suffix_rules(whole.select("value"))
    edges = whole.where("value like '%BEGIN PRIVATE DOMAINS%'").agg(F.coalesce(F.min("n"), F.lit(2**31 - 1)).alias("edge"))
    return suffix_rules(whole.crossJoin(F.broadcast(edges)).where("n < edge").select("value"))


def host_of(domain: Column) -> Column:
    """The host of a domain or URL: without scheme, user, port and path, in lower case, no dots at its ends."""
    host = F.regexp_replace(F.lower(F.trim(F.coalesce(domain, F.lit("")))), r"^.*//", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"[/?#].*$", ""), "^.*@", ""), r":.*$", "")
    return F.regexp_replace(host, r"^\.+|\.+$", "")


def _met(keyed: DataFrame, rules: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on equal keys, with the rules broadcast or salted."""
    if rules.count() <= BROADCAST_RULES:
        return keyed.join(F.broadcast(rules), on)
    salted = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.withColumn("_salt", F.abs(F.xxhash64(*keyed.columns) % SALTS).cast("int")).join(salted, [*on, "_salt"]).drop("_salt")


def longest_suffix(hosts: DataFrame, rules: DataFrame, host: str = "host", take: tuple[str, ...] = ()) -> DataFrame:
    """host, suffix (the longest rule, by labels, that the host equals or is a subdomain of) and the rule's columns `take`, for the distinct hosts that a rule fits. rules: rule, `take`; of several of one name the smallest `take` counts."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("rule"), (F.size(labels) - i + 1).alias("n")))
    distinct = hosts.where(F.coalesce(F.col(host), F.lit("")) != "").select(F.col(host).alias("host")).distinct()
    keyed = distinct.select("host", F.explode(suffixes).alias("s")).select("host", "s.rule", "s.n")
    own = rules.groupBy("rule").agg(F.min(F.struct(*take) if take else F.lit(0)).alias("_take"))
    best = _met(keyed, own, ["rule"]).groupBy("host").agg(F.max_by(F.struct("rule", "_take"), "n").alias("b"))
    return best.select(F.col("host").alias(host), F.col("b.rule").alias("suffix"), *(F.col(f"b._take.{c}").alias(c) for c in take))


def registrable(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """host, suffix, label, registrable for the distinct hosts with a known suffix and a label before it.

    rules: rule, kind, as suffix_rules gives them. An exception wins, and its suffix is what follows its first label; else the rule of the most labels, a wildcard counting the label that it stands for. Hosts that no rule fits, and hosts
    that are suffixes themselves, have no row: nothing is guessed.
    """
    labels = F.split("host", r"\.")
    size = F.size(labels)
    tail = lambda i: F.array_join(F.slice(labels, i, size), ".")
    entry = lambda name, kind, n, first: F.struct(name.alias("rule"), F.lit(kind).alias("kind"), n.alias("n"), F.lit(first).alias("first"))
    each = lambda i: F.array(
        entry(tail(i), EXACT, size - i + 1, 0), entry(tail(i), EXCEPTION, size - i, 1), F.when(i > 1, entry(tail(i), WILDCARD, size - i + 2, 0))
    )
    keys = F.array_compact(F.flatten(F.transform(F.sequence(F.lit(1), size), each)))
    distinct = hosts.where(F.coalesce(F.col(host), F.lit("")) != "").select(F.col(host).alias("host")).distinct()
    keyed = distinct.select("host", F.explode(keys).alias("k")).select("host", "k.*")
    fits = _met(keyed, rules.select("rule", "kind").distinct(), ["rule", "kind"]).groupBy("host").agg(F.max(F.struct("first", "n")).alias("b"))
    at = F.col("b.n")
    out = fits.where((at > 0) & (at < size)).select("host", F.array_join(F.slice(labels, size - at + 1, at), ".").alias("suffix"), F.element_at(labels, size - at).alias("label"))
    return out.select(F.col("host").alias(host), "suffix", "label", F.concat("label", F.lit("."), "suffix").alias("registrable"))


def longest_prefix(names: DataFrame, rules: DataFrame, by: list[str], name: str, prefix: str = "prefix", wildcard: str = "*") -> DataFrame:
    """by, name, rule, and the other columns of rules, for the distinct names that a rule of their group fits: the name itself, else its longest prefix, else the wildcard. rules: by, prefix, others; of several of one name the smallest counts."""
    take = [c for c in rules.columns if c not in (*by, prefix)]
    whole = F.struct(*take) if take else F.lit(0)
    own = rules.where(F.col(prefix).isNotNull()).groupBy(*by, F.col(prefix).alias("rule")).agg(F.min(whole).alias("_take"))
    lengths = own.where(F.col("rule") != wildcard).agg(F.min(F.length("rule")).alias("low"), F.max(F.length("rule")).alias("high")).first()
    low, high = lengths["low"] or 1, lengths["high"] or 0
    size = F.length("_name")
    prefixes = F.when(F.least(size, F.lit(high)) >= low, F.transform(F.sequence(F.lit(low), F.least(size, F.lit(high))), lambda i: F.struct(F.left("_name", i).alias("rule"), i.alias("n")))).otherwise(F.array().cast("array<struct<rule:string,n:int>>"))
    every = F.concat(F.filter(prefixes, lambda p: p["rule"] != wildcard), F.array(F.struct(F.lit(wildcard).alias("rule"), F.lit(-1).alias("n"))))
    distinct = names.where(F.col(name).isNotNull()).select(*by, F.col(name).alias("_name")).distinct()
    keyed = distinct.select(*by, "_name", F.explode(every).alias("_p")).select(*by, "_name", "_p.rule", "_p.n")
    best = _met(keyed, own, [*by, "rule"]).groupBy(*by, "_name").agg(F.max_by(F.struct("rule", "_take"), "n").alias("_b"))
    return best.select(*by, F.col("_name").alias(name), F.col("_b.rule").alias("rule"), *(F.col(f"_b._take.{c}").alias(c) for c in take))
