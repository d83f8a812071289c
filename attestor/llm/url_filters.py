"""Operator 3: empirical-Bayes host reputation with rules on top, with DataFrame functions only.

Labelled page outcomes (bad or not) are counted by host. The rate of a suffix is shrunk to the rate of all pages, that of a registered domain to its
suffix, that of a host to its domain, each through a beta-binomial prior whose strength comes from the spread at its own level (method of moments).
A host is blocked when the lower bound of its posterior bad rate is above a threshold. Rules, where one fits, decide instead.

Cases: a null URL or one without `://` has host and path '' and takes the reputation of all pages; a page without an outcome counts for no rate;
repeated outcomes for one page count once each and give no more rows; repeated pages are rows of their own; URLs of any length are read whole; other columns of pages, whatever their names, are not read; no outcomes at all: everything is allowed unless a rule blocks it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Customary second levels under suffixes of two letters.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Bytes of the table of hosts that is broadcast at most.
BROADCAST_BYTES = 64 << 20
#: (verdict, host, path) in force.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; '' for null or where there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + F.lit(3), F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does. Equally long rules: the earlier one in rules."""
    chain = None
    for verdict, on, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(start)
        value = F.struct(F.lit(on + start).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain if chain is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def levels(host: Column, second_level: Sequence[str] = SECOND_LEVEL) -> tuple[Column, Column]:
    """(registered domain, suffix): the suffix is the last label, or the last two where the last has two letters and the one before is a customary second level."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last, before = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    two = (F.length(last) == 2) & F.coalesce(before.isin(*second_level), F.lit(False)) & (n > 2)
    suffix = F.when(two, F.concat_ws(".", before, last)).otherwise(last)
    keep = F.when(two, F.lit(3)).otherwise(F.lit(2))
    return F.array_join(F.slice(labels, F.greatest(n - keep + 1, F.lit(1)), keep), "."), suffix


def host_reputation(outcomes: DataFrame, z: float = 1.645, floor: float = 2.0, ceiling: float = 200.0) -> DataFrame:
    """outcomes: host string, bad int (0, 1 or null), one row a page. Returns host, pages, n, bad, rate, lower: the posterior mean and its lower bound, for every host.

    Strength of the prior at a level: (m (1 - m) - v) / v for the mean m and the between-unit variance v of the units' rates, held between floor and ceiling.
    """
    hosts = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    domain, suffix = levels(F.col("host"))
    hosts = written(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")  # read for each level and each prior
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).select((F.col("bad") + 0.5) / (F.col("n") + 1.0))

    def strength(units: DataFrame) -> Column:
        """The prior strength from the spread of the units' rates, weighted by their outcomes and less the binomial part."""
        rate = F.col("bad") / F.col("n")
        s = units.where("n > 0").agg(F.sum("n").alias("w"), F.sum("bad").alias("b"), F.sum(F.col("n") * rate * rate).alias("q"), F.count(F.lit(1)).alias("k"))
        m = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("b") / F.col("w")))
        v = F.greatest(F.col("q") / F.col("w") - m * m - m * (1 - m) * F.col("k") / F.col("w"), F.lit(1e-9))
        return s.select(F.coalesce(F.least(F.greatest(m * (1 - m) / v - 1, F.lit(floor)), F.lit(ceiling)), F.lit(ceiling))).scalar()

    shrunk = suffixes.select("suffix", "n", "bad", strength(suffixes).alias("k1"), overall.scalar().alias("m0"))
    shrunk = shrunk.select("suffix", ((F.col("bad") + F.col("k1") * F.col("m0")) / (F.col("n") + F.col("k1"))).alias("m1"))
    middle = domains.join(shrunk, "suffix").withColumn("k2", strength(domains))
    middle = middle.select("domain", ((F.col("bad") + F.col("k2") * F.col("m1")) / (F.col("n") + F.col("k2"))).alias("m2"))
    hosts = hosts.join(middle, "domain").withColumn("k3", strength(hosts))
    a, total = F.col("bad") + F.col("k3") * F.col("m2"), F.col("n") + F.col("k3")
    mean = a / total
    deviation = F.sqrt(mean * (1 - mean) / (total + 1))
    return hosts.select("host", "pages", "n", "bad", mean.alias("rate"), F.greatest(F.lit(0.0), mean - F.lit(z) * deviation).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict, bad_rate and bad_rate_lower. outcomes: page_id, bad."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.where("page_id is not null and bad is not null").select("page_id", F.col("bad").cast("int").alias("bad"))
    reputation = host_reputation(split.select("page_id", "host").join(known, "page_id", "left").select("host", "bad"), z)
    reputation = written(reputation, "reputation")
    size = reputation.agg(F.coalesce(F.sum(F.octet_length("host") + 48), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:  # else a hot host is split by the join of adaptive execution
        reputation = F.broadcast(reputation)
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("lower") > threshold, "block").otherwise("allow")
    return (
        split.join(reputation, "host", "left")
        .withColumn("_rule", rule)
        .select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), own).alias("verdict"), F.round("rate", 6).alias("bad_rate"), F.round("lower", 6).alias("bad_rate_lower"))
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of the document of the same number, where there is one."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return judge(pages, labels)


def oracle() -> str:
    """DuckDB SQL for the query."""
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda out: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if out == 'rule' else v}'" for v, h, p in rules) + " END"
    strength = lambda t: f"(SELECT coalesce(least(greatest(m * (1 - m) / greatest(q / w - m * m - m * (1 - m) * k / w, 1e-9) - 1, 2.0::DOUBLE), 200.0::DOUBLE), 200.0::DOUBLE) FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, b / w)) AS m FROM (SELECT sum(n)::DOUBLE AS w, sum(bad)::DOUBLE AS b, sum(bad * bad / n)::DOUBLE AS q, count(*)::DOUBLE AS k FROM {t} WHERE n > 0)))"
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
o AS (SELECT host, count(*) AS pages, count(quality) AS n, coalesce(sum(1 - quality), 0)::DOUBLE AS bad FROM p LEFT JOIN labels ON doc_id = page_id GROUP BY 1),
l AS (SELECT *, string_split(host, '.') AS parts FROM o),
k AS (SELECT *, len(parts) > 2 AND length(parts[-1]) = 2 AND parts[-2] IN {SECOND_LEVEL} AS two FROM l),
h AS (SELECT host, pages, n, bad, CASE WHEN two THEN parts[-2] || '.' || parts[-1] ELSE parts[-1] END AS suffix, array_to_string(parts[greatest(len(parts) - CASE WHEN two THEN 2 ELSE 1 END, 1):], '.') AS domain FROM k),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY 1),
s1 AS (SELECT suffix, (bad + {strength("s")} * (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) FROM s)) / (n + {strength("s")}) AS m1 FROM s),
d1 AS (SELECT domain, (bad + {strength("d")} * m1) / (n + {strength("d")}) AS m2 FROM d JOIN s1 USING (suffix)),
h1 AS (SELECT host, (bad + {strength("h")} * m2) / (n + {strength("h")}) AS mean, n + {strength("h")} AS total FROM h JOIN d1 USING (domain)),
v AS (SELECT host, mean, greatest(0, mean - 1.645::DOUBLE * sqrt(mean * (1 - mean) / (total + 1))) AS lower FROM h1)
SELECT page_id, host, path, {case("rule")} AS rule, coalesce({case("verdict")}, CASE WHEN lower > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS bad_rate, round(lower, 6) AS bad_rate_lower FROM p JOIN v USING (host)
"""
