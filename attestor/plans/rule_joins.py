"""Named queries that join rows with tables of rules: suffixes of hosts, kinds of domains, prices by the longest prefix of a model's name."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import rules
from attestor.plans.queries import query
from attestor.sources import views as vw

SUFFIX_LINES = ["// lines of a suffix list", "com", "net  a comment", "org", "example.org", "*.example.net", "!ththan.example.net", "", "co.uk"]
DOMAIN_KINDS = [("example.org", "reference"), ("ththly.example.org", "news"), ("example.com", "vendor"), ("cheap-pills.example.com", "social"), ("net", "other")]
PRICE_RULES = [("cloud", "model-1", 0.5, 1.5), ("cloud", "model-1-mini", 0.1, 0.4), ("cloud", "model-2", 3.0, 15.0), ("cloud", "model-2-mini-1996-01", 9.0, 9.0), ("local", "*", 0.0, 0.0), ("local", "model-2-mini", 0.2, 0.3)]

_HOST = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^.*//', ''), '[/?#].*$', ''), '^.*@', ''), ':.*$', ''), '^\\.+|\\.+$', '', 'g')"
_HOSTS = f"""h AS (SELECT DISTINCT {_HOST} AS host FROM pages), l AS (SELECT host, string_split(host, '.') AS w FROM h WHERE host <> ''),
    s AS (SELECT host, len(w) AS size, unnest(range(1, len(w) + 1)) AS i, w FROM l), t AS (SELECT host, size, i, array_to_string(w[i:], '.') AS tail, w FROM s)"""


def _hosts(spark, sf):
    return vw.table(spark, sf, "pages").select(rules.host_of(F.col("url")).alias("host"))


@query(
    f"""WITH {_HOSTS}, r AS (SELECT * FROM (VALUES ('com', 'e'), ('net', 'e'), ('org', 'e'), ('example.org', 'e'), ('example.net', 'w'), ('ththan.example.net', 'x'), ('co.uk', 'e')) v(rule, kind)),
    m AS (SELECT host, size, w, CASE kind WHEN 'e' THEN size - i + 1 WHEN 'w' THEN size - i + 2 ELSE size - i END AS n, kind = 'x' AS first FROM t JOIN r ON tail = rule WHERE kind <> 'w' OR i > 1),
    b AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY first DESC, n DESC) AS place FROM m QUALIFY place = 1)
    SELECT host, array_to_string(w[size - n + 1:], '.') AS suffix, w[size - n] AS label, array_to_string(w[size - n:], '.') AS registrable FROM b WHERE n BETWEEN 1 AND size - 1"""
)
def registrable_domains(spark, sf):
    """The registrable domain of each host of the pages by a list of suffix rules."""
    lines = spark.createDataFrame([(x,) for x in SUFFIX_LINES], "value string")
    return rules.registrable(_hosts(spark, sf), rules.suffix_rules(lines))


@query(
    f"""WITH {_HOSTS}, r AS (SELECT * FROM (VALUES {", ".join(map(str, DOMAIN_KINDS))}) v(rule, kind)), b AS (SELECT host, arg_min(rule, i) AS suffix, arg_min(kind, i) AS kind FROM t JOIN r ON tail = rule GROUP BY 1),
    c AS (SELECT {_HOST} AS host, count(*) AS pages FROM pages GROUP BY 1) SELECT host, suffix, coalesce(kind, 'unknown') AS kind, pages FROM c LEFT JOIN b USING (host) WHERE host <> ''"""
)
def domain_kinds(spark, sf):
    """The kind of each host of the pages by the longest rule that it equals or is a subdomain of, and its pages."""
    table = spark.createDataFrame(DOMAIN_KINDS, "rule string, kind string")
    pages = _hosts(spark, sf).where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    found = rules.longest_suffix(pages, table, take=("kind",))
    return pages.join(found, "host", "left").select("host", "suffix", F.coalesce("kind", F.lit("unknown")).alias("kind"), "pages")


@query(
    f"""WITH n AS (SELECT provider, model || '-' || strftime(ts, '%Y-%m') AS model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM v_attempts GROUP BY ALL), r AS (SELECT * FROM (VALUES {", ".join(map(str, PRICE_RULES))}) v(provider, prefix, price, out)),
    b AS (SELECT provider, model, arg_max(prefix, CASE WHEN prefix = '*' THEN -1 ELSE length(prefix) END) AS rule, arg_max(price::DOUBLE, CASE WHEN prefix = '*' THEN -1 ELSE length(prefix) END) AS price FROM n JOIN r USING (provider) WHERE prefix = '*' OR starts_with(model, prefix) GROUP BY ALL)
    SELECT provider, model, calls, rule, price, round(input_tokens * price / 1000000, 6) AS cost, rule IS NULL AS unpriced FROM n LEFT JOIN b USING (provider, model)"""
)
def dated_model_prices(spark, sf):
    """Calls by provider and dated model, priced by the longest rule that the name begins with, else by the provider's wildcard, else unpriced."""
    table = spark.createDataFrame(PRICE_RULES, "provider string, prefix string, price double, out double")
    calls = vw.attempts(spark, sf).select("provider", F.concat_ws("-", "model", F.date_format("ts", "yyyy-MM")).alias("model"), "input_tokens")
    named = calls.groupBy("provider", "model").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("tokens"))
    priced = named.join(rules.longest_prefix(named, table, ["provider"], "model"), ["provider", "model"], "left")
    return priced.select("provider", "model", "calls", "rule", "price", F.round(F.col("tokens") * F.col("price") / 1000000, 6).alias("cost"), F.col("rule").isNull().alias("unpriced"))
