"""Named queries of reservations, costs, clients and leaks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestor.operators import accounts
from attestor.plans.queries import query
from attestor.sources import views as vw


@query(
    """WITH r AS (SELECT user_id, list(event_id ORDER BY event_id) AS o, list(value ORDER BY event_id) AS c FROM events GROUP BY 1),
    f AS (SELECT user_id, o, list_reduce(list_prepend({'u': 0.0::DOUBLE, 'g': []::BOOLEAN[], 'c': 0.0::DOUBLE}, list_transform(c, lambda x: {'u': 0.0::DOUBLE, 'g': []::BOOLEAN[], 'c': x})),
      lambda a, b: {'u': a.u + CASE WHEN a.u + b.c <= 100 + 1e-9 THEN b.c ELSE 0 END, 'g': list_append(a.g, a.u + b.c <= 100 + 1e-9), 'c': 0.0::DOUBLE}).g AS g FROM r)
    SELECT user_id, unnest(o) AS event_id, unnest(g) AS granted FROM f"""
)
def credit_reservations(spark, sf):
    return accounts.reservations(vw.table(spark, sf, "events"), "user_id", "event_id", "value", 100.0)


@query(
    """WITH a AS (SELECT seq, input_tokens, output_tokens, CASE WHEN seq % 3 = 0 THEN input_tokens // 2 END AS h, CASE WHEN seq % 5 = 0 THEN 100 ELSE 0 END AS w FROM v_attempts)
    SELECT seq, round((greatest(input_tokens - coalesce(h, 0) - w, 0) * 2.0::DOUBLE + output_tokens * 8.0::DOUBLE + coalesce(h, 0) * 0.5::DOUBLE + w * 2.0::DOUBLE) / 1e6, 8) AS cost, w = 0 AND coalesce(h, 0) + w <= input_tokens AS complete FROM a"""
)
def cached_costs(spark, sf):
    a = vw.attempts(spark, sf)
    hit, put = F.when(F.col("seq") % 3 == 0, F.floor(F.col("input_tokens") / 2)), F.when(F.col("seq") % 5 == 0, 100).otherwise(0)
    cost, complete = accounts.call_cost(F.col("input_tokens"), F.col("output_tokens"), hit, put, 2.0, 8.0, 0.5, None)
    return a.select("seq", cost.alias("cost"), complete.alias("complete"))


@query(
    """WITH c AS (SELECT conv_id, turn, '10.0.0.' || (conv_id % 200) AS peer, CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 1 THEN '1.2.3.' || turn || ', 5.6.7.8' ELSE 'bad, 9.9.9.9' END AS f FROM conversations)
    SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN '1.2.3.' || turn ELSE peer END AS client FROM c"""
)
def client_keys(spark, sf):
    c = vw.table(spark, sf, "conversations")
    turn = F.col("turn").cast("string")
    header = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("1.2.3."), turn, F.lit(", 5.6.7.8"))).when(F.col("turn") % 3 == 2, "bad, 9.9.9.9")
    peer = F.concat(F.lit("10.0.0."), (F.col("conv_id") % 200).cast("string"))
    return c.select("conv_id", "turn", accounts.client_key(peer, header, 2).alias("client"))


@query("SELECT doc_id, list_filter(['idiot', 'Clown', 'password'], lambda t: contains(lower(text), lower(t))) AS found FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'clown') OR contains(lower(text), 'password')")
def leak_scan(spark, sf):
    return accounts.leaks(vw.table(spark, sf, "documents"), "doc_id", "text", ["idiot", "Clown", "password"])


@query("SELECT o_custkey AS custkey, CAST(sum(o_totalprice) AS BIGINT) // 10 AS quota, CASE WHEN o_custkey % 7 > 0 AND CAST(sum(o_totalprice) AS BIGINT) // 10 >= o_custkey % 7 * 5000 THEN CAST(sum(o_totalprice) AS BIGINT) // 10 // (o_custkey % 7 * 5000) ELSE 0 END AS runs FROM orders GROUP BY 1")
def affordable_runs(spark, sf):
    """A customer's prices are added in the order of their keys, so that a sum that ends in a half is the same however the rows are dealt; halves round to even, as the cast in SQL does."""
    by_key = Window.partitionBy("o_custkey").orderBy("o_orderkey", "o_totalprice")
    running = vw.table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), F.sum("o_totalprice").over(by_key.rowsBetween(Window.unboundedPreceding, 0)).alias("total"), F.row_number().over(by_key).alias("n"))
    o = running.groupBy("custkey").agg(F.floor(F.rint(F.max_by("total", "n")).cast("long") / 10).alias("quota"))
    return o.select("custkey", "quota", accounts.runs_affordable(F.col("quota"), F.col("custkey") % 7 * 5000).alias("runs"))
