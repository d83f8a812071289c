"""Functions for SQL texts: `register(spark)` makes the Arrow UDFs and the table function `propositions`, a row for each part of a claim, known to a session. What is a column expression here needs no registration."""

from __future__ import annotations

from pyspark.sql import SparkSession

from attestor.functions import matching, wording


def register(spark: SparkSession) -> None:
    spark.udf.register("main_text", matching.main_text)
    spark.udf.register("title_ratio", matching.ratio)
    spark.udf.register("comparison_sides", wording.comparison_sides)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION propositions(claim STRING) RETURNS TABLE(part INT, said STRING) RETURN SELECT pos, col FROM posexplode({matching.propositions_sql('claim')})")
