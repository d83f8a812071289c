"""Claim and evidence analytics on Spark: DataFrame and SQL operators over result, source, evidence and claim tables."""
