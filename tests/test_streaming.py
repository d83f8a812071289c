from pyspark.sql import functions as F

from attestor.streaming.limits import daily_counts, drained, event_stream, rolling_admissions, user_sessions

EVENTS = "/root/testdata/sf0.001/events.parquet"


def spread(spark, tmp_path):
    """The events in three files by time."""
    rows = spark.read.parquet(EVENTS).select("event_id", "ts", "user_id", "event_type")
    path = str(tmp_path / "events")
    n = rows.count()
    for k in range(3):
        rows.orderBy("ts", "event_id").withColumn("i", F.row_number().over(__import__("pyspark").sql.Window.orderBy("ts", "event_id"))).where(f"i > {k * n // 3} and i <= {(k + 1) * n // 3}").drop("i").coalesce(1).write.mode("append").parquet(path)
    return path, rows


def test_rolling_admissions(spark, tmp_path):
    path, rows = spread(spark, tmp_path)
    stream = event_stream(spark, path, rows.schema.simpleString()[7:-1].replace(":", " "))
    drained(rolling_admissions(stream, 2, horizon=7 * 24 * 3600), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {r.event_id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want, held = {}, {}
    for r in rows.orderBy("ts", "event_id").collect():
        own = held[r.user_id] = [t for t in held.get(r.user_id, []) if (r.ts - t).total_seconds() < 7 * 24 * 3600]
        want[r.event_id] = len(own) < 2
        if want[r.event_id]:
            own.append(r.ts)
    assert got == want and not all(want.values())


def test_windows(spark, tmp_path):
    path, rows = spread(spark, tmp_path)
    stream = event_stream(spark, path, rows.schema.simpleString()[7:-1].replace(":", " "))
    drained(daily_counts(stream), str(tmp_path / "days"), str(tmp_path / "c1"))
    days = {r.day: r.events for r in spark.read.parquet(str(tmp_path / "days")).collect()}
    all_days = {r.day: r["count"] for r in rows.groupBy(F.to_date("ts").alias("day")).count().collect()}
    assert len(days) >= len(all_days) - 2 and all(all_days[d] == n for d, n in days.items())
    drained(user_sessions(stream), str(tmp_path / "sessions"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "sessions")).count() > 0
