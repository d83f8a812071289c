import random
import time

import pytest

from attestor.streaming import admission
from attestor.streaming.limits import drained


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    admission.with_rocksdb(spark)
    yield spark
    spark.conf.set(name, before)


def replay(rows, per_hour, at_once, lease):
    """The limiter of each instance, request by request."""
    held, stamps, out = {}, {}, {}
    for e, ts, inst, client, run, kind in rows:
        own = held.setdefault(inst, {})
        for r in [r for r, (_, t) in own.items() if t <= ts - lease]:
            del own[r]
        times = stamps[inst, client] = [t for t in stamps.get((inst, client), []) if t > ts - 3600]
        wait = 0.0
        if kind == "request":
            if run in own:
                what = "held already"
            elif len(own) >= at_once:
                what, wait = "instance busy", 60.0
            elif len(times) >= per_hour:
                what, wait = "client limit", max(60.0, float(int(3600 - (ts - times[0])) + 1))
            else:
                what = "admitted"
                own[run] = (client, ts)
                times.append(ts)
        elif run not in own:
            what = "not held"
        else:
            c, t = own.pop(run)
            what = "released"
            if kind == "give_back":
                what = "given back"
                kept = stamps.get((inst, c), [])
                if t in kept and t > ts - 3600:
                    kept.remove(t)
        out[e] = (inst, run, kind, what, wait, len(own))
    return out


def test_admissions_equal_a_replay(rocks, tmp_path):
    """Requests, releases, double and late releases, releases of runs that were refused, in five files that are five batches; leases run out."""
    rnd = random.Random(3)
    rows, ts = [], 1000.0
    for e in range(500):
        ts += rnd.choice([0.0, 1.0, 40.0, 300.0])
        inst = rnd.choice(["a", "a", "a", "b"])
        run = f"r{max(0, e - rnd.choice([0, 1, 2, 3, 8, 20]))}" if rnd.random() < 0.6 else f"r{e}"
        kind = "request" if run == f"r{e}" or rnd.random() < 0.1 else rnd.choice(["release", "release", "give_back"])
        rows.append((e, ts, inst, rnd.choice("xyz"), run, kind))
    for k in range(5):
        rocks.createDataFrame(rows[k * 100 : (k + 1) * 100], admission.REQUESTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.01)
    stream = rocks.readStream.schema(admission.REQUESTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    drained(admission.admissions(stream, per_hour=4, at_once=3, lease=900.0), f"{tmp_path}/out", f"{tmp_path}/check")
    got = {r.event_id: (r.instance, r.run, r.kind, r.outcome, r.retry_after, r.active) for r in rocks.read.parquet(f"{tmp_path}/out").collect()}
    want = replay(rows, 4, 3, 900.0)
    assert got == want
    assert {x[3] for x in want.values()} == {"admitted", "instance busy", "client limit", "released", "given back", "not held", "held already"}


def test_rows_on_silence(rocks, tmp_path):
    """One run ends with its result, one falls silent: heartbeats, then one deadline, and what comes after is dropped."""
    schema = "run string, event_id long, kind string"
    rocks.createDataFrame([("done", 1, "started"), ("done", 2, "result"), ("silent", 3, "started")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = rocks.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = admission.beats(stream, silence=1500, limit=6000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 60
        seen = []
        late = False
        while time.time() < end:
            time.sleep(1)
            try:
                seen = rocks.read.schema(admission.BEATS).parquet(f"{tmp_path}/out").collect()
            except Exception:
                continue  # nothing is written yet
            if any(r.kind == "deadline" for r in seen):
                if late:
                    break
                rocks.createDataFrame([("silent", 4, "late"), ("done", 5, "late")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
                late, end = True, time.time() + 8
                time.sleep(5)
    finally:
        query.stop()
    seen = rocks.read.schema(admission.BEATS).parquet(f"{tmp_path}/out").collect()
    silent = sorted((r.at_ms, r.kind) for r in seen if r.run == "silent")
    kinds = [k for _, k in silent]
    assert kinds[0] == "started" and kinds[-1] == "deadline" and kinds.count("deadline") == 1 and 1 <= kinds.count("heartbeat") <= 3 and len(kinds) == 2 + kinds.count("heartbeat")
    assert all(b - a >= 1500 for (a, _), (b, k) in zip(silent, silent[1:]) if k == "heartbeat") and silent[-1][0] - silent[0][0] >= 6000
    assert [r.kind for r in sorted((r for r in seen if r.run == "done"), key=lambda r: r.event_id)] == ["started", "result"]
