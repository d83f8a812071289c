import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from attestor.operators import rounds, select
from attestor.sources import ingest
from attestor.sources import views as vw

QUESTIONS = ["a", "b", "c", "d"]


def recorded(seed):
    rnd = random.Random(seed)
    return [(f"u{rnd.randrange(60)}", f"d{rnd.randrange(9)}", rnd.choice("aaabbc"), i) for i in range(150)]


def plain(results, questions, limits, each):
    """The loop question by question."""
    sources, queries, taken, covered_in = {}, dict.fromkeys(questions, 0), dict.fromkeys(questions, 0), dict.fromkeys(questions, 0)
    own = {q: sorted((r for r in results if r[2] == q), key=lambda r: (r[3], r[0])) for q in questions}
    domains = lambda q: len({d for d, k, _ in sources.values() if k == q})
    n = 0
    while True:
        gaps = [q for q in questions if domains(q) < limits.enough and taken[q] < len(own[q])]
        if all(domains(q) >= limits.enough for q in questions):
            why = "coverage sufficient"
        elif n >= limits.rounds:
            why = "max rounds reached"
        elif sum(queries.values()) >= limits.queries:
            why = "query budget spent"
        elif len(sources) >= limits.sources:
            why = "source budget spent"
        else:
            why = None if gaps else "no actionable gaps"
        if why:
            return sources, queries, taken, {q: domains(q) for q in questions}, why, n
        n += 1
        new = {}
        for q in gaps:
            part = own[q][taken[q] : taken[q] + each]
            for u, d, k, _ in part:
                new[u] = min(new.get(u, (k, d)), (k, d))
            queries[q] += 1
            taken[q] += len(part)
        for u, (k, d) in new.items():
            sources.setdefault(u, (d, k, n))


def outcome(tables, why):
    rows = {r.sub_question_id: r for r in tables["asked"].collect()}
    return (
        {r.canonical_url: (r.domain, r.sub_question_id, r["round"]) for r in tables["sources"].collect()}, {q: r.queries for q, r in rows.items()}, {q: r.taken for q, r in rows.items()},
        {r.sub_question_id: r.domains for r in tables["coverage"].collect()}, why,
    )


@pytest.mark.parametrize("limits, why", [((3, 9, 99, 999), "no actionable gaps"), ((9, 2, 99, 999), "max rounds reached"), ((9, 9, 4, 999), "query budget spent"), ((9, 9, 99, 12), "source budget spent"), ((0, 9, 99, 999), "coverage sufficient")])
def test_rounds_equal_a_plain_loop(spark, tmp_path, limits, why):
    results, limits = recorded(1), rounds.Limits(*limits)
    df = spark.createDataFrame(results, "canonical_url string, domain string, sub_question_id string, seq long")
    q = spark.createDataFrame([(x,) for x in QUESTIONS], "sub_question_id string")
    want = plain(results, QUESTIONS, limits, 5)
    got = outcome(*rounds.research(spark, f"file://{tmp_path}/run", df, q, limits, 5))
    assert got == want[:5] and got[4] == why
    manifest = {r.number: r.stop for r in rounds.Rounds(spark, f"file://{tmp_path}/run").manifest().collect()}
    assert manifest == {n: why if n == want[5] else None for n in range(want[5] + 1)}
    # A run that is over is not run again.
    assert outcome(*rounds.research(spark, f"file://{tmp_path}/run", df, q, limits, 5)) == got


def test_stopped_between_rounds_and_inside_one(spark, tmp_path, monkeypatch):
    results, limits = recorded(2), rounds.Limits(9, 5, 99, 999)
    df = spark.createDataFrame(results, "canonical_url string, domain string, sub_question_id string, seq long")
    q = spark.createDataFrame([(x,) for x in QUESTIONS], "sub_question_id string")
    path = f"file://{tmp_path}/run"
    real, calls = rounds.Rounds.commit, []

    def failing(at, after):
        def commit(self, number, tables, stop):
            calls.append(number)
            if number == at and not after:
                for name, t in list(tables.items())[:1]:
                    t.write.parquet(f"{self.path}/unfinished/half/{name}", mode="overwrite")
                raise RuntimeError("lost")
            real(self, number, tables, stop)
            if number == at:
                raise RuntimeError("lost")

        return commit

    for at, after in ((0, True), (2, False), (2, True), (4, False)):
        monkeypatch.setattr(rounds.Rounds, "commit", failing(at, after))
        with pytest.raises(RuntimeError, match="lost"):
            rounds.research(spark, path, df, q, limits, 5)
    monkeypatch.setattr(rounds.Rounds, "commit", real)
    assert outcome(*rounds.research(spark, path, df, q, limits, 5)) == plain(results, QUESTIONS, limits, 5)[:5]
    assert calls == [0, 1, 2, 2, 3, 4]  # no whole round is done again
    # A second run of the same round takes what is there.
    store = rounds.Rounds(spark, path)
    before = store.last()
    real(store, before, store.tables(before, list(rounds.REDUCERS)), lambda t: "other")
    assert store.manifest().where(F.col("number") == before).first()["stop"] != "other"


def test_research_query(spark):
    sf = "/root/testdata/sf0.01"
    found = [tuple(r) for r in vw.results(spark, sf).where("canonical_url <> '' and sub_question_id <> ''").select("canonical_url", "domain", "sub_question_id", "seq").collect()]
    questions = sorted({r[2] for r in found})
    want = plain(found, questions, rounds.Limits(40, 6, 60, 100_000), 12)
    got = entry.queries()["research_rounds"](spark, sf).collect()
    assert {r.sub_question_id: (r.domains, r.queries, r.taken, r.stop) for r in got} == {q: (want[3][q], want[1][q], want[2][q], want[4]) for q in questions}


def plain_blocks(raw):
    """pos, event, data of one whole stream."""
    out, pos, block = [], 0, []
    for line in [*raw.split(b"\n"), b""]:
        said = line.decode("utf-8", "replace").removesuffix("\r")
        if said:
            block.append(said)
            continue
        first = lambda name: next((x.removeprefix(f"{name}:").removeprefix(" ") for x in block if x.startswith(f"{name}:")), None)  # noqa: E731, B023
        if first("data") is not None:
            out.append((pos, first("event") or "message", first("data")))
        block = []
        pos += 1
    return out


@pytest.mark.parametrize("cut", [1, 2, 7, 10_000])
def test_streams_cut_anywhere(spark, cut):
    """Any cut of the bytes gives the same rows, characters of several bytes, carriage returns, comments, empty lines and streams without an end included."""
    rnd = random.Random(cut)
    streams = {
        "a": "event: x\ndata: é漢\U0001f600\n\n: comment\n\ndata:second\ndata: third\n\nevent: none\n\n\n\ndata: last".encode(), "b": b"", "c": b"data: 1\r\n\r\nevent: y\r\ndata: 2\r\n\r\n", "d": b"\n\ndata: after blank lines\n\n",
        "hot": "".join(f"event: e{i % 3}\ndata: {{\"n\": {i}}}\n\n" for i in range(40)).encode(),
    }
    chunks = []
    for k, raw in streams.items():
        at, n = 0, 0
        while at < len(raw) or not n:
            size = rnd.randint(1, cut)
            chunks.append((k, n * 10, bytearray(raw[at : at + size])))
            at, n = at + size, n + 1
    chunks += [("hot", -5, None), ("e", 0, None)]
    rnd.shuffle(chunks)
    df = spark.createDataFrame(chunks, "user string, n long, body binary").repartition(3)
    got = {}
    for r in ingest.sse_records(df, "user", "n").collect():
        got.setdefault(r.user, []).append((r.pos, r.event, r.data))
    assert {k: sorted(x) for k, x in got.items()} == {k: x for k, raw in streams.items() if (x := plain_blocks(raw))}


def test_medians(spark):
    import statistics

    rnd = random.Random(5)
    rows = [("hot", rnd.randrange(-(10**6), 10**6)) for _ in range(700)] + [("even", x) for x in (5, 1, 9, 2)] + [("one", 7), ("same", 3), ("same", 3), ("same", 3), ("wide", -(2**63)), ("wide", 2**63 - 1), ("none", None), (None, 4)] + [("hot", None)]
    df = spark.createDataFrame(rows, "k string, v long")
    want = {k: float(statistics.median([v for g, v in rows if g == k and v is not None])) for k in ("hot", "even", "one", "same", "wide")}
    assert {r.k: r["median"] for r in select.medians(df, "k", "v").collect()} == want
    ranks = spark.createDataFrame([("hot", 0), ("hot", 699), ("hot", 13), ("even", 3)], "k string, rank long")
    of = lambda k: sorted(v for g, v in rows if g == k and v is not None)
    assert {(r.k, r["rank"]): r.value for r in select.at_ranks(df, "k", "v", ranks).collect()} == {(k, n): of(k)[n] for k, n in (("hot", 0), ("hot", 699), ("hot", 13), ("even", 3))}
    assert select.medians(df.limit(0), "k", "v").count() == 0
