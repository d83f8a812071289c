import difflib
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from attestor.operators import accounts, answers, captures, coverage, dedup, gate, measure, merge, resolve
from attestor.sources import ingest
from attestor.sources import views as vw

RESULTS = "seq long, url string, title string, domain string, score double, query_id string, sub_question_id string, canonical_url string, content string"


def test_candidates_merge_provenance(spark):
    rows = [
        (2, "B", "t2", "d", 0.9, "Q2", "SQ2", "u", "late"), (1, "A", "t1", "d", 0.5, "Q1", "SQ1", "u", None), (3, "C", "t3", "d", None, "Q1", "SQ1", "u", "later"),
        (4, "D", "t4", "e", 0.1, "Q3", "", "v", ""), (5, "E", "t5", "e", 0.1, "Q3", "SQ1", "", None), (6, "F", "t6", "f", 0.1, "Q3", "SQ1", "known", None),
    ]
    df = spark.createDataFrame(rows, RESULTS)
    known = spark.createDataFrame([("known",), ("known",)], "canonical_url string")
    got = {r.canonical_url: r for r in dedup.by_url(df, known).collect()}
    assert set(got) == {"u", "v"}
    u, v = got["u"], got["v"]
    assert (u.seq, u.url, u.title, u.best_score, u.content, u.n_results, u.found_by, u.sub_questions) == (1, "A", "t1", 0.9, "late", 3, ["Q1", "Q2"], ["SQ1", "SQ2"])
    assert (v.content, v.found_by, v.sub_questions) == (None, [], [])
    s = dedup.url_statistics(df, known).first()
    assert (s.results_in, s.already_known, s.duplicate_urls, s.candidates, s.fetches_avoided) == (5, 1, 2, 2, 3)
    assert dedup.by_url(df.limit(0), known).count() == 0


def test_claims_and_content(spark):
    rows = [
        (1, "section", "A b.", ["e1"], "substantive", ""), (2, "summary", "a  B", ["e1"], "substantive", ""), (3, "finding", "a b", ["e2"], "substantive", ""), (4, "section", "a b", ["e1"], "framing", ""),
        (5, "summary", "caches speed reads", ["e3"], "substantive", "s"), (6, "section", "Reads: the caches speed.", ["e4"], "substantive", "s"), (7, "section", "reads caches speed", ["e4"], "substantive", "t"), (8, "section", "of the", ["e5"], "substantive", "s"), (9, "section", "the of", ["e5"], "substantive", "s"),
        (10, "section", "reads caches speed", ["e6"], "substantive", None),
    ]
    df = spark.createDataFrame(rows, "claim_id long, placement string, text string, evidence_ids array<string>, kind string, slot string")
    assert {r.claim_id for r in dedup.claims(df).where("stays").collect()} == {2, 3, 4, 5, 7, 8, 9, 10}
    src = spark.createDataFrame([("S1", 1, "h", True), ("S2", 2, "h", True), ("S0", 0, "h", False), ("S3", 3, None, True)], "source_id string, doc_id long, content_hash string, usable boolean")
    assert {r.source_id: r.duplicate_of for r in dedup.by_content(src).collect()} == {"S1": None, "S2": "S1", "S0": None, "S3": None}


def test_gate_is_closed_by_default(spark):
    claims = spark.createDataFrame([(i, "t", ["e1", "e2", "gone"], "substantive") for i in range(6)] + [(9, "t", ["e1"], "framing")], "claim_id long, text string, evidence_ids array<string>, kind string")
    evidence = spark.createDataFrame([("e1", "S1", "exact"), ("e2", "S2", "exact"), ("e3", "S2", "fuzzy")], "evidence_id string, source_id string, quote_match string")
    ranks = spark.createDataFrame([("S1", 1, 0.5), ("S2", 2, 0.1)], "source_id string, rank int, quality double")
    score = lambda c, e, en, g=True, t=False, ne=None: (c, e, en, (1 - en) / 2 if ne is None else ne, (1 - en) / 2, g, t)
    scores = [score(0, "e1", 0.99), score(0, "e2", 0.985), score(1, "e1", 0.99, g=False), score(2, "e1", 0.99, t=True), score(3, "e1", 0.99, ne=0.5), score(4, "e1", float("nan")), score(5, "e1", 0.6)]
    scores = spark.createDataFrame(scores, "claim_id long, evidence_id string, entailment double, neutral double, contradiction double, guards_passed boolean, truncated boolean")
    got = {r.claim_id: (r.verdict, r.best_evidence, r.reason) for r in gate.verdicts(claims, gate.scoring_pairs(claims, evidence), scores, ranks).collect()}
    assert got == {0: ("supported", "e2", ""), 1: ("partial", None, "guard failed"), 2: ("partial", None, "guard failed"), 3: ("unchecked", None, "no valid score"), 4: ("unchecked", None, "no valid score"), 5: ("partial", None, "below threshold")}
    verdicts = spark.createDataFrame([("t", ["e1", "e2", "gone"], "supported"), ("t", ["e1", "e2", "gone"], "supported"), ("other", ["e1"], "supported")], "text string, evidence_ids array<string>, verdict string")
    assert {r.claim_id for r in resolve.published(claims.withColumn("text", F.when(F.col("claim_id") == 3, "x").otherwise(F.col("text"))), verdicts).where("published").collect()} == {0, 1, 2, 4, 5, 9}


def test_coverage_and_empty_rates(spark):
    ev = spark.createDataFrame([("S1", "a", "exact", "supports"), ("S2", "a", "exact", "contradicts"), ("S1", "b", "exact", "supports"), ("S1", "b", "exact", "supports"), ("S1", "c", "fuzzy", "supports")], "source_id string, sub_question_id string, quote_match string, stance string")
    asked = spark.createDataFrame([(x,) for x in "abcd"], "sub_question_id string")
    got = {r.sub_question_id: (r.verdict, r.contradicted, r["items"]) for r in coverage.coverage(ev, asked).collect()}
    assert got == {"a": ("covered", True, 2), "b": ("weak", False, 2), "c": ("uncovered", False, 1), "d": ("uncovered", False, 0)}
    c = measure.confusion(spark.createDataFrame([], "p boolean, a boolean"), F.col("p"), F.col("a")).first()
    assert (c.tp, c.agreement, c.precision, c.recall) == (0, None, None, None)


def test_sweep_agrees_with_counting(spark):
    cases = [(0.5, True, True), (0.98, True, False), (0.9799, True, True), (1.0, True, True), (0.99, False, True), (0.2, True, False)]
    df = spark.createDataFrame(cases, "score double, guards_passed boolean, supported boolean")
    got = {round(r.threshold, 2): (r.tp, r.fp, r.fn, r.tn) for r in measure.sweep(df).collect()}
    for t in range(50, 100):
        hit = [(g and int(s * 100 + 1e-9) >= t, y) for s, g, y in cases]
        assert got[t / 100] == tuple(sum(h == a and y == b for h, y in hit) for a, b in ((True, True), (True, False), (False, True), (False, False)))
    assert measure.chosen_threshold(measure.sweep(df)).first().threshold == 0.99


def test_streams_pages_and_merging(spark):
    raw = spark.createDataFrame([(1, "event: a\ndata: 1\n\n: ping\n\ndata: 2\n\n"), (2, None)], "k int, raw string")
    assert [(r.k, r.pos, r.event, r.data) for r in ingest.sse_events(raw, "k").orderBy("pos").collect()] == [(1, 0, "a", "1"), (1, 2, "message", "2")]
    pages = spark.createDataFrame([(1, 1, "abc"), (1, 2, ""), (1, 3, "x")], "doc_id int, page_no int, text string")
    assert [r.offset for r in ingest.page_offsets(pages).orderBy("page_no").collect()] == [0, 4, 5]
    at = spark.createDataFrame([([0, 4, 5], 4), ([0, 4, 5], -1), ([], 3)], "o array<int>, p int")
    assert [r[0] for r in at.select(ingest.page_of(F.col("o"), F.col("p"))).collect()] == [2, None, None]
    writes = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y")], "id string, seq int, v string")
    assert {r.id: (r.first_seen, r.v) for r in merge.latest(writes, "id", "seq").collect()} == {"a": (1, "z"), "b": (2, "y")}
    one, two = (merge.table_hash(writes.orderBy(o), ["id", "seq", "v"]).first() for o in ("seq", "v"))
    assert one == two and one.rows == 3


def test_quota_and_ledger(spark):
    rows = [(i, datetime(2024, 1, 1 + i // 3, 10, i), i % 2) for i in range(6)]
    ev = spark.createDataFrame(rows, "event_id int, ts timestamp, user_id int")
    assert [r.admitted for r in measure.daily_quota(ev, 2).orderBy("event_id").collect()] == [True, True, False] * 2
    led = measure.ledger(spark.createDataFrame([("k", i, 0.4) for i in range(4)], "k string, i int, cost double"), "k", "i", "cost", 1.0).orderBy("i").collect()
    assert [r.fits for r in led] == [True, True, False, False] and led[2].headroom == pytest.approx(0.2)


def test_answers(spark):
    q = spark.createDataFrame([(1, "causal"), (2, "list"), (3, "odd")], "question_id int, question_type string")
    pub = spark.createDataFrame([(1, "limitations"), (2, "items"), (2, "items")], "question_id int, slot string")
    got = {r.question_id: (r.answered, r.partly, r.repeats) for r in answers.answer_coverage(answers.slots(q), pub).collect()}
    assert got == {1: (False, True, 0), 2: (True, False, 1)}


def test_near_titles(spark):
    base = "A practical guide to caching and queues"
    titles = [(1, "d", base), (2, "d", base + "!"), (3, "e", base + "!"), (4, "d", base + " 2"), (5, "d", "Short"), (6, "d", "short"), (7, "d", None), (8, "d", base + "!!"), (9, "d", base + "!!!!!!!"), (10, "d", base.upper())]
    rows = [(f"u{i}", i, d, t, [f"SQ{i}"]) for i, d, t in titles]
    df = spark.createDataFrame(rows, "canonical_url string, seq long, domain string, title string, sub_questions array<string>")
    alike = lambda a, b: len(a) >= 20 and len(b) >= 20 and re.findall(r"\d+", a) == re.findall(r"\d+", b) and difflib.SequenceMatcher(None, a, b).ratio() >= 0.92
    want, kept = {}, []
    for i, d, t in titles:
        low = " ".join((t or "").lower().split())
        first = next((u for u, e, x in kept if e == d and alike(low, x)), None)
        if first is None:
            kept.append((f"u{i}", d, low))
        else:
            want[f"u{i}"] = first
    assert {r.canonical_url: r.kept_as for r in dedup.near_titles(df).collect()} == want and want
    got = {r.canonical_url: r for r in dedup.collapsed(df).collect()}
    assert set(got) == {u for u, _, _ in kept} and got["u1"].merged == sum(v == "u1" for v in want.values())
    assert got["u1"].sub_questions == ["SQ1", *(f"SQ{u[1:]}" for u, v in want.items() if v == "u1")]


def alike(a, b):
    return len(a) >= 20 and len(b) >= 20 and re.findall(r"\d+", a) == re.findall(r"\d+", b) and difflib.SequenceMatcher(None, a, b).ratio() >= 0.92


def given_up(titles):
    """url: the one kept for it, of (url, seq, domain, title) in order, each against all kept ones."""
    want, kept = {}, []
    for url, _, d, t in sorted(titles, key=lambda r: r[1]):
        low = " ".join((t or "").lower().split())
        first = next((u for u, e, x in kept if e == d and alike(low, x)), None)
        if first is None:
            kept.append((url, d, low))
        else:
            want[url] = first
    return want


def test_near_titles_equal_brute_force(spark):
    """Titles of many lengths with few and many edits, copies, and a domain with most of the rows."""
    rnd = random.Random(4)
    assert {w for n in range(20, 5000) for k in [int(0.08 * (n + int(n * (2 / 0.92 - 1) + 1e-9)) + 1e-9) + 1] for w in (n // k, n // k + (n % k > 0))} == set(dedup.PIECE_WIDTHS)
    bases = ["".join(rnd.choice("abcdefgh 12") for _ in range(rnd.choice([18, 19, 20, 21, 24, 30, 45, 80, 160]))) for _ in range(12)]
    titles = []
    for i in range(260):
        t = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, len(t) // 12, len(t) // 9])):
            at = rnd.randrange(len(t) + 1)
            t[at : at + rnd.choice([0, 1, 1, 2])] = rnd.choice(["", "x", "b", "zz"])
        titles.append((f"u{i}", i * 3, rnd.choice(["hot.org"] * 4 + ["a.org", "b.org"]), "".join(t)))
    df = spark.createDataFrame(titles, "canonical_url string, seq long, domain string, title string")
    want = given_up(titles)
    assert {r.canonical_url: r.kept_as for r in dedup.near_titles(df).collect()} == want and len(want) > 60


def test_near_titles_meet_in_blocks(spark, monkeypatch):
    """A hot group is cut into blocks that meet two by two, and few pairs get as far as the ratio."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("etaonhrsdlé") for _ in range(rnd.randrange(2, 9))) for _ in range(60)]
    titles = [" ".join(rnd.choice(words) for _ in range(10))[:60] for _ in range(150)]
    titles += [t[:k] + rnd.choice(["x", "", "yy"]) + t[k + 1 :] for t in titles[:60] for k in (rnd.randrange(len(t)),)] + ["z" * 70 + t + "e" * 200 for t in titles[:9]]
    rows = [(f"u{i}", i, "hot.org", t) for i, t in enumerate(titles)]
    seen = list(dedup.may_match(titles))
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    assert len(seen) == len(set(seen)) < 400 and {(i, j) for j in range(len(titles)) for i in range(j) if ratio(titles[j], titles[i]) >= 0.92} <= set(seen)
    assert {(i, j) for i, j in seen if i < 100 <= j} == {(i, j + 100) for i, j in dedup.may_match(titles[:100], titles[100:])}
    monkeypatch.setattr(dedup, "BLOCK_TITLES", 16)
    df = spark.createDataFrame(rows, "canonical_url string, seq long, domain string, title string")
    want = given_up(rows)
    assert {r.canonical_url: r.kept_as for r in dedup.near_titles(df).collect()} == want and len(want) > 50


def test_collapsed_candidates(spark):
    sf = "/root/testdata/sf0.01"
    found = dedup.by_url(vw.results(spark, sf)).select("canonical_url", "seq", "domain", "title", "sub_questions").collect()
    want = given_up([(r.canonical_url, r.seq, r.domain, r.title) for r in found])
    got = {r.canonical_url: r for r in entry.queries()["collapsed_candidates"](spark, sf).collect()}
    assert set(got) == {r.canonical_url for r in found} - set(want) and sum(r.merged for r in got.values()) == len(want) > 0
    for r in found:
        assert set(r.sub_questions) <= set(got[want.get(r.canonical_url, r.canonical_url)].sub_questions)


def test_folds(spark):
    rows = spark.createDataFrame([("a", i, c, 1.0) for i, c in enumerate([40.0, 70.0, 50.0, 10.0, 1.0])] + [("b", 9, 101.0, 1.0)], "k string, i int, c double, n double").repartition(5)
    assert {(r.k, r.i): r.granted for r in accounts.reservations(rows, "k", "i", "c", 100.0).collect()} == {("a", 0): True, ("a", 1): False, ("a", 2): True, ("a", 3): True, ("a", 4): False, ("b", 9): False}
    assert {(r.k, r.i): r.refused for r in accounts.first_refused(rows, "k", "i", {"n": 2, "c": 100.0}).collect()} == {("a", 0): None, ("a", 1): "c", ("a", 2): None, ("a", 3): "n", ("a", 4): "n", ("b", 9): "c"}
    assert accounts.reservations(rows.limit(0), "k", "i", "c", 1.0).count() == 0


def test_payloads(spark):
    rows = spark.createDataFrame([(1, '{"a": {"Token": 1, "b": ["x", "sk-' + "a" * 32 + '"]}}'), (2, None), (3, "[]")], "id long, body string")
    got = sorted((r.id, r.path, r.fault) for r in captures.payload_faults(captures.json_nodes(rows, "id", "body"), "id").collect() if r.path)
    assert got == [(1, "$.a.Token", "forbidden key"), (1, "$.a.b[1]", "credential")]
    assert [r.id for r in captures.payload_faults(captures.json_nodes(rows, "id", "body"), "id").where("fault = 'unreadable'").collect()] == [2]
