"""Results that must be those of the SQL where tables are dealt otherwise, hold close quotes or end in halves."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from attestor.operators import measure, quotes
from parity import connect, difference

SF = "/root/testdata/sf0.001"


def test_sums_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    prices = [186716.08, 215519.22, 33555.52, 62380.79, 211176.79, 242813.95, 1007.15]
    rows = pd.DataFrame({"o_orderkey": range(7), "o_custkey": 3, "o_totalprice": prices})
    got = []
    for name, table in (("up", rows), ("down", rows[::-1])):
        (tmp_path / name).mkdir()
        table.to_parquet(tmp_path / name / "orders.parquet", index=False)
        got.append([tuple(r) for r in entry.queries()["affordable_runs"](spark, str(tmp_path / name)).collect()])
    assert got[0] == got[1] == [(3, 95317, 95317 // 15000)]
    assert difference(spark, connect(tmp_path / "up"), "", entry.queries()["affordable_runs"], entry.oracle_sql()["affordable_runs"], str(tmp_path / "up")) == ""


@pytest.fixture(scope="module")
def with_close(tmp_path_factory):
    """The small tables, with documents that come close to a passage without holding it."""
    at = tmp_path_factory.mktemp("close")
    for name in ("benchmark", "conversations", "pages", "orders", "labels"):
        (at / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    docs, items = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/benchmark.parquet")
    for i in range(3):
        q = items.text[i]
        docs.loc[i, "text"] = q[:40] + "#" + q[41:]
    docs.to_parquet(at / "documents.parquet", index=False)
    return str(at)


@pytest.mark.parametrize("name", ["quote_fidelity", "evaluation_metrics"])
def test_close_quotes_fail_as_in_sql(spark, with_close, name):
    assert "fuzzy" in {r.quote_match for r in entry.queries()["quote_classes"](spark, with_close).collect()}
    assert difference(spark, connect(with_close), name, entry.queries()[name], entry.oracle_sql()[name], with_close) == ""


def test_rounding_scales_first(spark):
    values = [i / 100 * 0.15 for i in range(100)]
    want = [int(x * 1000 + 0.5) / 1000 for x in values]
    got = spark.createDataFrame([(x,) for x in values], "x double").select(measure.rounded(F.col("x"), 3), F.round("x", 3)).collect()
    assert [r[0] for r in got] == want and [r[1] for r in got] != want


def test_exact_places_by_an_automaton(spark):
    """Long quotes with one beginning, quotes inside others, several places, and copies of a quote."""
    head = "the same forty characters and then some more: "
    asked = [head + "one", head + "two", head.strip(), "forty characters", "too short", head + "one", "characters and  THEN"]
    texts = [f"x {head}two, {head}one. forty characters", head, None, "", "forty charactersforty characters"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.quote_match, r.offset) for r in quotes.located(d, b, close=False).collect()}
    low = [quotes.matching_form(q) for q in asked]
    assert got == {(i, k, "exact", t.lower().index(q)) for i, t in enumerate(texts) if t for k, q in enumerate(low) if len(q) >= 12 and q in t.lower()}
    assert quotes.located(d, b.limit(0), close=False).count() == 0


def test_evidence_is_made_once(spark, monkeypatch):
    made = []
    held = quotes.located
    monkeypatch.setattr(quotes, "located", lambda *a, **k: made.append(1) or held(*a, **k))
    entry.queries()["claim_judgments"](spark, SF)
    assert len(made) == 1


def test_shared_runs(spark):
    asked = ["a b c d", "c d e", "a b", "", None, "x  y z", "a b c a b c"]
    texts = ["z a b c", "c d", None, "", "x  y z", "b c d e", "a b c d e"]
    d, b = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    runs = lambda t: {tuple(t.split(" ")[i : i + 3]) for i in range(len(t.split(" ")) - 2)} if t is not None else set()
    got = [tuple(r) for r in quotes.shared_runs(d, b).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, k) for i, t in enumerate(texts) for k, q in enumerate(asked) if runs(t) & runs(q)}


def test_each_wording_is_judged_once(spark, monkeypatch):
    from attestor.sources import store

    kept, held = {}, store.written
    monkeypatch.setattr(store, "written", lambda df, name: kept.setdefault(name, held(df, name)))
    n = entry.queries()["passage_guards"](spark, SF).count()
    cited, judged = kept["cited_quotes"], kept["judged_quotes"]
    assert n == 9 * cited.count() and judged.count() == cited.select("text", "quote", "domain").distinct().count()


def test_titles_are_not_broadcast(spark):
    """Tables that grow with the candidates go to no driver, however well their files compress."""
    from attestor.operators import dedup

    rows = [(f"u{i}", i, "d", f"a title of some length {i % 7}", 0.5, ["SQ1"]) for i in range(20)]
    c = spark.createDataFrame(rows, "canonical_url string, seq long, domain string, title string, best_score double, sub_questions array<string>")
    out = dedup.collapsed(c)
    assert out.count() == 7 and "BroadcastHashJoin" not in out._jdf.queryExecution().toString()


def test_gate_broadcasts_passages_only(spark, monkeypatch):
    """What grows with claims, evidence or sources meets in shuffled joins, however small its files are."""
    from attestor.sources import store

    plans, held = {}, store.written
    monkeypatch.setattr(store, "written", lambda df, name: plans.setdefault(name, []).append(df._jdf.queryExecution().toString()) or held(df, name))
    out = entry.queries()["gate_counts"](spark, SF)
    plans["counts"] = [out._jdf.queryExecution().toString()]
    assert {"scores", "resolved", "quotes", "first_pass", "repairs", "counts"} < set(plans)
    assert {name for name, of in plans.items() if any("BroadcastHashJoin" in p for p in of)} <= {"evidence", "gated_claims"}
