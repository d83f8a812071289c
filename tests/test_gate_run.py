"""The verification run against a replay claim by claim in plain loops; what single wording functions say is asked of these."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from attestor.functions import lexicon as lx
from attestor.functions import matching, wording
from attestor.operators import answers, gate_run, publishing
from attestor.plans import gated
from attestor.sources import store

SF = "/root/testdata/sf0.01"


def replay(spark, i):
    claims = [r.asDict() for r in i.claims.collect()]
    evidence = {r.evidence_id: r for r in i.evidence.collect()}
    contracts = {r.question_id: r for r in i.contracts.collect()}
    scores = defaultdict(dict)
    for r in i.scores.collect():
        scores[r.claim_id, r.attempt, r.part][r.quote_id] = r
    rewrites, judged = defaultdict(list), defaultdict(list)
    for r in i.rewrites.collect():
        rewrites[r.claim_id].append(r.rewritten)
    for r in i.judgements.collect():
        judged[r.claim_id].append((r.relevant, r.why))
    for c in claims:
        c["quotes"] = list(dict.fromkeys(e for e in c["evidence_ids"] if e in evidence and evidence[e].quote_match == "exact"))
        c["texts"] = {0: c["text"]} | ({1: min(rewrites[c["claim_id"]]).strip()} if rewrites[c["claim_id"]] else {})
        c["said"] = " ".join(evidence[e].quote for e in sorted(c["quotes"]))

    # What the single functions say, for all texts at once.
    texts = spark.createDataFrame([(c["claim_id"], a, t, c["text"], c["slot"], c["said"], *([k.question, k.question_type, k.entities, k.slots, k.usable] if (k := contracts.get(c["question_id"])) else [None, None, [], [], False])) for c in claims for a, t in c["texts"].items()],
                                  "claim_id long, attempt int, text string, original string, slot string, said string, question string, question_type string, entities array<string>, slots array<string>, usable boolean")
    fault = wording.relevance(F.col("text"), F.col("slot"), F.col("said"), F.col("question"), F.col("question_type"), F.col("entities"), F.col("slots"), F.col("usable"))
    words = tx_words(texts)
    told = {(r.claim_id, r.attempt): r for r in texts.select("claim_id", "attempt", matching.propositions("text").alias("parts"), fault.alias("fault"), wording.rewrite_fault(F.col("original"), F.col("text")).alias("wrong")).collect()}
    pairs = [(c["claim_id"], a, n, p, e, evidence[e].quote, evidence[e].domain) for c in claims for a in c["texts"] for n, p in enumerate(told[c["claim_id"], a].parts) for e in c["quotes"]]
    found = spark.createDataFrame(pairs, "claim_id long, attempt int, part int, said string, quote_id string, quote string, domain string")
    failed = {(r.claim_id, r.attempt, r.part, r.quote_id): [g["name"] for g in r.g if not g["passed"]] for r in found.select("claim_id", "attempt", "part", "quote_id", wording.run_guards(F.col("said"), F.col("quote"), F.col("domain")).alias("g")).collect()}

    def entailed(c, attempt):
        """(supported, checked, reason, entailed whatever the guards say)"""
        parts = told[c["claim_id"], attempt].parts
        if not parts:
            return False, False, "states nothing", False
        ok, any_score, high_parts, refused = 0, True, 0, set()
        for n in range(len(parts)):
            own = {e: s for e, s in scores[c["claim_id"], attempt, n].items() if e in c["quotes"] and abs(s.entailment + s.neutral + s.contradiction - 1) <= 0.02 and not math.isnan(s.entailment)}
            any_score &= bool(own)
            high = [e for e, s in own.items() if s.entailment >= 0.98]
            high_parts += bool(high)
            names = [failed[c["claim_id"], attempt, n, e] for e in high]
            if any(not x for x in names):
                ok += 1
            else:
                refused |= {x for own_names in names for x in own_names}
        if ok == len(parts):
            return True, True, "", True
        if not any_score:
            return False, False, "a part has no valid score", high_parts == len(parts)
        return False, True, "withheld by deterministic guards: " + ", ".join(sorted(refused)) if refused else "below threshold", high_parts == len(parts)

    out, seen, restated = {}, set(), set()
    for c in sorted(claims, key=lambda c: (["summary", "finding", "section"].index(c["placement"]), c["claim_id"])):
        def end(state, reason="", text=c["text"], repaired=False, c=c):
            out[c["claim_id"]] = (c["question_id"], c["kind"], text, repaired, state, reason)

        if c["kind"] != "framing":
            norm = (re.sub(r"[. ]+$", "", " ".join(c["text"].lower().split())), tuple(c["quotes"]))
            key = ((c["slot"] or "").strip(), tuple(words[c["claim_id"]]))
            first = norm not in seen
            seen.add(norm)
            again = first and key[0] and key[1] and key in restated
            if first:
                restated.add(key)
            if c["kind"] == "substantive" and (not first or again):
                end("duplicate")
                continue
        if c["kind"] != "substantive":
            end("passed")
        elif not c["quotes"]:
            end("no evidence")
        elif len(c["quotes"]) > 8:
            end("too many quotes")
        else:
            supported, checked, reason, all_entailed = entailed(c, 0)
            text, repaired = c["text"], False
            if supported and told[c["claim_id"], 0].fault:
                end("irrelevant", told[c["claim_id"], 0].fault)
                continue
            if not supported:
                if not checked:
                    end("not checked", reason)
                    continue
                names = reason.partition("guards: ")[2].split(", ") if "guards" in reason else []
                if not (all_entailed and names and set(names) <= {"attribution", "atomicity", "numeric", "modality", "ranking"}):
                    end("unsupported", reason)
                    continue
                if 1 not in c["texts"]:
                    refusal = "no rewrite"
                elif (refusal := told[c["claim_id"], 1].wrong) is None:
                    healed, _, still, _ = entailed(c, 1)
                    fault_now = told[c["claim_id"], 1].fault
                    refusal = f"still unsupported: {still}" if not healed else f"still irrelevant: {fault_now}" if fault_now else None
                if refusal:
                    end("repair refused", f"{reason}; {refusal}")
                    continue
                text, repaired = c["texts"][1], True
            k = contracts[c["question_id"]]
            verdict = min(judged[c["claim_id"]], default=(None, None))
            core = not c["slot"] or c["slot"] not in k.slots or c["slot"] in k.core or (k.question_type == "comparison" and c["slot"] == "relationship")
            if verdict[0] or not core:
                end("published", "", text, repaired)
            else:
                end("withheld", verdict[1] or "no judgement", text, repaired)
    return out


def tx_words(texts):
    from attestor.functions import text as tx

    return {r.claim_id: r.w for r in texts.where("attempt = 0").select("claim_id", tx.content_words(F.col("text"), lx.FUNCTION_WORDS).alias("w")).collect()}


def rows_of(df):
    return {r.claim_id: (r.question_id, r.kind, r.text, r.repaired, r.state, r.reason) for r in df.collect()}


def adds_up(counts):
    for r in counts:
        assert r.generated == r.duplicates + r.structural + r.checkable and r.checkable == r.not_checked + r.checked and r.checked == r.supported + r.unsupported
        assert r.supported == r.published + r.irrelevant + r.withheld and r.refused_repairs <= r.unsupported and r.repaired <= r.supported


def test_run_equals_replay_over_passages(spark):
    i = gated.inputs(spark, SF)
    ended = gate_run.run(i.claims, i.evidence, i.contracts, i.scores, i.rewrites, i.judgements)
    got = rows_of(ended)
    assert got == replay(spark, i) and len(got) == i.claims.count()
    states = Counter(x[4] for x in got.values())
    print(states)
    assert {"passed", "duplicate", "no evidence", "not checked", "unsupported", "repair refused", "irrelevant", "withheld", "published"} == set(states) and any(x[3] for x in got.values())
    adds_up(gate_run.counts(ended).collect())


def made(spark, claims, scores, rewrites, judgements, contracts=None, evidence=None):
    evidence = evidence or [(f"e{n}", "S1", f"Kafka keeps data in a log on disk, with {n + 10} nodes.", "exact", "kafka.apache.org", 0, 0.5) for n in range(12)] + [("f1", "S1", "Kafka keeps data.", "fuzzy", "x.org", 0, 0.5)]
    slots = {k: [s for s, _ in own] for k, own in answers.SLOTS.items()}
    contracts = contracts or [(q, "What is Kafka?", t, ["Kafka"], slots[t], [s for s, c in answers.SLOTS[t] if c], True) for q, t in ((1, "definition"), (2, "comparison"))] + [(3, "What is Kafka?", "definition", [], [], [], False)]
    return gated.Inputs(
        spark.createDataFrame(claims, "claim_id long, question_id long, placement string, kind string, slot string, text string, evidence_ids array<string>"),
        spark.createDataFrame(evidence, "evidence_id string, source_id string, quote string, quote_match string, domain string, rank int, quality double"),
        spark.createDataFrame(contracts, "question_id long, question string, question_type string, entities array<string>, slots array<string>, core array<string>, usable boolean"),
        spark.createDataFrame(scores, "claim_id long, attempt int, part int, quote_id string, entailment double, neutral double, contradiction double"),
        spark.createDataFrame(rewrites, "claim_id long, rewritten string"), spark.createDataFrame(judgements, "claim_id long, relevant boolean, why string"),
    )


def test_every_way_out(spark):
    """Each state by a claim of its own, by hand; then the replay over the same rows."""
    yes = lambda c, a=0, part=0, q="e0": (c, a, part, q, 0.99, 0.01, 0.0)
    text = "Kafka keeps data in a log on disk"
    claims = [
        (1, 1, "summary", "substantive", "definition", text, ["e0", "gone", "f1"]), (2, 1, "finding", "substantive", "definition", text + ".", ["e0"]), (3, 1, "finding", "framing", "", text, []), (4, 1, "finding", "substantive", "definition", text + " now", ["gone"]),
        (5, 1, "finding", "substantive", "definition", text + " there", [f"e{n}" for n in range(9)]), (6, 1, "finding", "substantive", "definition", text + " still", ["e1"]), (7, 1, "finding", "substantive", "definition", "Kafka keeps data on 99 disks", ["e1"]),
        (8, 1, "finding", "substantive", "definition", "Kafka keeps data on 98 disks", ["e2"]), (9, 1, "finding", "substantive", "definition", "Kafka keeps data on 97 disks", ["e3"]), (10, 2, "finding", "substantive", "dimension", text, ["e4"]),
        (11, 2, "finding", "substantive", "relationship", text, ["e5"]), (12, 2, "finding", "substantive", "nowhere", text, ["e6"]), (13, 3, "finding", "substantive", "", text, ["e7"]), (14, 1, "finding", "substantive", "distinguishing_property", "Only Kafka keeps data", ["e8"]),
        (15, 1, "finding", "substantive", None, "Kafka keeps data there", ["e9"]), (16, 2, "section", "substantive", "direct_contrast", "Kafka is a log", ["e10"]), (17, 99, "section", "substantive", "", "Kafka keeps logs", ["e11"]),
    ]
    scores = [yes(c, 0, 0, q) for c, q in ((1, "e0"), (7, "e1"), (8, "e2"), (9, "e3"), (10, "e4"), (11, "e5"), (12, "e6"), (13, "e7"), (14, "e8"), (16, "e10"), (17, "e11"))] + [yes(7, 1, 0, "e1"), (15, 0, 0, "e9", 0.4, 0.6, 0.0), (6, 0, 0, "e1", 0.99, 0.9, 0.0)]
    rewrites = [(7, " Kafka keeps data on disks "), (8, "Kafka keeps data on 96 disks"), (7, "Kafka keeps data on more disks"), (1, "Kafka")]
    i = made(spark, claims, scores, rewrites, [(1, True, ""), (7, True, ""), (7, True, "b"), (10, False, "narrow"), (11, False, "narrow"), (12, True, ""), (16, True, "")])
    ended = gate_run.run(i.claims, i.evidence, i.contracts, i.scores, i.rewrites, i.judgements)
    got = rows_of(ended)
    state = {c: x[4] for c, x in got.items()}
    assert state == {1: "published", 2: "published", 3: "passed", 4: "no evidence", 5: "too many quotes", 6: "not checked", 7: "published", 8: "repair refused", 9: "repair refused", 10: "published", 11: "withheld", 12: "irrelevant", 13: "irrelevant", 14: "unsupported", 15: "unsupported", 16: "irrelevant", 17: "irrelevant"} | {2: "duplicate"}
    assert got[7][2:4] == ("Kafka keeps data on disks", True) and got[16][5] == "no contrast" and got[13][5] == "no contract" and got[9][5].endswith("no rewrite") and got[8][5].endswith("new number")
    assert got == replay(spark, i)
    adds_up(gate_run.counts(ended).collect())


def test_contract_relevance_and_coverage_in_a_row(spark):
    """The slots that a contract asks for are those that relevance takes and coverage counts, for every type of question."""
    q = spark.createDataFrame([(n, k, None, ["Kafka", "Redis"], False) for n, k in enumerate(answers.SLOTS)], "question_id int, told string, shape string, entities array<string>, ambiguous boolean")
    contracts = publishing.contracts(q).withColumn("entities", F.array(F.lit("Kafka"), F.lit("Redis")))
    assert contracts.where("usable and size(core) = 1").count() == len(answers.SLOTS)
    claims = contracts.select("*", F.explode(F.array_union("slots", F.array(F.lit("contrast")))).alias("slot"))
    text = F.lit("Kafka is faster than Redis.")
    rel = claims.withColumn("fault", wording.relevance(text, F.col("slot"), text, F.lit("Kafka and Redis"), F.col("question_type"), F.col("entities"), F.col("slots"), F.col("usable")))
    assert {r.slot for r in rel.where("fault = 'slot not asked for'").collect()} == {"contrast"}
    published = rel.where("fault is null").select("question_id", "slot")
    got = answers.answer_coverage(answers.slots(contracts.select("question_id", "question_type")), published).collect()
    assert len(got) == len(answers.SLOTS) and all(r.answered and r.missing == 0 for r in got)
    plain = rel.where("slot = 'direct_contrast'").withColumn("f", wording.relevance(F.lit("Kafka is a log."), F.col("slot"), F.lit("Redis"), F.lit(""), F.col("question_type"), F.col("entities"), F.col("slots"), F.col("usable")))
    assert [r.f for r in plain.collect()] == ["no contrast"]


def test_empty(spark):
    i = made(spark, [], [], [], [])
    ended = gate_run.run(i.claims, i.evidence, i.contracts, i.scores, i.rewrites, i.judgements)
    assert ended.count() == 0 and gate_run.counts(ended).count() == 0


def test_wording_queries_make_no_scores(spark, monkeypatch):
    names, write = [], store.written

    def noted(df, name):
        names.append(name)
        return write(df, name)

    monkeypatch.setattr(store, "written", noted)
    assert entry.queries()["rewrite_faults"](spark, "/root/testdata/sf0.001").columns == ["claim_id", "fault", "before", "after"]
    assert "gated_claims" in names and "scores" not in names
