from collections import Counter

import numpy as np

from attestor.llm.toxicity import WORDS, TOXIC_FROM, counts_of, cover, features_of_word, fit, fit_ordinal, graded, op5_toxicity, scored, sparse

SF = "/root/testdata/sf0.01"


def test_features():
    assert counts_of("Loud loudly, LOUD 4x") == {"=loud": 2, "lou*": 3, "loud*": 1, "=loudly": 1, "loudl*": 1, "=x": 1}
    assert not counts_of(None)


def test_thresholds_share_weights_and_stay_in_order():
    rng = np.random.default_rng(0)
    x = rng.exponential(size=(4000, 2))
    z = 2 * x[:, 0] - x[:, 1] + rng.logistic(size=4000)
    w, t = fit_ordinal(sparse(x), np.digitize(z, [0.0, 1.0, 3.0]), penalty=0.0, rounds=3000)
    assert np.allclose(w, [2, -1], atol=0.15) and np.allclose(t, [0, 1, 3], atol=0.2)


def test_cover_against_counting_anew():
    """The lazy cover chooses as one that counts all gains in every round."""
    rng = np.random.default_rng(5)
    toxic = [{f"={'abcdefgh'[i]}{'xyz'[j]}" for i, j in rng.integers(0, (8, 3), (4, 2))} for _ in range(80)]
    clean = Counter({"=ax": 2, "=by": 1})
    left, chosen, held = sorted(set.union(*toxic)), [], [0] * len(toxic)
    while True:
        gain = {f: sum(f in t and h < 3 for t, h in zip(toxic, held)) - 4 * clean[f] for f in left if not any(f[1:].startswith(c[1:]) or c[1:].startswith(f[1:]) for c in chosen)}
        best = min(gain, key=lambda f: (-gain[f], len(f), f), default=None)
        if best is None or gain[best] < 3:
            break
        chosen.append(best)
        held = [h + (best in t) for t, h in zip(toxic, held)]
    assert chosen and cover(toxic, clean, 3) == chosen


def test_grades_out_of_fold():
    rng = np.random.default_rng(1)
    toxic = np.arange(600) % 2 < 1
    toxic = np.repeat(toxic[:300], 2)
    x = sparse(np.where(toxic[:, None], rng.integers(1, 4, (600, 3)), rng.integers(0, 2, (600, 3))).astype(float))
    grade = graded(x, toxic)
    assert not grade[~toxic].any() and {1, 2, 3} == set(grade[toxic]) and all(60 < (grade == g).sum() < 140 for g in (1, 2, 3))


def test_scores_against_plain_code(spark):
    """severity and probability by the formula, word by word."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in scored(docs, model).collect():
        n = Counter(f for w in WORDS.findall((text[r.doc_id] or "").lower()) for f in features_of_word(w) if f in model.cues)
        z = sum(model.weights[model.cues[f]] * np.log1p(c) for f, c in n.items())
        over = 1 / (1 + np.exp(-(z - model.thresholds)))
        assert abs(r.severity - over.sum()) < 1e-6 and abs(r.toxic_probability - over[0]) < 1e-6 and r.toxic == (r.toxic_probability >= TOXIC_FROM)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = fit(docs, labels.where("crc32(cast(doc_id as string)) % 4 <> 0"))
    rows = scored(docs, model).join(labels.where("crc32(cast(doc_id as string)) % 4 = 0").withColumnRenamed("toxic", "label"), "doc_id").collect()
    wrong = [r for r in rows if r.toxic != (r.label == 1)]
    assert len(rows) > 60 and len(wrong) <= 0.08 * len(rows) and not any(r.toxic and not r.label for r in rows)


def test_rows(spark):
    docs = spark.createDataFrame([(i, f"word{'s' * (i % 5)} plain text vile" if i % 3 == 0 else "plain words of text", 9.0) for i in range(90)] + [(500, None, 1.0), (501, "", 1.0), (502, "VILE! " * 50_000, 1.0), (502, "VILE! " * 50_000, 1.0)], "doc_id long, text string, severity double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = fit(docs, labels)
    out = scored(docs, model).collect()
    assert len(out) == 94 and out[0].severity != 9.0
    assert {r.doc_id for r in out if r.toxic} == {i for i in range(90) if i % 3 == 0} | {502}
    assert max(r.severity for r in out if r.doc_id == 502) > max(r.severity for r in out if r.doc_id == 3)
    none = fit(docs, labels.where("toxic = 0"))
    assert not any(r.toxic or r.severity for r in scored(docs, none).collect())
    assert scored(docs.limit(0), model).count() == 0


def test_query(spark):
    rows = op5_toxicity(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.severity <= 3 for r in rows)
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    missed = [r.doc_id for r in rows if label.get(r.doc_id) == 1 and not r.toxic]
    assert len(missed) <= 16  # some labels have no cue at all, and stems of few documents are not learnt
    assert not [r.doc_id for r in rows if label.get(r.doc_id) == 0 and r.toxic]


def test_names_in_other_cases(spark):
    """Columns named like the new ones, in any case of letters, are replaced, and what is left can be used."""
    docs = spark.createDataFrame([(i, f"word{'s' * (i % 5)} plain text vile" if i % 2 else "plain words of text", "x", 1) for i in range(80)], "doc_id long, text string, Severity string, TOXIC int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    out = scored(docs, fit(docs, labels))
    assert out.columns == ["doc_id", "text", "severity", "toxic_probability", "grade", "toxic"]
    assert out.select("doc_id", "severity", "toxic").where("toxic").count() == 40
