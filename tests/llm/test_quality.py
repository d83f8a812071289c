import numpy as np
from pyspark.sql import functions as F

from attestor.llm.quality import BINS, FOURIER, RIDGE, STATISTICS, described, fit, isotonic, op7_quality, projections, scored, statistics, with_score

SF = "/root/testdata/sf0.1"


def test_statistics():
    assert len(statistics("The end. The end.\nThe end!! |")) == len(STATISTICS)
    assert not any(statistics(None)) and not any(statistics(" \n"))
    assert statistics("word")[STATISTICS.index("repeated_pair_share")] == 0


def test_names_in_other_cases(spark):
    """Columns named like the new ones, in any case of letters, are replaced, and what is left can be used."""
    docs = spark.createDataFrame([(i, "some plain words here." if i % 2 else "WORD!! $$$ WORD!!", 5.0, 6.0) for i in range(60)], "doc_id long, text string, Score double, STATS double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    stats = described(docs, keep=("doc_id", "Score", "STATS"))
    assert stats.columns == ["doc_id", "Score", "stats"]
    model = fit(stats, labels)
    for out in (scored(stats, model), with_score(docs.drop("STATS"), model)):
        assert "Score" not in out.columns and out.select("doc_id", "score").where("score >= 0.5").count() == 30


def test_word_pairs_of_both_parities():
    """The pair a b stands once at an even place and once at an odd one."""
    share = STATISTICS.index("repeated_pair_share")
    assert abs(statistics("x a b y a b")[share] - 0.2) < 1e-12 and statistics("a b c d")[share] == 0


def test_isotonic():
    good, total = np.array([0, 3, 0, 1, 9, 0]), np.array([4, 4, 0, 4, 9, 0])
    p = isotonic(good.astype(float), total.astype(float))
    assert (np.diff(p) >= 0).all() and p[1] == p[3] == 4.5 / 9 and p[5] == p[4] == 9.5 / 10


def test_held_out_accuracy(spark):
    out = op7_quality(spark, SF)
    assert out.count() == 10_000
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    y, p, s = (np.array([r[c] for r in rows]) for c in ("quality", "predicted", "score"))
    order = np.argsort(s)
    ranks = np.empty(len(s))
    ranks[order] = np.arange(len(s))
    auc = (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    print("accuracy", (y == p).mean(), "AUC", auc, "clean kept", p[y == 1].mean(), "junk dropped", 1 - p[y == 0].mean())
    assert (y == p).mean() > 0.95 and auc > 0.97


def test_rows(spark):
    docs = spark.createDataFrame([(i, "some plain words here." if i % 2 else "WORD!! WORD!! $$$ WORD!!", 5.0) for i in range(60)] + [(100, None, 1.0), (101, "", 1.0), (102, "word " * 200_000, 1.0), (102, "word " * 200_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, None), (7, 1)], "doc_id long, quality int")
    stats = described(docs, keep=("doc_id", "score"))
    got = scored(stats, fit(stats, labels)).collect()
    assert len(got) == 64 and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got if r.doc_id < 60)
    assert {r.score for r in scored(stats, fit(stats, labels.where("quality = 1"))).collect()} == {1.0}
    assert {r.score for r in scored(stats, fit(stats, labels.limit(0))).collect()} == {0.5}
    assert scored(stats.limit(0), fit(stats, labels)).count() == 0


def test_fit_and_scores_against_plain_code(spark):
    """The model from sums over partitions equals one from all rows at once, and every score is that of plain code."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stats = described(docs)
    model = fit(stats, labels)
    text = {r.doc_id: r.text for r in docs.collect()}
    label = {r.doc_id: float(r.quality > 0) for r in labels.collect()}
    known = sorted(label)
    x, y = np.array([statistics(text[i]) for i in known]), np.array([label[i] for i in known])
    center, spread = x.mean(axis=0), x.std(axis=0)
    assert np.allclose(model.center, center, atol=1e-6) and np.allclose(model.spread, np.maximum(spread, 1e-6), atol=1e-6)
    z = np.clip((x - model.center) / model.spread, -6, 6) @ projections(x.shape[1])
    f = np.hstack([np.cos(z) * np.sqrt(2 / FOURIER), np.sin(z) * np.sqrt(2 / FOURIER), np.ones((len(x), 1))])
    w = np.where(y > 0, 0.5 * len(y) / y.sum(), 0.5 * len(y) / (len(y) - y.sum()))
    weights = np.linalg.solve((f * w[:, None]).T @ f + RIDGE * np.eye(f.shape[1]), (f * w[:, None]).T @ y)
    assert np.allclose(model.weights, weights, atol=1e-5)
    # The table is made of scores of each half by weights that were solved from the other one.
    half = {r.doc_id: abs(r.h) % 2 for r in stats.select("doc_id", F.xxhash64("stats").alias("h")).collect()}
    own = np.array([half[i] for i in known])
    raw = np.zeros(len(known))
    for side in (0, 1):
        g, v, t = f[own != side], w[own != side], y[own != side]
        raw[own == side] = f[own == side] @ np.linalg.solve((g * v[:, None]).T @ g + RIDGE * np.eye(f.shape[1]), (g * v[:, None]).T @ t)
    bins = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
    steps = isotonic(np.bincount(bins, y, BINS), np.bincount(bins, minlength=BINS))
    assert np.abs(steps - model.steps).max() < 0.05 and (np.diff(model.steps) >= 0).all()
    for r in scored(stats, model).collect():
        raw = float(model.fourier(np.array([statistics(text[r.doc_id])]))[0] @ model.weights)
        near = [model.steps[min(max(int((raw + e + 0.5) / 2 * BINS), 0), BINS - 1)] for e in (-1e-9, 0, 1e-9)]
        assert min(abs(r.score - n) for n in near) < 1e-8
