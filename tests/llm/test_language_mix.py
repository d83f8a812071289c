import zlib
from itertools import combinations

import numpy as np
import pytest

from attestor.llm import language_mix
from attestor.llm.language_mix import PRICE, UNKNOWN, counted, identified, learn, op13_languages

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = op13_languages(spark, SF).join(docs, "doc_id").collect()
    assert len(out) == 10_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    right = np.mean([r.lang == r.lang_pred for r in held])
    print("held-out accuracy", right, "texts of several languages", np.mean([len(r.languages) > 1 for r in held]))
    assert right > 0.995


def test_counts_are_those_of_plain_code():
    """Two texts have equal counts where their letters, in lower case and parted by single spaces, are equal; the whole has as many n-grams as that form has places."""
    for text in ("Ab, cd!", "  Élan\n\nvital 42 x", "a", "ПРИВЕТ, мир", "1 2 3", "", None):
        form = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "
        form = form if form.strip() else " "
        assert counted(text)[1].sum() == max(0, len(form) - 2)
        again = counted(form)
        assert all((x == y).all() for x, y in zip(counted(text), again))


def test_pieces(monkeypatch):
    text = "Un texte, assez long; pour 7 morceaux! " * 9
    whole = counted(text)
    for size in (1, 2, 7, 50, len(text), len(text) - 1):
        monkeypatch.setattr(language_mix, "PIECE", size)
        assert all((x == y).all() for x, y in zip(whole, counted(text)))


def test_set_is_that_of_all_subsets(model, spark):
    """The chosen set has the greatest penalised likelihood of all subsets, each with proportions from EM in plain loops."""

    def em(p, times, steps=300):
        share = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(steps):
            share = share * (p / (p @ share)[:, None] * times[:, None]).sum(axis=0) / times.sum()
        return float(times @ np.log(p @ share))

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    of = {}
    for r in docs:
        of.setdefault(r.lang, []).append(r.text)
    texts = [r.text for r in docs[:60]] + [f"{a[:300]} {b[:300]}" for a, b in zip(of["en"][:15], of["fr"][:15])] + [f"{a[:500]} {b[:250]}" for a, b in zip(of["de"][:15], of["es"][:15])]
    same = 0
    for text in texts:
        bins, times = counted(text)
        p, price = model.chances[bins], PRICE * np.log(times.sum() + 1)
        sets = [list(c) for k in range(1, len(model.languages) + 1) for c in combinations(range(len(model.languages)), k)]
        best = max(sets, key=lambda c: em(p[:, c], times) - price * (len(c) - 1))
        same += sorted(model.mixture(text)[0]) == best
    assert same >= 0.97 * len(texts)


def test_mixtures_are_found(model, spark):
    of = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        of.setdefault(r.lang, []).append(r.text)
    right = 0
    for a, b in zip(of["en"][:40], of["fr"][:40]):
        chosen, share = model.mixture(a[:600] + "\n" + b[:600])
        right += sorted(model.languages[i] for i in chosen) == ["en", "fr"] and abs(share.sum() - 1) < 1e-6
    assert right >= 36


def test_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the of and in"), (4, "the of and in"), (None, "the of and in"), (5, "the of and in " * 200_000), (6, "漢字"), (7, "z")]
    docs = spark.createDataFrame([(i, t, "xx", 0.5) for i, t in rows], "doc_id long, text string, Lang_Pred string, Score double")
    got = identified(docs, model, keep=("doc_id", "Lang_Pred", "Score")).select("doc_id", "lang_pred", "score", "languages", "proportions").collect()
    of = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and of[4].lang_pred == of[None].lang_pred == of[5].lang_pred
    assert all(of[i].lang_pred == UNKNOWN and of[i].score == 0 and of[i].languages == [] for i in (1, 2, 3))
    assert all(of[i].lang_pred in model.languages for i in (4, 6, 7))
    assert identified(docs.limit(0), model).count() == 0


def test_learning(spark):
    docs = spark.createDataFrame([("aaa aaa", "b"), ("ccc ccc", "a"), ("zzz", None), (None, "c"), ("", "")], "text string, lang string")
    m = learn(docs)
    assert m.languages == ["", "a", "b", "c"] and np.allclose(m.chances.sum(axis=0), 1)
    assert m.languages[m.mixture("aaa")[0][0]] == "b" and m.languages[m.mixture("ccc")[0][0]] == "a"
    nothing = learn(docs.where("lang is null"))
    assert nothing.languages == [] and nothing.mixture("aaa")[0] == []
    one = identified(spark.createDataFrame([(1, "aaa")], "doc_id long, text string"), nothing).collect()[0]
    assert one.lang_pred == UNKNOWN and one.score == 0
