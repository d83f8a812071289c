import random

import numpy as np
import pytest

from attestor.llm import near_dedup
from attestor.llm.common import written
from attestor.llm.near_dedup import Shingler, band_rows, components, least_matches, near_duplicates, op10_near_dedup, posterior_at_least, signature


def shingles(text):
    w = [x for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    """(doc_id, n, component) by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    counts = {}
    seen = {}
    for i, s in sets.items():
        key = frozenset(s)
        seen.setdefault(key, []).append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    reps = [min(v) for k, v in seen.items() if k]
    for k, v in seen.items():
        if k:
            for i in v:
                a, b = find(i), find(min(v))
                parent[max(a, b)] = min(a, b)
    rep = set(reps)
    for h in holders.values():
        h = [i for i in h if i in rep]
        for x in range(len(h)):
            for y in range(x):
                counts[h[y], h[x]] = counts.get((h[y], h[x]), 0) + 1
    for (a, b), n in counts.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_shingles_and_signatures():
    s = Shingler()
    for t in (None, "", " \t\n", "a b", "A b  C d e f", "x " * 40, " no-break stays"):
        assert len(s.of(t)) == len(shingles(t))
    assert (s.of("THE Cat") == s.of("the\tcat")).all()
    a, b = s.of(" ".join(map(str, range(400)))), s.of(" ".join(map(str, range(40, 440))))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((signature(a) == signature(b)).mean() - true) < 0.13


def test_posterior():
    assert posterior_at_least(0.5, 5, 10) == pytest.approx(0.5)
    for n, m in least_matches(0.85, 1e-6):
        assert posterior_at_least(0.85, m, n) >= 1e-6 and (m == 0 or posterior_at_least(0.85, m - 1, n) < 1e-6)


def test_band_rows():
    assert [band_rows(t) for t in (0.8, 0.85)] == [6, 7] and band_rows(0.05) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300), (300, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), written).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {200: 100, 300: 100}


def varied(rng, n):
    """Texts with copies, chains, a large group of near copies and a passage that many share."""
    word = lambda: "w%d" % rng.randrange(3000)
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(60)]
    texts = []
    for i in range(n):
        kind = i % 5
        if kind == 0:
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = word()
        elif kind == 1:
            t = [*(word() for _ in range(rng.randrange(5, 60))), *passage]
        elif kind == 2 and texts:
            t = list(rng.choice(texts).split())
            if t and rng.random() < 0.7:
                t[rng.randrange(len(t))] = word()
        else:
            t = [word() for _ in range(rng.randrange(1, 150))]
        texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize("percent", [80, 85])
def test_against_all_pairs(spark, percent):
    rows = list(enumerate(varied(random.Random(percent), 600)))
    rows += [(9000, None), (9001, ""), (9002, " \n "), (9003, "one two"), (9004, "ONE  two"), (9005, "word " * 50_000), (9006, "word " * 40_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, sig int")
    want = brute(rows, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, percent).collect()}
    assert got == want


def test_far_pair_in_one_bucket(spark, monkeypatch):
    """One bucket of 1000 classes whose only true pair is neither with the hub nor among near rows of the bucket."""
    near, far = 400, 900
    rng = np.random.default_rng(7)
    sigs = rng.integers(0, 2**16, (1000, near_dedup.HASHES), dtype=np.uint16)
    sigs[far] = sigs[near]
    text = lambda i: " ".join(f"w{near if i == far else i}x{k}" for k in range(40)) + (" end" if i == far else "")
    rows = [(i, text(i)) for i in range(1000)]
    sketches = [(i, len(shingles(t)), i.to_bytes(4, "big"), sigs[i].tobytes(), [1]) for i, t in rows]
    sketches = spark.createDataFrame(sketches, "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>")
    monkeypatch.setattr(near_dedup, "sketched", lambda docs, rows: sketches)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, 85).collect()}
    assert got == {i: near if i == far else i for i in range(1000)}


def test_blocks_and_fans(spark, monkeypatch):
    """The same result where buckets are cut into many blocks and hubs into many parts."""
    rows = list(enumerate(varied(random.Random(5), 400)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in (("BLOCK", 7), ("SHINGLES", 900), ("FAN", 5), ("BROADCAST_IDS", 0)):
        monkeypatch.setattr(near_dedup, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, 80).collect()}
    assert got == brute(rows, 80)


def test_drifted_family(spark):
    """A family in which many pairs lie just under the threshold, so that hubs settle little of it."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(rng.randrange(9)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == brute(rows, 85)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(df).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10_near_dedup(spark, sf).collect()}
    assert got == brute(rows, 85)
