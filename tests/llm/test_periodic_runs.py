import hashlib
import random
import zlib

import numpy as np
import pytest

from attestor.llm.periodic_runs import kept_words, numbered, op11_periodic_runs, periodic, planted, runs_of

SF = "/root/testdata/sf0.01"


def brute(x, shortest=6, repeats=4):
    """For each period, the longest stretches whose items equal those a period later; those with a smaller period go."""
    out, n = [], len(x)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            stretch = x[i : j + q]
            if len(stretch) >= max(shortest, repeats * q) and not any(stretch[d:] == stretch[: len(stretch) - d] for d in range(1, q)):
                out.append((i, len(stretch), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(1000):
        letters = rnd.choice([1, 2, 2, 3, 5])
        x = [rnd.randrange(letters) for _ in range(rnd.randint(0, 50))]
        for _ in range(rnd.randint(0, 2)):
            root = [rnd.randrange(letters) for _ in range(rnd.randint(1, 7))]
            at = rnd.randint(0, len(x))
            x[at:at] = root * rnd.randint(2, 7) + root[: rnd.randrange(len(root))]
        shortest, repeats = rnd.choice([(6, 4), (6, 4), (6, 4), (2, 2), (1, 3), (10, 5)])
        assert runs_of(np.array(x, np.int64), shortest, repeats) == brute(x, shortest, repeats)


def test_runs_known():
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert runs_of(numbered([c.encode() for c in fibonacci[-1]])) == []  # no fourth power in a Fibonacci word
    assert runs_of(numbered(b"a a a a a".split())) == []
    assert runs_of(numbered(b"a a a a a a".split())) == [(0, 6, 1)]
    assert runs_of(numbered(b"x a b a b a b a b a y".split())) == [(1, 9, 2)]
    inner = b"a a a a a a b ".split()
    assert runs_of(numbered(inner * 4 + [b"a"])) == [(0, 6, 1), (0, 29, 7), (7, 6, 1), (14, 6, 1), (21, 6, 1)]


@pytest.mark.parametrize("root", [1, 777, 50_000])
def test_long_texts(root):
    x = np.tile(np.arange(root), 200_000 // root)
    assert runs_of(x) == [(0, len(x), root)]


def test_kept_words():
    words = b"x a b a b a b a b a y".split()
    assert kept_words(words, [(1, 9, 2)]) == b"x a b y".split()
    assert kept_words(words, [(1, 9, 2), (0, 4, 1)]) == b"x y".split()  # what any run holds after its first period goes


def expected(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return {
        "doc_id": doc_id, "n_runs": len(runs), "start": best and best[0], "length": best and best[1], "period": best and best[2], "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest(),
    }


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r.asDict() for r in op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    small = [r for r in docs if len(r.text) < 6000]
    assert sum(got[r.doc_id]["n_runs"] > 0 for r in small) > 20
    for r in small:
        assert got[r.doc_id] == expected(r.doc_id, r.text)


def test_rows(spark):
    planted_id = next(i for i in range(10, 100) if zlib.crc32(str(i).encode()) % 10 == 0)
    text = " ".join(map(str, range(400)))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a a a a a a"), (4, "a a a a a a"), (None, "b b\u00a0b b b b b"), (planted_id, text), (5, "w " * 300_000), (6, "é é é É é é é é é é")]
    docs = spark.createDataFrame([(i, t, 7, "old") for i, t in rows], "doc_id long, text string, N_Runs int, other string")
    got = periodic(docs, keep=("doc_id", "N_Runs", "other"), digests=True).select("doc_id", "n_runs", "runs", "collapsed", "length", "other").collect()
    of = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(r.other == "old" for r in got) and [r for r in got if r.doc_id == 4] == [of[4]] * 2
    assert [of[i].n_runs for i in (1, 2, 3)] == [0, 0, 0] and of[1].collapsed == of[3].collapsed == "" and of[1].runs == []
    assert of[4].collapsed == "a" and of[4].length == 6
    assert of[None].n_runs == 0 and of[5].collapsed == "w" and of[5].length == 300_000  # a no-break space joins words
    assert [tuple(x) for x in of[6].runs] == [(4, 6, 1)] and of[6].collapsed == "é é é É é"
    assert of[planted_id].n_runs == 0  # `planted` is the query's, not the operator's
    assert periodic(docs.limit(0)).count() == 0
    assert planted([], planted_id) == [] and planted(b"a b".split(), None) == b"a b".split()
