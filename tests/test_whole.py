"""Queries over whole tables and texts, against plain code."""

import difflib
import html
import random
import re
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from attestor.functions import lexicon as lx
from attestor.functions import matching, urls
from attestor.operators import ordered, quotes
from attestor.sources import store


def terms(text):
    tokens = re.findall("[a-z][a-z0-9-]{2,}", (text or "").lower())
    parts = [p for t in tokens if "-" in t for p in t.split("-") if len(p) >= 3]
    return {*tokens, *parts} - set(lx.TOPIC_STOPWORDS)


def test_topical_overlap_meets_every_item_that_shares_a_term(spark, tmp_path):
    docs = [(1, "Quantum-resistant signatures and lattice ciphers"), (42, "lattice red"), (83, None), (7, "the of and")]
    items = [(0, "signatures of lattice"), (1, "red blue"), (2, "of the"), (45, "ciphers"), (46, "green")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {}
    for d, e in docs:
        for i, q in items:
            s = terms(q) & terms(e)
            if s:
                want[d, i] = (len(s), any(len(t) >= 8 for t in s) or len(s) >= min(2, len(terms(q))))
    got = entry.queries()["topical_overlap"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) > 3 and {(r.doc_id, r.item_id): (r.shared, r.plausible) for r in got} == want


def test_citation_markers_reads_whole_texts(spark, tmp_path):
    long = "word " * 30
    rows = [(1, 0, f"{long}[S7, S8] tail [S1]"), (2, 3, "short"), (4, 4, long), (5, 1, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.ids, r.plain) for r in entry.queries()["citation_markers"](spark, str(tmp_path)).collect()}
    assert got == {1: (["S7", "S8", "S1", "S0"], f"{long.strip()} tail and end"), 2: (["S2", "S3"], "short and end"), 4: (["S4"], f"{long} and end"), 5: (None, None)}


def test_exact_quotes_of_any_length(spark, tmp_path):
    """Word for word, inside words too; quotes of fewer than twelve characters prove nothing."""
    docs = [(1, "Alpha  beta gamma delta epsilon zeta eta"), (2, "xalpha beta gammax"), (3, "word " * 30_000 + "one two three four five six"), (4, None), (5, "")]
    items = [(0, "alpha beta g"), (1, "beta gamma delta"), (2, "one two three four five six"), (3, "alph"), (4, "beta gamma delta epsilon"), (5, "lpha beta gamma delta epsilon zet"), (6, "beta"), (7, "nowhere to be found at all here"), (8, "lpha  beta gamma"), (9, "word word word")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = lambda t: " ".join(t.lower().split())
    want = {(f"S{d}", i) for d, t in docs if t is not None for i, q in items if len(plain(q)) >= 12 and plain(q) in plain(t)}
    got = entry.queries()["exact_quotes"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) > 8 and {(r.source_id, r.item_id) for r in got} == want


def classified(quote, text):
    """Class and place in the matching form of one quote in one text, window by window."""
    form = lambda t: re.sub(r"\s+", " ", (t or "").translate(str.maketrans("‘’“”–—\u00a0", "''\"\"-- ")).lower()).strip()
    q, t = form(quote), form(text)
    if len(q) < 12 or not t:
        return None
    if q in t:
        return "exact", t.find(q)
    if len(q) > len(t):
        return ("fuzzy", None) if difflib.SequenceMatcher(None, q, t).ratio() >= 0.88 else None
    return next((("fuzzy", s) for s in range(0, len(t) - len(q) + 1, max(1, len(q) // 4)) if difflib.SequenceMatcher(None, t[s : s + len(q)], q).ratio() >= 0.88), None)


def edited(rnd, s, n):
    out = list(s)
    for _ in range(n):
        i = rnd.randrange(len(out) + 1)
        out[i : i + rnd.choice([0, 1, 1])] = rnd.choice(["", "z", " ", "e"])
    return "".join(out)


def test_quotes_equal_brute_force(spark, monkeypatch):
    """Exact, close and other quotes of all lengths against all texts; the slices of texts and places are cut small for a third of the rounds."""
    rnd, seen = random.Random(8), Counter()
    syllables = "ba be di lo ka mu nu re si ta en er in on the and of".split()
    for turn in range(9):
        if turn % 3 == 0:
            monkeypatch.setattr(quotes, "PIECE", 50)
            monkeypatch.setattr(quotes, "PAIRS", 10)
        else:
            monkeypatch.undo()
        texts = [" ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(0, 110))) for _ in range(8)] + ["a" * 50 + "b" + "a" * 28, "short text of its own"]
        asked = ["a" * 30, "short text of its ovn!"]
        for _ in range(20):
            t, n = rnd.choice(texts), rnd.choice([11, 12, 13, 17, 20, 30, 60, 120, 200, 260])
            start = rnd.randrange(len(t) + 1)
            asked.append(edited(rnd, t[start : start + n], rnd.choice([0, 1, 2, n * 6 // 100, n * 10 // 100, n * 13 // 100])))
        own = [i for i, q in enumerate(asked) if len(quotes.matching_form(q)) >= 12]
        block = quotes.Quotes(own, [quotes.matching_form(asked[i]) for i in own])
        for t in texts:
            found = block.found(quotes.matching_form(t)) if t.strip() else {}
            got = {block.ids[k]: (kind, at if at >= 0 else None) for k, (kind, at) in found.items()}
            for i, q in enumerate(asked):
                want = classified(q, t)
                assert got.get(i) == want, (q, t)
                seen[want and want[0]] += 1
    assert seen["exact"] > 40 and seen["fuzzy"] > 40


def test_long_quotes_are_found_by_long_runs():
    """From 200 characters on what matches falls into few stretches, so close windows share runs of eight characters, which other texts seldom hold."""
    rnd = random.Random(12)
    words = ["".join(rnd.choice("etaonihrsdlu" * 4 + "pqvxzkjéñ") for _ in range(rnd.randrange(2, 9))) for _ in range(80)]
    seen = Counter()
    for _ in range(120):
        text = " ".join(rnd.choice(words) for _ in range(160))
        n, start = rnd.choice([150, 199, 200, 230, 299, 300, 390]), rnd.randrange(300)
        needle = quotes.matching_form(edited(rnd, text[start : start + n], rnd.choice([0, 1, n * 4 // 100, n * 8 // 100, n * 12 // 100])))
        block = quotes.Quotes([0], [needle])
        for s in range(0, len(text) - len(needle) + 1, 7):
            m = difflib.SequenceMatcher(None, text[s : s + len(needle)], needle)
            if m.ratio() >= 0.88:
                assert len(m.get_matching_blocks()) - 1 <= quotes.stretches(needle)
        found = block.found(quotes.matching_form(text))
        want = classified(needle, text)
        assert {k: (kind, at) for k, (kind, at) in found.items()} == ({0: want} if want else {})
        seen[want and want[0], len(needle) >= 200] += 1
        assert len(needle) < 200 or quotes.run_length(needle) == 8
    assert seen["fuzzy", True] > 5 and seen["exact", True] > 2


def test_quotes_typographic_short_and_odd(spark):
    docs = [(1, "He  said “don’t panic” and\n left"), (2, "under extraordinary\u00a0circumstances only"), (3, "The alphabetical beta versions gammarays deltawings epsilonics came"), (4, None), (5, ""), (6, "  \n Leading space, then said \"don't panic\" and left"), (6, "twice: said 'x'")]
    items = [(0, "said \"don't panic\" and left"), (1, "extraordinary circumstances"), (2, "alphabetical betaversions gammarayss deltawings epsilonics"), (3, "don't panic"), (4, None), (5, ""), (0, "under extraordinary")]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, Offset string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.quote_match, r.offset) for r in quotes.located(d, b).collect()}
    assert got == {(1, 0, "exact", 4), (6, 0, "exact", docs[5][1].index("said")), (2, 1, "exact", 6), (2, 0, "exact", 0), (3, 2, "fuzzy", 0)}
    assert classified(items[2][1], docs[2][1]) == ("fuzzy", 0)
    assert quotes.located(d.limit(0), b).count() == 0 and quotes.located(d, b.limit(0)).count() == 0


def test_quote_classes(spark):
    """Every pair of a document and an item that matches is evidence, with its class and the place in the document as it is."""
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    quote = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    rows = {(r.doc_id, r.item_id): r for r in entry.queries()["quote_classes"](spark, sf).collect()}
    for i, q in quote.items():
        for d, t in text.items():
            near = 2 * sum((Counter(quotes.matching_form(q)) & Counter(quotes.matching_form(t))).values()) >= 0.8 * len(q)
            want = classified(q, t) if q[:60].lower() in t.lower() or near and len(t) < 3 * len(q) else None
            if want:
                assert rows[d, i].quote_match == want[0]
    held = [r for r in rows.values() if r.quote_match == "exact"]
    assert held and all(" ".join(text[r.doc_id][r.offset :].lower().split()).startswith(" ".join(quote[r.item_id].lower().split())) for r in held)
    assert all((r.offset is None) == (r.quote_match == "none") for r in rows.values())


def test_as_of_and_running_sums(spark):
    rnd = random.Random(2)
    starts = [(rnd.choice([0, 0, 0, 1, 2]), rnd.randrange(1000), i) for i in range(300)]
    points = [(rnd.choice([0, 0, 0, 1, 2, 3]), rnd.choice([None, rnd.randrange(-5, 1005)]), i) for i in range(400)]
    p, s = spark.createDataFrame(points, "g int, at int, id int"), spark.createDataFrame(starts, "g int, start int, page int")
    for cuts in (1, 7, 64):
        got = {r.id: r.page for r in ordered.as_of(p, s, ["g"], "at", "start", ["page"], cuts).collect()}
        assert got == {i: max(((x, n) for h, x, n in starts if h == g and at is not None and x <= at), default=(0, None))[1] for g, at, i in points}
        sums = {r.id: r.total for r in ordered.running_sums(p.where("at is not null"), ["g"], "at", ["id"], {"total": F.col("id")}, cuts).collect()}
        assert sums == {i: sum(j for h, x, j in points if h == g and x is not None and (x, j) <= (at, i)) for g, at, i in points if at is not None}
    assert ordered.as_of(p, s.limit(0), ["g"], "at", "start", ["page"]).where("page is not null").count() == 0


def test_page_texts(spark):
    """Every page's body is planted in its article, between navigation, an advertisement and a footer: how many come out to the word."""
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    exact, held, lost = 0, 0, 0
    for r in entry.queries()["page_texts"](spark, sf).collect():
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", pages[r.page_id], re.DOTALL)[1]
        want = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        got = r.text.split()
        exact += got == want
        held += sum((Counter(got) & Counter(want)).values())
        lost += len(got) + len(want)
    print("pages to the word", exact, "of", len(pages), "F1", 2 * held / lost)
    assert exact >= 0.95 * len(pages) and 2 * held / lost > 0.98


def plain_run(blocks):
    """The run with the greatest sum, by all runs."""
    gain = [-w if aside else w - 2 * k - 0.5 for _, w, k, _, aside in blocks]
    best, found = 0.0, (0, 0)
    for i in range(len(blocks)):
        for j in range(i + 1, len(blocks) + 1):
            total = sum(gain[i:j]) - sum(15.0 for k in range(i + 1, j) if blocks[k][3] != blocks[k - 1][3])
            if total > best + 1e-9:
                best, found = total, (i, j)
    return best, found


def test_densest_run():
    rnd = random.Random(6)
    for _ in range(400):
        blocks = [("x", rnd.randint(1, 30), rnd.choice([0, 0, 1, 9]), rnd.randint(0, 2), rnd.random() < 0.2) for _ in range(rnd.randint(0, 12))]
        first, past = matching.densest_run(blocks)
        best, _ = plain_run(blocks)
        assert abs(plain_run(blocks[first:past])[0] - best) < 1e-9 and plain_run(blocks[first:past])[1] in ((0, past - first), (0, 0))


def test_main_text_of_odd_pages(spark):
    cases = [
        (None, ""), ("", ""), ("<p>unclosed <b>bold<p>two", "unclosed bold\ntwo"), ("just text", "just text"), ("<nav><p>one two three</nav><p>body text here", "body text here"), ("<ul><li><a>menu one</a><li><a>menu two</a></ul>", ""),
        ("<div>a short line</div><div>" + "word " * 30 + "</div></div></p><footer>" + "foot " * 40, ("word " * 30).strip()), ("<title>T</title><script>var x = '<p>';</script><p>seen</p>", "seen"), ("<article>" + "<p>w</p>" * 5000 + "</article>", "\n".join(["w"] * 5000)),
        ("<section><h2>One</h2><p>" + "a " * 40 + "</p></section><section><h2>Two</h2><p>" + "b " * 40 + "</p></section>", "One\n" + "a " * 39 + "a\nTwo\n" + "b " * 39 + "b"),
    ]
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h string").select("i", matching.main_text("h").alias("t")).collect()
    assert {r.i: r.t for r in rows} == {i: t for i, (_, t) in enumerate(cases)}


def test_absent_entities(spark, tmp_path):
    docs = [(1, "Kafka Streams and more"), (2, "xred blueish words"), (3, None), (4, "")]
    items = [(0, "Kafka streams are"), (1, "red blue"), (2, "nowhere found"), (3, "single"), (4, None), (5, "kafka Streams"), (6, "streams and")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.item_id for r in entry.queries()["absent_entities"](spark, str(tmp_path)).collect()} == {2, 3, 4}


def test_unsafe_addresses(spark):
    cases = [("http://a.org/", None), ("http://a.org:81/", "port"), ("file:///x", "scheme"), ("http://u@localhost/", "local host"), ("http://[::1]:8080/", "blocked address"), ("http://[::ffff:192.168.1.1]/", "blocked address"), ("http://[fe80::1%25eth0]/", "blocked address"),
             ("http://[2606:4700::1111]/", None), ("http://[nonsense]/", "blocked address"), ("http://172.31.0.1/", "private address"), ("http://172.32.0.1/", None), ("http://198.18.0.1/", "private address"), (None, "scheme"), ("http:///x", "no host")]
    rows = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(cases)], "i int, u string").orderBy("i")
    assert [r.w for r in rows.select(urls.unsafe_reason(F.col("u")).alias("w")).collect()] == [w for _, w in cases]


def test_cited_pages_cuts_only_documents_that_are_cited(spark, tmp_path, monkeypatch):
    """Places before, at and after line ends, also behind signs beyond the first plane; lines of documents are never written as rows."""
    quote = "alpha beta gamma delta"
    docs = [(0, f"\n\n{quote}\nend"), (1, f"one\ntwo \U0001f600 {quote}\n\n"), (2, "alpha\n beta\ngamma delta"), (3, "line\n" * 5_000), (4, None), (5, f"late\n{quote}")]
    turns = [(0, 1, "assistant", "said"), (9, 3, "assistant", None), (4, 0, "user", "asked")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, quote)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows, write = [], store.written

    def counted(df, name):
        out = write(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(store, "written", counted)
    got = {(r.claim_id, r.source_id, r.page) for r in entry.queries()["cited_pages"](spark, str(tmp_path)).collect()}
    assert got == {(c, s, p) for c in (1, 903) for s, p in (("S0", 3), ("S1", 2), ("S2", 1))}
    assert max(rows) < 20
