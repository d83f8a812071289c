import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from attestor.llm.mixing import targets
from test_near_dedup import brute

SF = "/root/testdata/sf0.01"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    tables = []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        tables.append(docs.collect())
    clean, good, unique, mixed, ids = tables
    has = lambda t: {r.doc_id for r in t}
    # Labels: clean documents stay, most toxic and all poor ones go.
    assert {i for i, r in labels.items() if not r.toxic} <= has(clean)
    assert len([i for i in has(clean) if i in labels and labels[i].toxic]) <= 16
    known = [r.doc_id for r in clean if r.doc_id in labels]
    assert sum((i in has(good)) == (labels[i].quality == 1) for i in known) >= 0.97 * len(known)
    # One of each group by brute force.
    groups = brute([(r.doc_id, r.text) for r in good], 80)
    assert has(unique) == {i for i, (_, c) in groups.items() if i == c} and len(unique) == len(has(unique))
    # The mix meets the targets, to the word, and takes whole texts or their beginnings.
    names = sorted({r.source for r in unique})
    size = {n: sum(words(r.text) for r in unique if r.source == n) for n in names}
    goal = targets([size[n] for n in names], [1 + i % 3 for i in range(len(names))])
    for n, t in zip(names, goal):
        assert abs(sum(words(r.text) for r in mixed if r.source == n) - t) <= 1
    text = {r.doc_id: r for r in unique}
    assert all(text[r.doc_id].text.startswith(r.text) and r.n_chars == (len(r.text) if r.text != text[r.doc_id].text else text[r.doc_id].n_chars) for r in mixed)
    # Encoding.
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, tokenizer.encode(r.text, add_special_tokens=False).ids) for r in mixed)
    assert sorted((r.doc_id, r.ids) for r in ids) == want and all(r.n_tokens == len(r.ids) for r in ids)


def test_odd_tables(spark):
    rows = [(None, "plain words without an id here", None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "a b c d e f g h. The end of it.", "en", "a", 9), (3, "a b c d e f g h. The end of it.", "en", "a", 9), (4, "word " * 30_000, "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ("toxic", "score", "size", "block", "_source", "stats"):
        docs = docs.withColumn(extra, F.lit(extra))
    for table in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, table, SF)
            n = out.count()
            assert k == 4 or out.columns == table.columns
            if k == 2:
                assert n == max(0, table.count() - 1)
            assert all(r[c] == c for r in out.collect() for c in docs.columns[5:]) if k < 4 else True


def test_one_row_of_an_id_stays(spark):
    """Rows of one doc_id with different texts are one group; the same one stays whatever the order of rows."""
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{near} end"), (1, "quite another text without anything in common"), (2, f"{near} END."), (3, "a third text that stands alone here"), (3, "a third text that stands alone here"), (None, "no id at all"), (None, "no id at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    first, again = (sorted(map(str, cp.drop_near_duplicates(spark, docs.repartition(n), SF).collect())) for n in (1, 5))
    kept = cp.drop_near_duplicates(spark, docs, SF).collect()
    assert first == again and sorted(r.doc_id or 0 for r in kept) == [0, 0, 1, 3]
