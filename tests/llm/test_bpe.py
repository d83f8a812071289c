import hashlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attestor.llm.bpe import BytePairCoder, decoded, encoded, op2_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
OURS, THEIRS = BytePairCoder(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdeinorst 'é\n\t1.<|>", max_size=80), st.lists(st.sampled_from(["<|endoftext|>", " the", "ing", "'ll", "　", "\x1c", "\x85", "  ", "123", "ünd", "!!", "aaaa", "====", "日本"]), max_size=30).map("".join)))
def test_same_ids_and_text_as_the_library(text):
    ids = OURS.encode(text)
    theirs = THEIRS.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == theirs
    assert OURS.decode(ids) == THEIRS.decode(theirs, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000 + "c", "-" * 5_000, "Donaudampfschiff" * 800, "x" * 3 + "​" * 4_000])
def test_long_pieces(text):
    assert OURS.encode(text).tolist() == THEIRS.encode(text, add_special_tokens=False).ids


def test_tables(spark):
    rows = [(1, None, 9), (2, "", 8), (3, "The end<|endoftext|> of it", 7), (3, "The end<|endoftext|> of it", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    out = {r.doc_id: r for r in encoded(df, PATH, digests=True).collect()}
    ids = THEIRS.encode(rows[2][1], add_special_tokens=False).ids
    assert out[3].ids == ids and out[3].n_tokens == len(ids) and out[1].n_tokens == out[2].n_tokens == 0
    assert out[3].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert out[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    back = decoded(encoded(df, PATH), PATH).collect()
    assert sorted(r.text for r in back) == sorted([r[1] or "" for r in rows])
    assert encoded(df.limit(0), PATH).count() == 0


def test_bad_ids():
    with pytest.raises(IndexError):
        OURS.decode(np.array([-1]))


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op2_bpe(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = THEIRS.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_names_in_other_cases(spark):
    """Columns named like the new ones, in any case of letters, are replaced, and what is left can be used."""
    docs = spark.createDataFrame([(1, "some text", 5, "x"), (2, None, 5, "x")], "doc_id long, text string, N_tokens int, IDS_sha256 string")
    out = encoded(docs, PATH, keep=("doc_id", "N_tokens", "IDS_sha256"), digests=True)
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id: r.n_tokens for r in out.select("doc_id", "n_tokens").collect()} == {1: 2, 2: 0}
    back = decoded(out.withColumnRenamed("doc_id", "Text"), PATH, keep=("Text",))
    assert [r.text for r in back.select("text").where("text <> ''").collect()] == ["some text"]


def test_workers_keep_no_tables(spark):
    """After its task a worker holds the coder, but none of the pieces and pairs that it met."""
    df = spark.createDataFrame([(i, f"some words of text {i} unbelievably") for i in range(200)], "doc_id long, text string").repartition(4)
    assert encoded(df, PATH).count() == 200

    def held(batches):
        from attestor.llm import bpe

        for _ in batches:
            yield pd.DataFrame({"n": [sum(len(c.pieces) + len(c.fits) for c in bpe._coders.values())]})

    encoded(df, PATH).write.format("noop").mode("overwrite").save()
    assert {r.n for r in spark.range(8).repartition(4).mapInPandas(held, "n long").collect()} == {0}


def test_pairs_by_their_boundary_are_those_of_merging():
    """Whether two tokens stand apart is read off the merges that meet at their boundary; merging their bytes is the definition."""
    made = sorted({i for _, i in OURS.merges.values()} | set(OURS.single))
    met = OURS.encode("the unbelievable Donaudampfschifffahrt aaaaaaaa ====== l'été où naïve 12345 " * 3).tolist()
    pairs = [(a, b) for a in {*met, *made[:60]} for b in {*met, *made[-40:]}] + [(a, a) for a in made[::7]] + list(zip(made[::11], made[5::11], strict=False))
    assert OURS.ordered
    for a, b in pairs:
        assert OURS.stand_apart(a, b) == (OURS.merged(OURS.bytes_of[a] + OURS.bytes_of[b]) == [a, b]), (a, b)


def test_frequent_pieces_outlive_a_full_table(monkeypatch):
    """A piece that comes again and again is encoded once, however many others fill the table."""
    from attestor.llm import bpe

    monkeypatch.setattr(bpe, "KEPT_PIECES", 8)
    c, encoded_pieces = BytePairCoder(PATH), []
    c.pieces.encode = lambda piece: encoded_pieces.append(piece) or c.encode_piece(piece)
    for i in range(40):
        assert c.encode(f" often new{chr(97 + i % 26)}{chr(97 + i // 26)}q").tolist() == THEIRS.encode(f" often new{chr(97 + i % 26)}{chr(97 + i // 26)}q", add_special_tokens=False).ids
    assert encoded_pieces.count(" often") == 1 and len(encoded_pieces) == 41
    assert len(c.pieces) <= 8 and len(c.pieces.older) <= 8
