import hashlib
import tarfile
import zlib
from pathlib import Path

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestor.llm.common import fresh_path
from attestor.llm.media import from_png, op1_media, padded, payloads, png_header, stored, to_png, with_content, with_metadata


@given(st.binary(max_size=700))
def test_round_trip(data):
    media = to_png(padded(data), len(data))
    assert from_png(media) == padded(data)
    assert png_header(media[:53]) == (64, len(padded(data)) // 64, 8, len(data))


def test_damage_is_seen():
    media = bytearray(to_png(padded(b"abc"), 3))
    media[70] ^= 1
    with pytest.raises(ValueError):
        from_png(bytes(media))


ROWS = [(1, None, 5), (2, "", 5), (3, "héllo", 5), (4, "héllo", 5), (5, "x" * 64, 5), (6, "x" * 65, 5), (7, "long " * 300_000, 5), (3, "héllo", 5)]


def test_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, width long")
    folder = fresh_path(spark, "media")
    rows = stored(df, folder, shard_bytes=1000)
    got = with_content(with_metadata(rows)).collect()
    assert len(got) == len(ROWS)
    text = {r[0]: (r[1] or "").encode() for r in ROWS}
    for r in got:
        whole = padded(text[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text[r.doc_id]), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (3, 4)}) == 1
    assert {r.doc_id: (r.width, r.n_bytes) for r in with_metadata(rows).collect()} == {k: (64, len(v)) for k, v in text.items()}
    assert {r.doc_id: bytes(r.payload) for r in payloads(rows).collect()} == text
    names = set()
    for path in Path(folder.removeprefix("file:")).glob("*.tar"):
        with tarfile.open(path) as tar:
            for m in tar:
                media = tar.extractfile(m).read()
                assert from_png(media) == padded(from_png(media))
                names.add(m.name)
    assert names == {f"{r.digest}.png" for r in got}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert with_content(stored(df, fresh_path(spark, "media"))).count() == 0


def test_query_against_plain_code(spark):
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_media(spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        whole = padded(text[r.doc_id])
        media = to_png(whole, len(text[r.doc_id]))
        assert (r.payload_sha256, r.media_bytes, r.media_sha256) == (hashlib.sha256(whole).hexdigest(), len(media), hashlib.sha256(media).hexdigest())


def test_clashing_names(spark):
    df = spark.createDataFrame(ROWS[1:4], "doc_id long, text string, width long").withColumn("digest", F.lit("old")).withColumn("Shard", F.lit("old"))
    got = with_content(with_metadata(stored(df, fresh_path(spark, "media"), keep=("doc_id", "digest", "Shard", "width")))).collect()
    assert len(got) == 3 and all(r.width == 64 and r.digest != "old" and r.shard.endswith(".tar") for r in got)


def test_metadata_reads_headers_only(spark):
    """The metadata is there even where the samples behind the header are damaged."""
    folder = fresh_path(spark, "media")
    rows = stored(spark.createDataFrame(ROWS[2:3], "doc_id long, text string, width long"), folder)
    place = rows.first()
    shard = Path(place.shard.removeprefix("file:"))
    data = bytearray(shard.read_bytes())
    data[place.offset + 70] ^= 1
    shard.write_bytes(bytes(data))
    assert with_metadata(rows).first().n_bytes == 6
    with pytest.raises(Exception, match="damaged"):
        with_content(rows).collect()
