import hashlib
import json

import pytest
from pyspark.sql import functions as F

from attestor.sources import files, search


def test_recorded_search(spark, tmp_path):
    (tmp_path / "Q1.json").write_text(json.dumps({"results": [{"url": "https://a.org", "title": " ", "content": "c", "score": "0.5"}, "odd", {"url": "ftp://b"}, {"url": "http://c.org", "title": "C", "score": None, "published_date": "2024"}]}))
    (tmp_path / "Q2.json").write_text(json.dumps({"status": 429}))
    (tmp_path / "Q3.json").write_text("{no json")
    (tmp_path / "notes.txt").write_text("x")
    search.register(spark)
    got = {(r.query_id, r.pos): r for r in spark.read.format("recorded_search").option("path", f"file://{tmp_path}").load().collect()}
    assert set(got) == {("Q1", 0), ("Q1", 1), ("Q2", None), ("Q3", None)}
    assert (got["Q1", 0].title, got["Q1", 0].score, got["Q1", 1].title, got["Q1", 1].score, got["Q1", 1].published) == ("https://a.org", 0.5, "C", None, "2024")
    assert got["Q2", None].error == "status 429" and got["Q3", None].error and got["Q1", 0].error is None
    (tmp_path / "brave").mkdir()
    (tmp_path / "brave" / "Q9.json").write_text(json.dumps({"web": {"results": [{"url": "x"}, {"url": "https://a.org", "title": "A", "description": "d"}, {"url": "https://b.org"}, {"url": "https://c.org"}]}}))
    rows = spark.read.format("recorded_search").option("path", f"file://{tmp_path}/brave").option("provider", "brave").load().orderBy("pos").collect()
    assert [(r.title, r.content, r.score) for r in rows] == [("A", "d", 1.0), ("https://b.org", "", 0.75), ("https://c.org", "", 0.5)]
    (tmp_path / "none").mkdir()
    assert spark.read.format("recorded_search").option("path", f"file://{tmp_path}/none").load().count() == 0
    with pytest.raises(Exception, match="unknown provider"):
        spark.read.format("recorded_search").option("path", "x").option("provider", "y").load().count()


def test_files(spark, tmp_path):
    sources = spark.createDataFrame([("S1", "secret text", "a.org", 3)], "source_id string, text string, domain string, word_count int")
    files.save_snapshot({"sources": sources}, f"{tmp_path}/snap")
    assert files.load_snapshot(spark, f"{tmp_path}/snap", ("sources",))["sources"].collect() == sources.collect()
    with pytest.raises(Exception, match="(?i)exists"):
        files.save_snapshot({"sources": sources}, f"{tmp_path}/snap")
    files.write_artifacts({"sources": sources}, f"{tmp_path}/out", "r1")
    back = spark.read.json(f"{tmp_path}/out/sources")
    assert set(back.columns) == {"source_id", "domain", "word_count", "run_id"} and back.first().run_id == "r1"
    (tmp_path / "sheet.csv").write_text('id,score,note\na,3,"two\nlines"\nb,4,x\na,5,"say ""no"""\n')
    rows, twice = files.review_sheet(spark, f"{tmp_path}/sheet.csv", "id")
    assert rows.count() == 3 and [(r.id, r.times) for r in twice.collect()] == [("a", 2)] and rows.where("score = 5").first().note == 'say "no"'
    (tmp_path / "sums").mkdir()
    for n in ("b.txt", "a.txt"):
        (tmp_path / "sums" / n).write_text(n)
    sums = files.checksums(spark, f"{tmp_path}/sums")
    assert {r.name: (r.bytes, r.sha256) for r in sums.collect()} == {n: (5, hashlib.sha256(n.encode()).hexdigest()) for n in ("a.txt", "b.txt")}
    assert [r.line.split()[1] for r in files.checksum_lines(sums).collect()] == ["a.txt", "b.txt"]
    assert files.public_columns(sources.withColumn("x", F.lit(1)), "sources").columns == ["source_id", "domain", "word_count"]
