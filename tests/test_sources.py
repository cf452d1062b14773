"""Recorded searches and stage folders, on files written here."""

import hashlib
import pathlib

import pytest

from labelwright.sources import readers, search_results

RESPONSES = [
    '{"query": "E330", "answer": null, "results": [{"title": "a", "url": "https://food.example.org/1", "content": "x", "published_date": "Mon, 01 Jan 2024 10:00:00 GMT", "score": 0.5}, {"url": "http://example.org.evil.net/2", "published_date": "soon"}]}',
    '{"query": "E955", "results": []}',
    '{"query": "E951"}',
]


def test_recorded_searches(spark, tmp_path):
    (tmp_path / "one.json").write_text("\n".join(RESPONSES))
    found = search_results.recorded(spark, f"file://{tmp_path}")
    rows = sorted((r.query, r.place, r.title, r.content, str(r.published), r.published_raw, r.score) for r in found.collect())
    assert rows == [("E330", 0, "a", "x", "2024-01-01", "Mon, 01 Jan 2024 10:00:00 GMT", 0.5), ("E330", 1, "", "", "None", "soon", None)]
    asked = spark.createDataFrame([("E330",), ("E330",), ("E999",)], "query string")
    assert search_results.search(found, asked).count() == 2
    assert [r.title for r in search_results.search(found, asked, ["EXAMPLE.org"]).collect()] == ["a"]
    assert search_results.search(found, asked, days=3, as_of="2024-01-04").count() == 1
    assert search_results.search(found, asked, days=2, as_of="2024-01-04").count() == 0
    assert search_results.recorded(spark, f"file://{tmp_path}/none").count() == 0


def test_an_answer_of_the_provider_stops_the_read(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"query": "E330", "answer": "It is safe.", "results": [{"url": "https://a.org"}]}')
    with pytest.raises(Exception, match="answer of the provider"):
        search_results.recorded(spark, f"file://{tmp_path}").collect()


def hashes(folder):
    return {p.relative_to(folder).as_posix(): hashlib.sha256(p.read_bytes()).hexdigest() for p in pathlib.Path(folder).rglob("part-*")}


def test_a_stage_written_again_leaves_the_others_byte_for_byte(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(20)], "k int, v string")
    for stage in ("extract", "resolve", "verdict"):
        readers.write_stage(rows, f"file://{tmp_path}/out", stage)
    before = hashes(tmp_path / "out")
    readers.write_stage(rows.where("k < 3"), f"file://{tmp_path}/out", "resolve")
    after = hashes(tmp_path / "out")
    assert {f: h for f, h in before.items() if "resolve" not in f} == {f: h for f, h in after.items() if "resolve" not in f}
    counts = {r.stage: r["count"] for r in spark.read.parquet(f"file://{tmp_path}/out").groupBy("stage").count().collect()}
    assert counts == {"extract": 20, "resolve": 3, "verdict": 20}
