import json

import pytest

from sealrank import schemas
from sealrank.functions.text import LOAD_LOG_HEADER
from sealrank.sources import readers, writers

HITS = "query_id STRING, rank INT, doc_id STRING, score DOUBLE, backend STRING, sample_size INT"


def test_json_array_and_lines(spark, tmp_path):
    records = [{"doc_id": "1", "content": "é", "embedding": [0.1, 0.2], "embed_time": 0.5}, {"doc_id": "2", "embedding": [1, 2]}]
    (tmp_path / "a.json").write_text(json.dumps(records, ensure_ascii=False, indent=2), encoding="utf-8")
    rows = {r["doc_id"]: r for r in readers.read_doc_embeddings(spark, str(tmp_path / "a.json"), "json_array").collect()}
    assert rows["1"]["content"] == "é" and rows["1"]["embedding"] == [0.1, 0.2] and rows["2"]["content"] is None
    writers.write_embeddings(spark.createDataFrame(list(rows.values()), schemas.DOC_EMBEDDINGS), str(tmp_path / "lines"), fmt="json")
    assert readers.read_doc_embeddings(spark, str(tmp_path / "lines"), "json").count() == 2
    assert "é" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "lines").glob("*.json"))


def test_documents_queries_and_qrels(spark, tmp_path):
    spark.createDataFrame([("1", None, "t")], schemas.DOCUMENTS).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([("q", "t")], schemas.QUERIES).write.option("header", True).csv(str(tmp_path / "q"))
    (tmp_path / "r.txt").write_text("q1 0 d1 1\n\nq1\t0\td2\t0\n")
    assert readers.read_documents(spark, str(tmp_path / "d")).first()["title"] is None
    assert tuple(readers.read_queries(spark, str(tmp_path / "q"), "csv").first()) == ("q", "t")
    assert sorted(map(tuple, readers.read_qrels(spark, str(tmp_path / "r.txt"), "trec").collect())) == [("q1", "d1", 1), ("q1", "d2", 0)]


def test_results_are_kept_apart_by_backend(spark, tmp_path):
    place = str(tmp_path / "results")
    rows = [("q", 2, "b", 0.5, b, 10) for b in ("plain", "sealed")] + [("q", 1, "a", 0.9, b, 10) for b in ("plain", "sealed")]
    hits = spark.createDataFrame(rows, HITS)
    writers.write_results(hits, place)
    back = readers.read_results(spark, place, ", backend STRING, sample_size INT")
    assert back.select(hits.columns).exceptAll(hits).count() == 0 and back.count() == 4
    assert (tmp_path / "results" / "backend=plain" / "sample_size=10").is_dir()
    line = next((tmp_path / "results" / "backend=plain" / "sample_size=10").glob("*.json")).read_text()
    assert [r["doc_id"] for r in json.loads(line)["results"]] == ["a", "b"]


def test_missing_and_empty_results(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_results(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "part.json").write_text("")
    with pytest.raises(ValueError):
        readers.read_results(spark, str(tmp_path / "empty"))


def test_load_log(spark, tmp_path):
    place = str(tmp_path / "log")
    loads = spark.createDataFrame([(10000, 10000, 6.01)], "size INT, count BIGINT, seconds DOUBLE")
    writers.append_load_log(loads, place, start=True)
    writers.append_load_log(loads.selectExpr("size * 5 AS size", "count", "seconds"), place)
    lines = {r[0] for r in spark.read.text(place).collect()}
    assert lines == {LOAD_LOG_HEADER, "[10000] count=10000, time=6.01s", "[50000] count=10000, time=6.01s"}
    assert sorted(map(tuple, readers.read_load_log(spark, place).collect())) == [(10000, 10000, 6.01), (50000, 10000, 6.01)]


def test_metrics_merge(spark, tmp_path):
    place = str(tmp_path / "metrics")
    assert writers.latest_metrics(spark, place).count() == 0
    writers.append_metrics(spark, place, "sealed", 10, {"total_time": 1.0, "wall_clock_time": 2.0})
    writers.append_metrics(spark, place, "sealed", 10, {"eval_time_sec": 0.5, "total_time": 3.0})
    rows = {r["metric"]: r for r in writers.latest_metrics(spark, place).collect()}
    assert {m: r["value"] for m, r in rows.items()} == {"total_time": 3.0, "wall_clock_time": 2.0, "eval_time_sec": 0.5}
    assert len(rows["total_time"]["last_run_at"]) == len("2026-01-01T00:00:00")


def test_paths():
    assert writers.sized_path("doc_embeddings_{size}.json", 10) == "doc_embeddings_10.json"
    assert writers.query_path("doc_embeddings_10.json") == "query_embeddings_10.json"
