"""JSON arrays in byte ranges of any size against the json module."""

import json
import random

import pytest

from sealrank.sources import json_arrays, readers, writers

SCHEMA = "doc_id string, content string, embedding array<double>"
SETTINGS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")


@pytest.fixture
def ranges_of(spark):
    """Lets a file be cut into ranges of so many bytes."""
    before = [spark.conf.get(name, None) for name in SETTINGS]

    def cut(size: int) -> None:
        for name, value in zip(SETTINGS, (size, 1, 1)):
            spark.conf.set(name, str(value))

    yield cut
    for name, value in zip(SETTINGS, before):
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def odd_records(n):
    random.seed(n)
    texts = ["plain", 'brace } in, {"text": 1}', 'quote \\" } { "x"', "é漢 {}{}{", "\\", "}", "{", '"', "line\nbreak }\t{"]
    for i in range(n):
        record = {"doc_id": str(i), "content": random.choice(texts) * random.randint(0, 8), "embedding": [i / 7] * random.randint(0, 9)}
        if i % 3 == 0:
            record["meta"] = {"a": {"b": [{"c": "}"}, {}]}, "{": "}"}
        yield record


def fields(records):
    return sorted((r["doc_id"], r.get("content"), tuple(r.get("embedding") or ())) for r in records)


def read(spark, path):
    return fields(r.asDict() for r in json_arrays.read_json_arrays(spark, str(path), SCHEMA).collect())


@pytest.mark.parametrize("indent, size", [(None, 10_000_000), (None, 4_000), (None, 450), (2, 2_000), (2, 333)])
def test_ranges_of_any_size_give_every_object_once(spark, tmp_path, ranges_of, indent, size):
    records = list(odd_records(120))
    path = tmp_path / "a.json"
    path.write_text(json.dumps(records, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    ranges_of(size)
    assert read(spark, path) == fields(records)
    n_ranges = json_arrays.fragments(spark, str(path)).select("start").distinct().count()
    assert n_ranges <= -(-path.stat().st_size // size)
    assert size > 9_000_000 or n_ranges > 1


def test_an_object_over_many_ranges(spark, tmp_path, ranges_of):
    records = [{"doc_id": "1"}, {"doc_id": "2", "content": "} {" * 500, "embedding": [0.5]}, {"doc_id": "3"}]
    (tmp_path / "a.json").write_text(json.dumps(records))
    ranges_of(100)
    assert read(spark, tmp_path / "a.json") == fields(records)


def test_several_files_other_elements_and_lines(spark, tmp_path, ranges_of):
    records = list(odd_records(30))
    (tmp_path / "a.json").write_text('["}, {", 1, null, "\\"}{", ' + json.dumps(records[:10])[1:-1] + ', "tail }"]')
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, records[10:20])) + "\n")
    (tmp_path / "c.json").write_text(json.dumps(records[20:25]) + "\n" + json.dumps(records[25:], indent=1))
    (tmp_path / "d.json").write_text("[]")
    (tmp_path / "e.json").write_text("")
    for size in (10_000_000, 300):
        ranges_of(size)
        assert read(spark, tmp_path) == fields(records)


def test_no_object(spark, tmp_path):
    (tmp_path / "a.json").write_text("[ ]\n")
    assert read(spark, tmp_path) == []


def test_values_are_those_of_json_lines(spark, tmp_path, ranges_of):
    """Wrong types and truncated objects give what the reader of lines gives."""
    lines = ['{"doc_id": 5, "embedding": "x"}', '{"content": true}', '{"doc_id": "a", "embedding": [1, 2.5, null]}', "{}"]
    (tmp_path / "lines.json").write_text("\n".join(lines))
    (tmp_path / "array.json").write_text("[" + ",\n".join(lines) + "]")
    one = readers.read_table(spark, str(tmp_path / "lines.json"), SCHEMA, "json").collect()
    ranges_of(40)
    two = readers.read_table(spark, str(tmp_path / "array.json"), SCHEMA, "json_array").collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_only_the_named_columns_are_parsed(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(list(odd_records(9))))
    rows = json_arrays.read_json_arrays(spark, str(tmp_path / "a.json"), SCHEMA).select("doc_id")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "StructField(doc_id" in plan and "StructField(embedding" not in plan


def test_written_arrays_come_back(spark, tmp_path):
    records = list(odd_records(50))
    lines = spark.createDataFrame([(json.dumps(r),) for r in records], "value string").repartition(4)
    writers.write_json_arrays(lines, str(tmp_path / "out"))
    assert read(spark, tmp_path / "out") == fields(records)
    for part in (tmp_path / "out").glob("*.txt"):
        assert isinstance(json.loads(part.read_text(encoding="utf-8")), list)
