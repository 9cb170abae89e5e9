from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.sources import readers, writers
from lodeworks.streaming.reingest import reingest


def test_stage(spark, tmp_path):
    shop = tmp_path / "shop"
    shop.mkdir()
    (shop / "kettles.csv").write_text('id,name,made\n1," Tin ",2001-02-03\n2,,\n')
    (tmp_path / "orders.json").write_text(json.dumps({"count": 2, "results": [{"order": 1, "part": {"id": "p", "tags": ["a"]}}, {"order": 2, "part": {"id": "q", "tags": []}}]}))
    (tmp_path / "notes.ndjson").write_text('{"part": "p", "ok": true}\n{"part": "q", "ok": false}\n')
    (tmp_path / "two.json").write_text(json.dumps({"a": [{"x": 1}], "b": [{"x": 1}]}))
    (tmp_path / "read.md").write_text("# Read")
    staged = readers.stage(spark, str(tmp_path))
    assert sorted(staged.tables) == ["notes", "orders", "shop/kettles"]
    assert sorted(p.rpartition("/")[2] for p in staged.skipped) == ["read.md", "two.json"]
    assert staged.tables["orders"].columns == ["order", "part.id", "part.tags"]
    assert [r["part.tags"] for r in staged.tables["orders"].orderBy("order").collect()] == ['["a"]', "[]"]
    text = readers.csv_text(spark, f"{shop}/kettles.csv").orderBy("id").collect()
    assert [(r["name"], r["made"]) for r in text] == [("Tin", "2001-02-03"), (None, None)]
    assert dict(readers.csv(spark, f"{shop}/kettles.csv").dtypes)["made"] == "date"
    assert readers.views(staged.tables) == ["notes", "orders", "shop_kettles"]


def test_documents(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# A\n\nbad \xff byte")
    (tmp_path / "b.txt").write_text("  ")
    rows = readers.documents(spark, str(tmp_path)).collect()
    assert [(r["doc_id"], r["title"]) for r in rows] == [("a.md", "a")] and "�" in rows[0]["text"]
    (tmp_path / "none").mkdir()
    assert readers.documents(spark, f"{tmp_path}/none").count() == 0


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\nnot json\n{"id": 2}\n')
    rows, errors = readers.json_lines(spark, f"{tmp_path}/a.jsonl", T.StructType([T.StructField("id", T.LongType())]))
    assert sorted(r["id"] for r in rows.collect()) == [1, 2] and [r["line"] for r in errors.collect()] == ["not json"]
    writers.json_lines(rows, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2


def test_writers(spark, tmp_path):
    stored = spark.createDataFrame([("d1", 0, "old"), ("d1", 1, "old"), ("d2", 0, "keep")], "doc_id string, idx int, text string")
    fresh = spark.createDataFrame([("d1", 0, "new")], stored.schema)
    assert {tuple(r) for r in writers.replace_documents(stored, fresh).collect()} == {("d1", 0, "new"), ("d2", 0, "keep")}
    writers.replace(stored, f"{tmp_path}/t", "doc_id")
    writers.replace(fresh, f"{tmp_path}/t", "doc_id")
    assert {r["text"] for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {"new", "keep"}
    assert writers.upsert(None, stored, ["doc_id"]).count() == 2


def test_reingest_is_idempotent(spark, tmp_path):
    schema = "id long, at long, v string"
    source = f"{tmp_path}/in"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = reingest(spark.readStream.schema(schema).parquet(source), f"{tmp_path}/out", "id", "at", f"{tmp_path}/cp", buckets=4)
        q.awaitTermination(120)
        assert q.exception() is None

    feed([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")])
    feed([(2, 2, "d"), (1, 1, "late"), (3, 1, "e")])
    feed([(2, 2, "d")])
    assert {(r["id"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, "c"), (2, "d"), (3, "e")}


@pytest.mark.parametrize("cells", [[("a", None)], []])
def test_flatten(spark, cells):
    df = spark.createDataFrame(cells, "k string, n struct<x:int,y:array<int>>")
    assert readers.flatten(df).columns == ["k", "n.x", "n.y"] and readers.flatten(df).where(F.col("`n.x`").isNotNull()).count() == 0
