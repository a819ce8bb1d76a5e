import json

import pytest

from pyspark.sql import functions as F

from assayer.sources import files
from assayer.streaming import ingest


def test_csv_lines_images_and_codebook(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,efficency,comments\n1,3,"[\'a\', \'b\']"\n2,,"two\nlines"\n')
    df = files.read_csv(spark, str(tmp_path / "a.csv"), "id int, efficency int, comments string", {"efficency": "efficiency"})
    assert df.columns == ["id", "efficiency", "comments"] and [r.efficiency for r in df.orderBy("id").collect()] == [3, None]
    d = tmp_path / "out"
    d.mkdir()
    for name in ("responses-x-batch_10.jsonl", "responses-x-batch_2.jsonl", "responses-retry-batch_1.jsonl"):
        (d / name).write_text('{"a": 1}\n\n{"a": 2}\n')
    rows = files.read_lines(spark, str(d)).orderBy("is_retry", "batch", "line").collect()
    for none in (tmp_path / "nowhere", tmp_path / "nothing*.jsonl"):
        with pytest.raises(FileNotFoundError):
            files.read_lines(spark, str(none))
    assert [(r.batch, r.line, r.is_retry) for r in rows] == [(2, 1, False), (2, 3, False), (10, 1, False), (10, 3, False), (1, 1, True), (1, 3, True)]
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "77.json").write_text(json.dumps({"activity_name": "pkg/cls"}))
    assert [tuple(r) for r in files.one_field_per_file(spark, str(docs), "activity_name").collect()] == [("77", "pkg/cls")]
    images = tmp_path / "img"
    images.mkdir()
    (images / "1.jpg").write_bytes(b"\x01\x02")
    (images / "1.png").write_bytes(b"\x03")
    assert [tuple(r) for r in files.images_base64(spark, str(images)).collect()] == [("1", "AQI=")]
    expected = spark.createDataFrame([("1.jpg",), ("2.jpg",)], "name string")
    assert [r.name for r in files.missing_files(spark, expected, str(images)).collect()] == ["2.jpg"]
    (tmp_path / "c.yaml").write_text("s:\n  f:\n    yes_: fine\n    1: one\n")
    assert sorted(map(tuple, files.codebook(spark, str(tmp_path / "c.yaml")).collect())) == [("s", "f", "1", "one"), ("s", "f", "yes_", "fine")]


def test_guarded_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.123456), (2, None)], "id int, x double")
    path = str(tmp_path / "t")
    assert files.read_or_empty(spark, path, "id int, x double").count() == 0
    assert files.write_if_changed(df, path) and not files.write_if_changed(df, path)
    again = str(tmp_path / "again")
    assert files.write_if_changed(df, again)
    own = spark.read.parquet(again)
    assert files.write_if_changed(own.unionByName(own), again) and spark.read.parquet(again).count() == 2 * df.count()
    full = spark.range(3).selectExpr("id", "CASE WHEN id = 1 THEN 'x' END AS t")  # a column that may not be null, and nulls
    other = str(tmp_path / "full")
    assert files.write_if_changed(full, f"file://{other}") and not files.write_if_changed(full, f"file://{other}")
    assert files.load_or_make(spark, path, lambda: 1 / 0).count() == 2
    files.write_csv(df, str(tmp_path / "c"), {"x": 2}, ["id"])
    back = files.read_csv(spark, str(tmp_path / "c"), "id int, x double")
    assert [r.x for r in back.orderBy("id").collect()] == [0.12, None]
    files.append_lines(df, str(tmp_path / "j"))
    files.append_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4


def test_stream_keeps_the_latest_and_resumes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write = lambda name, rows: (source / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    write("1.json", [{"id": "a", "ord": 1, "v": "old"}, {"id": "b", "ord": 1, "v": "keep"}])
    args = (spark, str(source), "id string, ord int, v string", str(tmp_path / "t"), str(tmp_path / "cp"), "id", ["ord"])
    assert ingest.ingest(*args).count() == 2
    write("2.json", [{"id": "a", "ord": 2, "v": "new"}, {"id": "b", "ord": 0, "v": "late"}, {"id": "c", "ord": 1, "v": None}])
    assert sorted(map(tuple, ingest.ingest(*args).select("id", "v").collect())) == [("a", "new"), ("b", "keep"), ("c", None)]


def test_windows(spark):
    events = spark.createDataFrame([(1, "x"), (1800, "x"), (3700, "x")], "s int, k string").select(F.timestamp_seconds("s").alias("at"), "k")
    assert sorted(r.n for r in ingest.windowed_counts(events, "at", ["k"], "1 hour", "1 hour").collect()) == [1, 2]


def test_loaders_manifest_and_answers(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "id int, a string").write.parquet(str(tmp_path / "m1"))
    spark.createDataFrame([(2, 5)], "id int, b int").write.parquet(str(tmp_path / "m2"))
    both = files.load_all(spark, str(tmp_path / "{model}"), {"one": "m1", "two": "m2"})
    assert sorted(map(tuple, both.collect())) == [("one", 1, "x", None), ("two", 2, None, 5)]
    path = str(tmp_path / "manifest.json")
    files.upsert_manifest(spark, path, "a", {"n": 1})
    files.upsert_manifest(spark, path, "b", {"n": 2})
    files.upsert_manifest(spark, path, "a", {"n": 3})
    assert json.loads(open(path).read()) == {"a": {"n": 3}, "b": {"n": 2}}
    (tmp_path / "c.json").write_text('[\n{"screen_task_id": "t", "comment_index": 0, "field": "f", "value": null}\n]')
    assert files.read_json(spark, str(tmp_path / "c.json"), "screen_task_id string, comment_index int, field string, value string").first().value is None
    asked = files.ask(spark.createDataFrame([(i, f"p{i}") for i in range(5)], "id int, p string"), "p", lambda texts: [t.upper() for t in texts], size=2)
    assert sorted(map(tuple, asked.collect()))[4] == (4, "p4", "P4")
