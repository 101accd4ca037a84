"""Reading and writing files."""

import pytest
from pyspark.sql import functions as F

from tracelake.sources import files


def test_json_lines(spark, tmp_path):
    (tmp_path / "stage_1").mkdir()
    path = tmp_path / "stage_1" / "epoch_2.jsonl"
    path.write_text('{"a": 1}\n\n{"a": oops\n{"a": 3}\n')
    schema = spark.createDataFrame([], "a long").schema
    assert sorted(r.a for r in files.read_jsonl(spark, str(path), schema, strict=False).collect()) == [1, 3]
    assert [r.line for r in files.bad_lines(spark, str(path), schema).collect()] == ['{"a": oops']
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(path), schema).collect()
    keyed = files.with_origin(files.read_jsonl(spark, str(path), schema, strict=False), r"stage_(\d+)/epoch_(\d+)", ["stage", "epoch"])
    assert {(r.stage, r.epoch) for r in keyed.collect()} == {("1", "2")}


def test_json_array(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text('[{"q": "x", "n": 1}, {"n": 2}, {"q": "y"}]')
    rows = files.read_json_array(spark, str(path), spark.createDataFrame([], "q string, n long").schema, ["q"])
    assert sorted(r.q for r in rows.collect()) == ["x", "y"]


def test_csv_survives_commas_quotes_and_nesting(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a, "b"\nc', [1, 2]), (2, None, [])], "id long, t string, xs array<int>")
    files.write_csv(df, str(tmp_path / "out"))
    back = {r.id: (r.t, r.xs) for r in files.read_csv(spark, str(tmp_path / "out")).collect()}
    assert back["1"] == ('a, "b"\nc', "[1,2]")
    assert back["2"][1] == "[]"


def test_roles_manifest_and_cache(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "y", "z")], "sample_id long, question string, input string")
    got = files.resolve(df, {"task_id": ["task_id", "sample_id"], "question": ["question", "input"], "score": ["score"]}, ["task_id"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x", None), (2, "y", None)]
    with pytest.raises(ValueError, match="score"):
        files.resolve(df, {"score": ["score"]}, ["score"])
    assert files.manifest(df, "sample_id").first() == files.manifest(df.repartition(3), "sample_id").first()
    cache = spark.createDataFrame([(1, 1, "old"), (1, 2, "new")], "sample_id long, at long, v string")
    assert {r.sample_id: r.v for r in files.from_cache(df, cache, "sample_id", "at").select("sample_id", F.col("cached.v").alias("v")).collect()} == {1: "new", 2: None}


def test_content_is_dealt_out_in_parts_of_a_size(spark, sf, monkeypatch):
    """A fixed number of parts would grow with the table."""
    from tracelake.plans import registry, sourced

    seen, write = [], sourced.files.manifest
    monkeypatch.setattr(sourced.files, "manifest", lambda df, key: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, key))[1])
    assert registry.QUERIES["content_manifest"](spark, sf).first().same
    assert any("RebalancePartitions" in plan for plan in seen) and not any("RepartitionByExpression" in plan for plan in seen)
