"""Tables replaced whole or by the key: what a reader sees through rewrites, crashes and compaction."""

import pytest

from tracelake.sources import versions


def test_rewrite_is_whole_or_absent(spark, tmp_path, monkeypatch):
    table = versions.Versioned(spark, f"file://{tmp_path}/t")
    with pytest.raises(ValueError):
        table.read()
    table.write(spark.range(5))
    before = table.read()
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(versions.Pointer, "write", lambda *_: (_ for _ in ()).throw(RuntimeError("power")))
        table.write(table.read().where("id > 1"))
    assert table.read().count() == 5
    table.write(table.read().where("id > 2"))
    assert sorted(r.id for r in table.read().collect()) == [3, 4] and before.count() == 5
    assert table.vacuum() == 1 and table.read().count() == 2 and before.count() == 5
    table.write(table.read().where("false"))
    assert table.read().count() == 0


def test_last_write_wins_and_compaction_touches_little(spark, tmp_path):
    cache = versions.KeyedCache(spark, f"file://{tmp_path}/c", "k", buckets=8)
    asked = spark.createDataFrame([(k, "x") for k in [*range(40), None]], "k long, of_base string")
    assert all(r.cached is None for r in cache.get(asked).collect()) and cache.compact() == []
    model = {}

    def put(rows):
        cache.put(spark.createDataFrame(rows, "k long, v string, n int"))
        for k, v, n in rows:
            if k is not None:
                model[k] = (v, n)

    def check():
        got = cache.get(asked)
        assert got.columns == ["k", "of_base", "cached"]
        assert {r.k: r.cached and tuple(r.cached) for r in got.collect()} == {k: model.get(k) for k in [*range(40), None]}

    put([(k, "a", 1) for k in range(30)] + [(None, "never", 0)])
    check()
    put([(k, "b", 2) for k in range(10, 20)])
    check()
    assert cache.compact() == list(range(8))
    check()
    base = dict(cache._now()["base"])
    put([(3, "c", None)])
    check()
    touched = cache.compact()
    check()
    assert len(touched) == 1
    now = cache._now()["base"]
    assert {b for b in now if now[b] != base[b]} == {str(touched[0])} and cache._now()["deltas"] == []
    put([(3, None, 9)])
    check()


def test_a_lookup_groups_only_deltas(spark, tmp_path):
    cache = versions.KeyedCache(spark, f"file://{tmp_path}/c", "k")
    cache.put(spark.range(100).selectExpr("id AS k", "id AS v"))
    cache.compact()
    plan = cache.get(spark.range(10).withColumnRenamed("id", "k"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan


def test_runs_by_name(spark, tmp_path):
    for name in ("run-2024-2", "run-2024-10", "run-2023-9", "other"):
        (tmp_path / name).mkdir()
    (tmp_path / "run-2025-1").write_text("a file")
    found = versions.run_folders(spark, f"file://{tmp_path}", r"run-(\d{4})-(\d+)")
    assert [f[1] for f in found] == [("2023", "9"), ("2024", "10"), ("2024", "2")]
    assert versions.latest_run(spark, f"file://{tmp_path}", r"run-(\d{4})-(\d+)").endswith("run-2024-2")
    assert versions.latest_run(spark, f"file://{tmp_path}", "none") is None
