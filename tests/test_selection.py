"""Selection under quotas and caps, and scores of turns, against plain loops and odd rows."""

from pyspark.sql import functions as F

from tracelake.functions import calls
from tracelake.operators import selection as sel
from tracelake.plans import registry

TURN = "struct<name:string,args:map<string,string>>"


def turn_of(pred, gold, ignored=()):
    """The rule as a loop."""
    bare = lambda v: (v or "").strip().strip("'\"").lower()
    plain = lambda c: ((c[0] or "").strip().lower(), {k: bare(v) for k, v in (c[1] or {}).items() if k not in ignored})
    ours, theirs = [plain(c) for c in pred or []], [plain(c) for c in gold or []]
    free, names, params = list(range(len(theirs))), 0, 0
    for call in ours:
        whole = [j for j in free if theirs[j] == call]
        named = [j for j in free if theirs[j][0] == call[0]]
        if whole or named:
            free.remove((whole or named)[0])
            names += 1
            params += bool(whole)
    correct = bool(ours) and params == len(theirs) == len(ours)
    error = "parse_failure" if not ours else "none" if correct else "name_mismatch" if not names else "param_mismatch" if params < len(theirs) else "wrong_count"
    share = lambda n: round(params / n, 4) if n else 0.0
    return len(ours), len(theirs), names, params, correct, share(len(ours)), share(len(theirs)), error


def test_turn_scorer_is_the_loop(spark, sf):
    by = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect():
        by.setdefault(r.l_orderkey, []).append(r)
    want = {}
    for key, rows in by.items():
        name = lambda r: r.l_returnflag.lower() if r.l_linenumber % 2 == 0 else r.l_returnflag
        rows = sorted(rows, key=lambda r: (r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_shipdate, r.l_quantity))
        made, half = [(name(r), {"status": r.l_linestatus}) for r in rows], -(-len(rows) // 2)
        want[key] = turn_of(made[half:], made[:half])
    got = {r[0]: tuple(r[1:]) for r in registry.QUERIES["turn_scorer"](spark, sf).collect()}
    assert got == want


def test_turn_score_on_odd_turns(spark):
    a, b, c = ("F", {"x": " '1' ", "t": "9"}), ("f ", {"x": "1"}), ("f", {"x": "2"})
    turns = [
        ([a], [b]), ([b, c], [c, b]), ([c, b], [b]), ([c], [b]), ([b, b], [b]), ([("g", {})], [b]), ([], [b]), (None, [b]), ([b], []), ([b], None), (None, None),
        ([(None, None)], [(None, {"x": None})]), ([("f", {"x": None})], [("f", {"x": ""})]),
    ]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(turns)], f"i int, pred array<{TURN}>, gold array<{TURN}>")
    got = {r[0]: tuple(r[1]) for r in rows.select("i", calls.turn_score(F.col("pred"), F.col("gold"), ("t",))).collect()}
    assert got == {i: turn_of(*t, ignored=("t",)) for i, t in enumerate(turns)}


def test_nested_caps_is_the_walk(spark):
    rows = [(i, i % 3, i * i % 5) for i in range(200)] + [(200, None, None), (201, None, None), (202, None, None)]
    inner, outer, want = {}, {}, []
    for i, a, b in rows:
        if inner.get((a, b), 0) < 2 and outer.get(a, 0) < 3:
            inner[a, b], outer[a] = inner.get((a, b), 0) + 1, outer.get(a, 0) + 1
            want.append(i)
    df = spark.createDataFrame(rows, "rank_at int, a int, b int")  # a name that the operator would take
    got = sel.nested_caps(df, "a", "b", 2, 3, [F.col("rank_at")])
    assert got.columns == df.columns
    assert sorted(r[0] for r in got.collect()) == want


def test_quota_with_backfill_on_little(spark):
    df = spark.createDataFrame([(1, "d", "easy"), (2, "d", None), (3, "e", "odd"), (4, None, "hard")], "id int, dom string, lv string")
    pick = lambda quotas, rows=df: sorted((r.id, r["pass"]) for r in sel.quota_with_backfill(rows, quotas, "dom", "lv", {"easy": 0.5, "medium": 0.3, "hard": 0.2}, "id", [F.col("id")]).collect())
    assert pick({"d": 1, "e": 1}) == [(1, 2), (3, 2)]  # a half rounds to nothing and the hard level lacks
    assert pick({"d": 9}) == [(1, 1), (2, 1), (3, 3), (4, 3)]
    assert pick({"d": 2}, df.limit(0)) == []


def test_accept_rate_stop_and_feedback_on_little(spark):
    batches = spark.createDataFrame([(1, 1, 4, 0), (1, 2, 4, 4), (1, 3, 12, 0), (1, 4, 4, 4), (2, 1, 0, 0)], "run int, batch int, n long, ok long")
    got = sorted((r.run, r.batch, r.rate, r.ran) for r in sel.accept_rate_stop(batches, "run", "batch", "n", "ok", 2, 0.3).collect())
    assert got == [(1, 1, 0.0, True), (1, 2, 0.5, True), (1, 3, 0.2, True), (1, 4, 8 / 24, False), (2, 1, 0.0, True)]
    rejected = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 1, "b"), (1, 2, None), (1, 3, "c")], "run int, batch int, why string")
    got = sorted((r.batch, r.top, r.learnings) for r in sel.rejection_feedback(rejected, "run", "batch", "why", remembered=2).collect())
    assert got == [(1, ["b", "a"], ["b", "a"]), (3, ["c"], ["c", "b"])]


def test_trimmed_menu_on_little(spark):
    rows = spark.createDataFrame([(1, ["b", "z"], ["a", "b", "c"]), (2, None, ["a"]), (3, ["c", "b", "a"], ["a", "b", "c"]), (4, ["a"], None)], "k int, used array<string>, names array<string>")
    got = {r.k: r.m for r in rows.select("k", sel.trimmed_menu(F.col("used"), F.col("names"), F.col("k"), 2, 2).alias("m")).collect()}
    assert got[1][0] == "b" and len(got[1]) == 2
    assert (got[2], got[3], got[4]) == (["a"], ["a", "b"], [])


def test_plain_arguments_on_odd_values(spark):
    texts = ['{"a": "[1, \\"2, 3\\"]"}', '{"a": "[1"}', '{"a": "1"}', '{"a": "1 2\\n3"}', '{"a": "$var_1.x$"}', '{"a": "{}"}', '{"a": "1 2,3"}', "[1, 2]", "no", "", None, '{"a": ' + "[" * 3000 + "]" * 3000 + "}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.v for r in rows.select("i", calls.plain_arguments(F.col("t")).alias("v")).collect()}
    assert [got[i] for i in range(11)] == ['{"a":[1,[2,3]]}', '{"a":"[1"}', '{"a":"1"}', '{"a":[1,2,3]}', '{"a":"$var_1.x$"}', '{"a":{}}', '{"a":"1 2,3"}', None, None, None, None]
    assert got[11] in (None, '{"a":' + "[" * 3000 + "]" * 3000 + "}")  # deeper than the reader goes is no object


def walk_of(rows, caps):
    """Places of the rows accepted one after the other."""
    used, out = {}, []
    for at, *keys in sorted(rows):
        held = [(i, k) for i, k in enumerate(keys) if k is not None]
        if all(used.get(h, 0) < caps[h[0]] for h in held):
            out.append(at)
            for h in held:
                used[h] = used.get(h, 0) + 1
    return out


def test_several_caps_is_the_walk(spark, sf):
    rows = [(r.event_id, f"{r.user_id}:{r.event_type}", r.event_id % 31, r.event_type) for r in spark.read.parquet(f"{sf}/events.parquet").collect()]
    assert sorted(r[0] for r in registry.QUERIES["several_caps"](spark, sf).collect()) == walk_of(rows, [2, 8, 60])


def test_capped_walk_on_odd_keys(spark):
    rows = [(i, (i * 7) % 5 if i % 4 else None, (i * 3) % 4 if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a int, b int")
    assert sorted(r[0] for r in sel.capped_walk(df, "i", {"a": 3, "b": 2}).collect()) == walk_of(rows, [3, 2])
    assert sel.capped_walk(df.limit(0), "i", {"a": 3, "b": 2}).count() == 0
