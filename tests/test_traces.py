"""Rewards and checks of hand-made traces, selection and resampling."""

import pytest
from pyspark.sql import functions as F

from tracelake.functions import traces as tr
from tracelake.functions import validators as va
from tracelake.operators import aggregates, matching

CALLS = "array<struct<name: string, args: array<struct<k: string, v: string>>>>"


def call(name, **args):
    return (name, sorted(args.items()))


ADD, MUL, USE = call("add", a="1", b="2"), call("mul", a="3", b="4"), call("sub", a="$var_1.result$", b="5")
GOLD = [ADD, USE, MUL]


@pytest.fixture(scope="module")
def rows(spark):
    data = {
        "perfect": (GOLD, GOLD, [True] * 3, True), "wrong_first": (GOLD, [call("div", a="1", b="2"), USE, MUL], [True] * 3, False), "other_path": (GOLD, [MUL, ADD], [True] * 2, True),
        "no_call": (GOLD, [], [], False), "too_many": (GOLD, [*GOLD, ADD], [True] * 4, True), "half_reference": (GOLD, [ADD, call("sub", a="3", b="5"), MUL], [True] * 3, True),
        "forward": (GOLD, [call("add", a="$var_2$", b="2"), USE, MUL], [True] * 3, True), "extra_key": (GOLD, [ADD, call("sub", a="$var_1.result$", b="5", c="0"), MUL], [True] * 3, True), "empty": ([], [], [], True),
    }
    table = spark.createDataFrame([(k, *v) for k, v in data.items()], f"k string, gold {CALLS}, pred {CALLS}, clean array<boolean>, final boolean")
    return table.withColumn("checks", tr.turns(F.col("gold"), F.col("pred")))


def values(rows, expression):
    return {r.k: r.x for r in rows.select("k", expression.alias("x")).collect()}


def test_strict_and_partial(rows):
    c = F.col
    strict = values(rows, tr.strict_reward(c("checks"), F.size("pred"), c("clean"), c("final")))
    assert {k: (v.reward, v.prefix) for k, v in strict.items()} == {
        "perfect": (1.0, 3), "wrong_first": (0.0, 0), "other_path": (0.0, 0), "no_call": (0.0, 0), "too_many": (0.0, 3), "half_reference": (1.0, 3), "forward": (1.0, 3), "extra_key": (0.0, 1), "empty": (0.0, 0),
    }
    part = values(rows, tr.partial_reward(c("checks"), F.size("pred"), c("clean"), c("final"), length_penalty=0.1))
    assert part["perfect"] == pytest.approx(1.0) and part["too_many"] == pytest.approx(0.9) and part["no_call"] == 0.0
    assert part["wrong_first"] == pytest.approx(0.7 * 2 / 3) and part["extra_key"] == pytest.approx(0.7 * 2.7 / 3 + 0.3)


def test_structure_and_steps(rows):
    s = values(rows, tr.structural_score(F.col("checks"), F.col("gold"), F.col("pred")))
    assert (s["perfect"].full_match, s["perfect"].error, s["perfect"].name_f1) == (True, "none", 1.0)
    assert s["wrong_first"].error == "name_mismatch" and s["wrong_first"].name_f1 == pytest.approx(2 / 3)
    assert s["no_call"].error == "parse_failure" and s["too_many"].error == "length_mismatch" and s["half_reference"].error == "arg_mismatch"
    assert s["other_path"].name_f1 == pytest.approx(0.8)
    assert values(rows, tr.ast_match(F.col("gold"), F.col("pred"))) == {k: k in ("perfect", "empty") for k in s}
    assert values(rows, F.get(F.transform("gold", tr.step_text), F.lit(1)))["perfect"] == "sub(a = $var_1.result$, b = 5)"
    assert values(rows, tr.value_of(F.get(tr.grounded(F.col("gold")), F.lit(1)), F.lit("a")))["perfect"] == "$add.result$"


def test_stepwise_caps(rows):
    c, true = F.col, F.lit(True)
    r = values(rows, tr.stepwise_reward(c("checks"), c("gold"), c("pred"), c("clean"), c("final"), true, true, true))
    assert r["perfect"] == pytest.approx(1.0)
    assert (r["no_call"], r["other_path"], r["wrong_first"], r["half_reference"], r["forward"], r["too_many"]) == (0.0, 0.30, 0.35, 0.60, 0.10, 0.70)
    early = values(rows, tr.stepwise_reward(c("checks"), c("gold"), c("pred"), c("clean"), c("final"), ~true, true, true))
    assert early["perfect"] == 0.0


def test_bands(rows):
    c, true = F.col, F.lit(True)
    columns = [c("checks"), c("gold"), c("pred"), c("clean"), c("final")]
    r = values(rows, tr.banded_reward(*columns, true, true, true, ~true))
    assert {k: v.kind for k, v in r.items()} == {
        "perfect": "fully_correct", "wrong_first": "wrong_tool", "other_path": "too_few_calls", "no_call": "no_tool_call", "too_many": "too_many_calls", "half_reference": "correct_tool_wrong_args",
        "forward": "invalid_reference", "extra_key": "correct_tool_wrong_args", "empty": "no_tool_call",
    }
    assert (r["perfect"].reward, r["no_call"].reward) == (1.0, 0.02)
    assert all(tr.BANDS[v.kind][0] <= v.reward <= tr.BANDS[v.kind][1] for v in r.values())
    early = values(rows, tr.banded_reward(*columns, ~true, true, true, ~true))
    assert early["perfect"].kind == "premature_final_nonterminal" and early["perfect"].reward == 0.04
    assert values(rows, tr.banded_reward(*columns, true, true, ~true, ~true))["perfect"].kind == "parse_error"


def test_dependencies_and_references(rows):
    bad = values(rows, tr.invalid_reference(F.col("pred")))
    assert bad["perfect"] is None and bad["forward"] == "future"
    assert values(rows, tr.missing_dependency(F.col("gold"), F.lit(2), "strict_chain"))["perfect"] == "broken_at_3"
    assert values(rows, tr.missing_dependency(F.col("gold"), F.lit(2), "dag_chain"))["perfect"] == "last_independent"
    assert values(rows, tr.missing_dependency(F.col("gold"), F.lit(2), "relaxed_nested"))["perfect"] == "independent_call"
    assert values(rows, tr.missing_dependency(F.col("gold"), F.lit(0), "strict_chain"))["empty"] is None
    with pytest.raises(ValueError):
        tr.missing_dependency(F.col("gold"), F.lit(1), "other")


def test_arguments_by_number(spark):
    one = spark.createDataFrame([(call("f", arg_10="x", arg_2="y", b="z", arg_="w"),)], "c struct<name: string, args: array<struct<k: string, v: string>>>")
    assert [e.k for e in one.select(tr.ordered_arguments(F.col("c")).alias("a")).first().a] == ["arg_2", "arg_10", "arg_", "b"]


def test_grounding_in_words(spark):
    share = lambda q, *v: spark.range(1).select(va.grounded_share(F.lit(q), F.array(*map(F.lit, v))).alias("x")).first().x
    assert share("Take twelve of 1,500 at 2.5", "12", "1500", "2.5", "7") == 0.75
    assert share("Thirty apples in box 15", "30", "5") == 0.5
    assert share("nothing", "true", "$var_1$") == 1.0
    assert share("Take -5 apples", "-5") == 1.0 and share("Take 5 of them", "five", "Five!") == 1.0 and share("at thirty", "thirty", "30", "3") == 2 / 3
    assert share("costs 1,000,000.", "1000000", "1000000.0") == 1.0 and share("box 15", "5", "", "-") == 0.0 and share("New-York City", "new york", "york c") == 0.5


def test_thousands_are_one_number(spark):
    """A number's first or last thousands are not the number that a value names."""
    share = lambda q, *v: spark.range(1).select(va.grounded_share(F.lit(q), F.array(*map(F.lit, v))).alias("x")).first().x
    assert share("Take 6,123,456 and then", "6") == 0.0 and share("Take 4,711,050", "-4711", "50", "711") == 0.0 and share("Take 1,500", "500", "1", "one") == 0.0
    assert share("of 1,500, 20,000,000 and -3,000.5", "1500", "1,500", "20000000", "-3000.5") == 1.0
    assert share("1,2,3 and 12,3456 and 1234,567", "2", "12", "3456", "567", "3") == 1.0


def test_judges_answers(spark):
    score = lambda t: spark.createDataFrame([(t,)], "t string").select(va.judge_score(F.col("t")).alias("x")).first().x
    rows = {"3": 3, "17 out of 20": 1, "Of 3 criteria... Score: 4": 3, "I'd rate it four": 4, "Four or FIVE": 4, "90 %": None, "": None, "score 0 or 6": None, "someone": 1, "8/5": 5}
    assert {t: score(t) for t in rows} == rows and score(None) is None


def test_ast_match_goes_by_values(spark):
    kind = "array<struct<name: string, args: array<struct<k: string, v: string>>>>"
    one = lambda name, **args: (name, [(k, v) for k, v in args.items()])
    cases = [
        ([one("f", a="1, b = 2")], [one("f", a="1", b="2")], False), ([one("f", a="1")], [one("f", a="1.0")], True), ([one("f", a="x  y")], [one("f", a=" x y")], True),
        ([one("f", a="1"), one("f", a="2")], [one("f", a="2"), one("f", a="1")], True), ([one("f", a="1")], [one("f", a="1"), one("f", a="1")], False), ([], [], True), ([], [one("f")], False),
        ([one("f", a="1")] * 2, [one("f", a="1"), one("f", a="2")], False), ([one("f", a="X")], [one("f", a="x")], False), ([one("f", a="1", b="2")], [one("f", b="2", a="1")], True),
        ([one("f", a=None)], [one("f", a=None)], True), ([one("f", a=None)], [one("f", a="1")], False),
    ]
    df = spark.createDataFrame([(i, g, p) for i, (g, p, _) in enumerate(cases)], f"i int, g {kind}, p {kind}")
    got = {r.i: r.m for r in df.select("i", tr.ast_match(F.col("g"), F.col("p")).alias("m")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, _, want in cases]


def test_greedy_take_is_the_walk(spark, sf):
    from tracelake.plans import registry

    df = spark.createDataFrame([("x", "o1", "p", 3), ("y", "o1", "p", 2), ("y", "o3", "p", 1), (None, None, "p", 0)], "i string, o string, pat string, score int")
    take = lambda cap: sorted(r.score for r in matching.greedy_take(df, [-F.col("score")], ["i", "o"], "pat", cap).collect())
    assert (take(9), take(2)) == ([0, 1, 3], [1, 3])
    names, outputs, brands, want = set(), set(), {}, []
    for r in sorted(spark.read.parquet(f"{sf}/part.parquet").collect(), key=lambda r: (-r.p_retailprice, r.p_partkey)):
        out = f"{r.p_brand}|{r.p_type}|{r.p_size}"
        if r.p_name not in names and out not in outputs and brands.get(r.p_brand, 0) < 20:
            names.add(r.p_name)
            outputs.add(out)
            brands[r.p_brand] = brands.get(r.p_brand, 0) + 1
            want.append(r.p_partkey)
    assert sorted(r.p_partkey for r in registry.QUERIES["greedy_take"](spark, sf).collect()) == sorted(want)


def test_nearest_number(spark):
    rows = spark.createDataFrame([(1, "a", 5.0), (2, "a", 7.0), (3, "a", None), (4, "b", 1.0), (5, None, 1.0), (6, "a", float("nan")), (7, "a", -9.0), (8, "a", 6.0)], "r int, b string, x double")
    pool = spark.createDataFrame([(20, "a", 7.0), (10, "a", 7.0), (30, "a", 5.0), (40, "a", None), (50, None, 1.0), (5, "a", 7.0)], "p int, b string, y double")
    got = sorted(tuple(r) for r in matching.nearest_number(rows, pool, "b", "x", "y", "r", "p").collect())
    assert got == [(1, 30, 0.0), (2, 5, 0.0), (7, 30, -14.0), (8, 5, -1.0)]


def test_quotas():
    assert matching.quotas({"a": 10, "b": 10, "c": 10}, {"a": 2.0, "b": 1.0}, 9) == {"a": 6, "b": 3}
    assert matching.quotas({"a": 2, "b": 10, "c": 10}, {"a": 2.0, "b": 1.0}, 9) == {"a": 2, "b": 5, "c": 2}
    assert matching.quotas({"a": 1, "b": 1}, {}, 9) == {"a": 1, "b": 1}
    assert matching.quotas({}, {"a": 1.0}, 3) == {}


def test_resampled_rates(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("k"), (F.col("id") % 5 < 2).alias("won"))
    for r in aggregates.bootstrap_rate(rows, ["k"], F.col("won")).collect():
        assert r.n == 500 and r.rate == pytest.approx(0.4)
        assert r.mean == pytest.approx(40, abs=0.3) and r.std == pytest.approx(100 * (0.24 / 500) ** 0.5, rel=0.05)
        assert r.low == pytest.approx(40 - 1.96 * 2.19, abs=0.4) and r.high == pytest.approx(40 + 1.96 * 2.19, abs=0.4)


def test_paired_resamples(spark):
    rows = spark.range(1000).select((F.col("id") % 10 < 3).alias("a"), (F.col("id") % 10 < 5).alias("b"))
    r = aggregates.bootstrap_delta(rows, "a", "b").first()
    assert r.mean == pytest.approx(0.2, abs=0.002) and r.low == pytest.approx(0.2 - 1.96 * 0.01265, abs=0.004) and r.high == pytest.approx(0.2 + 1.96 * 0.01265, abs=0.004)


def test_weighted_quotas_takes_what_it_should(spark, sf):
    from tracelake.plans import registry

    have = {r.c_mktsegment: r["count"] for r in spark.read.parquet(f"{sf}/customer.parquet").groupBy("c_mktsegment").count().collect()}
    want = matching.quotas(have, {"BUILDING": 5.0, "MACHINERY": 3.0, "HOUSEHOLD": 1.0}, sum(have.values()) // 2)
    assert {r.c_mktsegment: r["count"] for r in registry.QUERIES["weighted_quotas"](spark, sf).groupBy("c_mktsegment").count().collect()} == want


def _against_sql(spark, folder, name, **tables):
    import duckdb

    from tracelake.plans import registry

    con = duckdb.connect()
    con.execute("SET threads = 1")
    for table, rows in tables.items():
        rows.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = [tuple(r) for r in registry.QUERIES[name](spark, str(folder)).collect()]
    return sorted(got, key=str), sorted(con.execute(registry.ORACLE[name]).fetchall(), key=str)


def test_window_frames_round_halves_to_even(spark, tmp_path):
    rows = [(1, 7, "F", 100.5), (2, 7, "O", 20101.0), (3, 7, "F", 20101.5), (4, 7, "O", 20100.5), (5, 8, "F", 0.5), (6, 8, "F", 20001.0)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").coalesce(1)
    got, want = _against_sql(spark, tmp_path, "window_frames", orders=orders)
    assert got == want


def test_solver_gap_adds_lines_as_the_file_has_them(spark, tmp_path):
    """Means of 0.4 exactly, which sums in this or that order put above or below; the rows of an order lie in different tasks."""
    shares = [[0.8, 0.4, 0.8, 0.0, 0.0, 0.4], [1.0, 0.2, 0.0, 0.5, 0.4, 0.3], [0.1, 1.0, 0.1], [0.1, 0.0, 0.5, 0.7, 0.7], [0.7, 0.7, 0.1, 0.5, 0.0], [0.1, 0.1, 1.0]]
    rows = [(k, "F", round(v[i] / 10, 2), "N" if (k + i) % 2 else "R") for i in range(6) for k, v in enumerate(shares * 20, 1) if i < len(v)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linestatus string, l_discount double, l_returnflag string").coalesce(1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        got, want = _against_sql(spark, tmp_path, "solver_gap", lineitem=lines)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_mean_in_order(spark):
    rows = spark.createDataFrame([(1, 3, 0.1), (1, 1, 0.1), (1, 2, 1.0), (2, 1, None), (3, 5, 2.0), (3, 6, None)], "k int, at int, v double").repartition(4, "at")
    got = {r.k: r.m for r in rows.groupBy("k").agg(aggregates.mean_in_order(F.col("v"), F.col("at")).alias("m")).collect()}
    assert got == {1: (0.1 + 1.0 + 0.1) / 3, 2: None, 3: 2.0}


@pytest.mark.parametrize("n", [20_000])
def test_nearest_numbers_of_one_large_block(spark, n):
    """One block of many rows; a frame that is built anew for each row takes minutes here."""
    import time

    rows, pool = spark.range(n).select(F.col("id").alias("r"), F.lit("a").alias("b"), (F.col("id") * 3.0).alias("x")), spark.range(n).select(F.col("id").alias("p"), F.lit("a").alias("b"), (F.col("id") * 3.0 + 1).alias("y"))
    begin = time.monotonic()
    got = matching.nearest_number(rows, pool, "b", "x", "y", "r", "p")
    assert got.where((F.col("p") != F.col("r")) | (F.col("score") != -1.0)).count() == 0 and got.count() == n
    assert time.monotonic() - begin < 30


def test_turns_make_what_is_asked_for(spark):
    rows = spark.createDataFrame([([ADD, USE, MUL], [ADD, call("sub", a="1", b="5", c="6")]), ([ADD], [])], f"gold {CALLS}, pred {CALLS}")
    every = rows.select(tr.turns(F.col("gold"), F.col("pred")).alias("t")).collect()
    for field in tr.TURN_FIELDS:
        one = rows.select(tr.turns(F.col("gold"), F.col("pred"), field).alias("t")).collect()
        assert [[t.asDict() for t in r.t] for r in one] == [[{field: t[field]} for t in r.t] for r in every]
