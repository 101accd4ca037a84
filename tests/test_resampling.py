"""Bootstrap weights, replay, races, percentiles and assignments against plain loops."""

import itertools
import math
import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import assignment, calls
from tracelake.operators import aggregates
from tracelake.operators import resampling as rs
from tracelake.plans import registry

# Poisson bootstrap


def test_poisson_weights_are_poisson_and_their_own():
    w = rs.poisson_weights(np.arange(400, dtype=np.int64) * 7919 - 5, 500, 3)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs((w == 0).mean() - math.exp(-1)) < 0.005 and abs((w == 3).mean() - math.exp(-1) / 6) < 0.003
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.2 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.2
    assert (rs.poisson_weights(np.array([2]), 4, 3) == rs.poisson_weights(np.array([5, 2]), 4, 3)[1]).all()


SCORES = "k string, task string, x double, total_of int, cluster_of int"


def test_bootstrap_is_the_weighted_mean_of_clusters(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([f"t{i}" for i in range(9)] + [None]), rng.choice([None, rng.gauss(5, 2)]), 1, 2) for _ in range(300)] + [("none", "t", None, 1, 2)]
    df = spark.createDataFrame(rows, SCORES)
    hashes = {r.task: r.h for r in df.select("task", F.xxhash64("task").alias("h")).distinct().collect()}
    for parts in (1, 5):
        got = {r.k: r for r in rs.poisson_bootstrap(df.repartition(parts), ["k"], "x", "task", resamples=60, seed=9).collect()}
        assert got.keys() == {"a", "b", None, "none"} and tuple(got["none"])[1:] == (0, None, None, None, None)
        for key in ("a", "b", None):
            own = [(hashes[t], x) for k, t, x, _, _ in rows if k == key and x is not None]
            weights = {h: rs.poisson_weights(np.array([h]), 60, 9)[0] for h, _ in own}
            means = [sum(weights[h][b] * x for h, x in own) / c for b in range(60) if (c := sum(weights[h][b] for h, _ in own))]
            r = got[key]
            assert (r.n, r.mean) == (len(own), pytest.approx(statistics.fmean(x for _, x in own)))
            assert (r.std, r.low, r.high) == (pytest.approx(statistics.pstdev(means)), pytest.approx(np.percentile(means, 2.5)), pytest.approx(np.percentile(means, 97.5)))
    assert rs.poisson_bootstrap(df.where("false"), ["k"], "x", "task").count() == 0
    assert rs.poisson_bootstrap(df, [], "x", "task", resamples=20).count() == 1


def test_bootstrap_agrees_with_the_draw_of_outcomes(spark):
    df = spark.range(4000).select("id", F.lit("x").alias("k"), (F.xxhash64("id") % 10 < 3).alias("won")).withColumn("score", F.col("won").cast("double"))
    real = rs.poisson_bootstrap(df, ["k"], "score", "id", resamples=800).first()
    drawn = aggregates.bootstrap_rate(df, ["k"], F.col("won"), resamples=20_000).first()
    assert abs(100 * real.mean - 100 * drawn.rate) < 1e-9
    assert abs(100 * real.std - drawn["std"]) < 0.06 and abs(100 * real.low - drawn.low) < 0.2 and abs(100 * real.high - drawn.high) < 0.2


# Replay


def test_places_and_draws(spark):
    rows = [(k, s) for k in [*range(50), None] for s in ("a", None)] + [(3, "a")]
    placed = rs.with_place(spark.createDataFrame(rows, "k int, s string").repartition(7), F.col("k"), "s", "at").collect()
    assert sorted(r["at"] for r in placed if r.s == "a") == list(range(52)) and sorted(r["at"] for r in placed if r.s is None) == list(range(51))
    assert {r.s: r.at_of for r in placed} == {"a": 52, None: 51}
    got = rs.replay(spark.createDataFrame([(i,) for i in range(20)], "k int"), "k", 4000).collect()
    times = [r.times for r in got]
    assert sum(times) == 4000 and len(times) == 20 and max(abs(t - 200) for t in times) < 60
    assert rs.replay(spark.createDataFrame([], "k int"), "k", 10).count() == 0
    assert (rs.replay_size(10, 0.05), rs.replay_size(100, 0.25)) == (1, 25)


def test_mix_of_stages(spark):
    rows = spark.createDataFrame([("s1" if i < 10 else "s2" if i < 40 else None, i) for i in range(130)], "stage string, id int")
    assert rs.replay_weights(["s1", "s2", "s3"], 0.2) == {"s1": 0.1, "s2": 0.1, "s3": 0.8} and rs.replay_weights(["s"], 0.4) == {"s": 1.0}
    got = rs.mixed_pool(rows, "stage", "id", {"s1": 3.0, "s2": 1.0}).collect()
    per = Counter()
    for r in got:
        per[r.stage] += r.times
    assert per == {"s1": 30, "s2": 10}
    assert all(r.times == 1 for r in got if r.stage == "s2")
    with pytest.raises(ValueError, match="gone"):
        rs.mixed_pool(rows, "stage", "id", {"s1": 0.5, "gone": 0.5})


# Picks whose weights follow


def test_race_is_the_sequential_draw_in_distribution(spark):
    groups, picks, runs = 6, 30, 300
    rows = [(f"{run}", f"g{g}", f"{run}-{g}-{i}") for run in range(runs) for g in range(groups) for i in range(picks if g else 4)]
    df = spark.createDataFrame(rows, "run string, g string, key string").cache()
    rng, walked, raced = random.Random(4), [], []
    for _ in range(4000):
        counts = [0] * groups
        for _ in range(12):
            g = rng.choices(range(groups), [1 / (1 + c) if c < (4 if g == 0 else 99) else 0 for g, c in enumerate(counts)])[0]
            counts[g] += 1
        walked.append(sorted(counts[1:], reverse=True))
    for run in range(60):
        got = Counter(r.g for r in rs.balanced_pick(df.where(F.col("run") == f"{run}"), "g", "key", 12, 1.0).collect())
        assert sum(got.values()) == 12
        raced.append(sorted((got.get(f"g{g}", 0) for g in range(1, groups)), reverse=True))
    for place in range(groups - 1):
        theirs, ours = [w[place] for w in walked], [r[place] for r in raced]
        assert abs(statistics.fmean(ours) - statistics.fmean(theirs)) < 4 * statistics.pstdev(theirs) / math.sqrt(len(ours))


def test_race_keeps_the_share(spark):
    df = spark.range(1000).select(F.col("id").alias("key"), F.when(F.col("id") < 900, "big").when(F.col("id") < 950, None).otherwise("small").alias("g"), F.lit(1).alias("race_nth"))
    got = rs.balanced_pick(df, "g", "key", 30, 0.4)
    assert got.columns == df.columns
    counts = Counter(r.g for r in got.collect())
    assert max(counts.values()) <= 12 and sum(counts.values()) == 30
    assert rs.balanced_pick(df, "g", "key", 2, 0.1).count() == 2


# Percentiles


@pytest.mark.parametrize("k", [8, 400])
def test_percentiles_are_exact(spark, k):
    rng = random.Random(2)
    groups = {"wide": [rng.gauss(0, 9) for _ in range(3000)], "tied": [float(rng.choice([1, 1, 1, 2])) for _ in range(500)], "one": [4.0], None: [1.0, 2.0], "none": []}
    rows = [(g, x) for g, xs in groups.items() for x in [*xs, None, float("nan")]]
    got = {r.g: r for r in rs.exact_percentiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"p50": 0.5, "p3": 0.03, "top": 1.0, "least": 0.0, "p99": 0.99}, k=k).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        want = [float(np.percentile(xs, q)) for q in (50, 3, 100, 0, 99)] if xs else [None] * 5
        assert got[g].n == len(xs) and [got[g][c] for c in ("p50", "p3", "top", "least", "p99")] == pytest.approx(want)


# Assignments


def test_best_assignment_is_the_best_permutation(spark):
    rng = random.Random(6)
    tables = [[[round(rng.random(), 3) for _ in range(m)] for _ in range(n)] for n, m in [(1, 1), (2, 3), (3, 3), (4, 6), (5, 5), (2, 8), (8, 8), (3, 2)]] + [[]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tables)], "i int, s array<array<double>>")
    got = {r.i: (r.b, r.m) for r in df.select("i", assignment.best_assignment(F.col("s")).alias("b"), calls.permutation_match(F.col("s")).alias("m")).collect()}
    for i, t in enumerate(tables):
        if not t:
            assert got[i] == (0.0, 1.0)
        elif len(t) > len(t[0]):
            assert got[i] == (None, 0.0)
        else:
            best = max(sum(r[j] for r, j in zip(t, p, strict=True)) for p in itertools.permutations(range(len(t[0])), len(t)))
            assert got[i] == (pytest.approx(best), pytest.approx(best / len(t)))


def slow_any_order(meets, n_gold):
    n = len(meets)
    if not n:
        return "no_function_call"
    if n != n_gold:
        return f"expected_{n_gold}_calls_got_{n}"
    if n <= 8:
        return "" if any(all(meets[p][g] for p, g in enumerate(perm)) for perm in itertools.permutations(range(n))) else "no_valid_permutation"
    used = set()
    for row in meets:
        free = [g for g in range(n) if row[g] and g not in used]
        if not free:
            return "unmatched_call"
        used.add(free[0])
    return ""


def test_calls_in_any_order(spark):
    rng = random.Random(7)
    tables = [([[rng.random() < share for _ in range(g)] for _ in range(n)], g) for n, g, share in [(1, 1, 1), (2, 2, 0.5), (3, 3, 0.6), (4, 4, 0.5), (7, 7, 0.4), (7, 7, 0.5), (3, 2, 1), (0, 2, 1), (10, 10, 0.5), (10, 10, 0.9), (12, 12, 0.8)] for _ in range(4)]
    # Beyond eight calls the first one takes what the second needs, which is a failure by the walk and none by a search.
    tables += [([[True, True] + [False] * 7, [True] + [False] * 8, *[[i == j for j in range(9)] for i in range(2, 9)]], 9)]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(tables)], "i int, m array<array<boolean>>, n int")
    got = {r.i: (r.x.valid, r.x.error) for r in df.select("i", assignment.any_order(F.col("m"), F.col("n")).alias("x")).collect()}
    for i, (t, g) in enumerate(tables):
        want = slow_any_order(t, g)
        assert got[i] == (want == "", want)
    assert got[len(tables) - 1][1] == "unmatched_call"
    assert spark.range(1).select(assignment.any_order(F.lit(None).cast("array<array<boolean>>"), F.lit(1))["error"].alias("e")).first().e == "no_function_call"


def test_call_meets_acceptable_values(spark):
    cases = [
        (("f", {"a": "1.0"}), ("f", {"a": ["1", "2"]}), True), (("f", {"a": "3"}), ("f", {"a": ["1", "2"]}), False), (("g", {}), ("f", {}), False),
        (("f", {}), ("f", {"a": ["", "2"]}), True), (("f", {}), ("f", {"a": [None]}), True), (("f", {}), ("f", {"a": ["2"]}), False),
        (("f", {"a": "2", "more": "x"}), ("f", {"a": ["2"]}), True), (("f", None), ("f", None), True), (("f", {"a": None}), ("f", {"a": [None, "1"]}), True),
    ]
    df = spark.createDataFrame([(i, p, g) for i, (p, g, _) in enumerate(cases)], "i int, p struct<name string, args map<string,string>>, g struct<name string, args map<string,array<string>>>")
    got = {r.i: r.m for r in df.select("i", assignment.call_meets(F.col("p"), F.col("g")).alias("m")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, _, want in cases]


def slow_accuracy(gold, pred):
    if not gold or not pred:
        return float(not gold and not pred)
    used, total = set(), 0.0
    for g in gold:
        best, at = 0.0, None
        for j, p in enumerate(pred):
            if j in used:
                continue
            common = [k for k in g[1] if k in p[1]]
            f1 = 1.0 if not g[1] and not p[1] else 2 * len(common) / (len(g[1]) + len(p[1]))
            value = (1.0 if not g[1] and not p[1] else 0.0) if not common else sum(g[1][k] == p[1][k] for k in common) / len(common)
            score = 0.2 * (g[0] == p[0] != "") + 0.3 * f1 + 0.5 * value
            if score > best + 1e-12:
                best, at = score, j
        if at is not None:
            used.add(at)
            total += best
    return total / len(gold) / (1 + 0.25 * max(0, len(pred) - len(gold)))


def test_call_accuracy_has_argument_names(spark, sf):
    from tracelake.plans import resampled

    rows = {r.l_orderkey: ([(c.name, c.args) for c in r.gold], [(c.name, c.args) for c in r.pred]) for r in resampled._calls(registry.Tables(spark, sf)).collect()}
    got = {r.l_orderkey: r.accuracy for r in registry.QUERIES["call_accuracy_arguments"](spark, sf).collect()}
    assert got == {k: pytest.approx(slow_accuracy(g, p), abs=2e-9) for k, (g, p) in rows.items()}
    assert len({round(v, 3) for v in got.values()}) > 5


def test_call_accuracy_makes_no_list_of_all_pairs(spark, sf):
    rng = random.Random(5)
    call = lambda: (rng.choice("ab"), {k: rng.choice(["1", "1.0", "1.50", "1.5", "x y", "xy"]) for k in rng.sample("xyz", rng.randint(0, 3))})
    rows = [(i, [call() for _ in range(rng.randint(0, 24))], [call() for _ in range(rng.randint(0, 24))]) for i in range(12)]
    df = spark.createDataFrame(rows, "i int, gold array<struct<name:string,args:map<string,string>>>, pred array<struct<name:string,args:map<string,string>>>")
    out = df.select("i", assignment.call_accuracy(F.col("gold"), F.col("pred")).alias("a"))
    # strict9: texts of one form without white space; two forms of one number are equal if both have a point.
    form = lambda v: {"1.50": "1.5", "x y": "xy"}.get(v, v)
    plain = lambda calls: [(n, {k: form(v) for k, v in args.items()}) for n, args in calls]
    assert {r.i: r.a for r in out.collect()} == {i: pytest.approx(slow_accuracy(plain(g), plain(p))) for i, g, p in rows}
    # A prediction that is used is not looked at again, so nothing is listed and sorted for each gold call.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "flatten" not in plan
    from tracelake.plans import resampled

    shuffled = resampled._calls(registry.Tables(spark, sf))._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[1]
    assert "map" not in shuffled and "supplier" not in shuffled


def slow_alignment(g, p):
    if len(g) == len(p):
        return sum(a == b for a, b in zip(g, p, strict=True)) / len(g) if g else 1.0
    at, hits = 0, 0
    for x in p:
        while at < len(g) and g[at] != x:
            at += 1
        if at == len(g):
            break
        at, hits = at + 1, hits + 1
    return hits / (len(g) + len(p) - hits)


def test_alignment(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 6))], [rng.choice("abc") for _ in range(rng.randint(0, 6))]) for i in range(200)]
    got = {r.i: r.a for r in spark.createDataFrame(rows, "i int, g array<string>, p array<string>").select("i", assignment.aligned_accuracy(F.col("g"), F.col("p")).alias("a")).collect()}
    assert got == {i: pytest.approx(slow_alignment(g, p)) for i, g, p in rows}
