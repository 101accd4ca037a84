"""The nearest trace against all pairs, and how few of them are looked at."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import curation
from tracelake.operators import similarity as sim
from tracelake.plans import compare, registry

SCHEMA = "id long, motif string, calls int, tools array<string>, sequence string, trigram string, families array<string>, linear boolean, references int, fa string, k_order string"


def slow_score(a, b):
    jac = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if set(x) | set(y) else 0.0
    s = 0.20 * (a.motif == b.motif) + 0.15 * (a.calls == b.calls) + 0.25 * jac(a.tools, b.tools)
    if a.trigram and a.trigram == b.trigram:
        s += 0.20
    elif a.sequence == b.sequence:
        s += 0.15
    return round(min(1.0, s + 0.10 * jac(a.families, b.families) + 0.05 * (a.linear == b.linear) + 0.05 * (a.references == b.references)), 4)


def slow_nearest(rows, pool):
    out = {}
    for a in rows:
        scores = [(slow_score(a, b), -b.id) for b in pool]
        best = max(scores)
        out[a.id] = best[0], {-i for s, i in scores if abs(s - best[0]) < 1.5e-4}, -best[1]
    return out


def some(rng, first, n, vocabulary, skew=1):
    rows = []
    for i in range(n):
        tools = [f"t{rng.choices(range(vocabulary), [(1 + k) ** -skew for k in range(vocabulary)])[0]}" for _ in range(rng.choice([0, 1, 2, 3, 3, 4, 5]))]
        rows.append((first + i, rng.choice(["chain", "fan", None]), len(tools), list(dict.fromkeys(tools)), "->".join(tools), "->".join(tools[:3]) if len(tools) > 2 else "", sorted({t[-1] for t in tools}), rng.random() < 0.5, rng.choice([0, 1, 2, None]), "x", "y"))
    return rows


def test_nearest_is_that_of_all_pairs(spark):
    rng = random.Random(12)
    rows, pool = spark.createDataFrame(some(rng, 0, 150, 400), SCHEMA), spark.createDataFrame(some(rng, 1000, 1200, 400) + some(rng, 5000, 3, 2), SCHEMA)
    want = slow_nearest(rows.collect(), pool.collect())
    got = sim.nearest_structure(rows, pool.withColumnRenamed("id", "near"), "id", "near").collect()
    assert len(got) == 150
    for r in got:
        # Halves may round to either side, so a tie in the fourth place is none.
        assert abs(r.score - want[r.id][0]) < 1.5e-4 and r.near in want[r.id][1]
    assert sum(r.near == want[r.id][2] for r in got) >= 145
    assert sim.nearest_structure(rows, pool.where("false").withColumnRenamed("id", "near"), "id", "near").count() == 0
    assert sim.nearest_structure(rows.where("false"), pool.withColumnRenamed("id", "near"), "id", "near").count() == 0


def test_few_pairs_are_scored(spark):
    rng = random.Random(5)
    features = [*sim.STRUCTURE_FEATURES, "k_motif", "k_calls", "k_linear", "k_references", "k_order"]
    table = lambda first, n: sim.structure_keys(spark.createDataFrame([r[:9] for r in some(rng, first, n, 400, skew=0)], ", ".join(SCHEMA.split(", ")[:9])))
    _, pairs = sim._matches(table(0, 300), table(1000, 2000).withColumnRenamed("id", "near"), "id", "near", features, sim.STRUCTURE_PARTS, sim.structure_score, sim.STRUCTURE_SEEDS)
    assert pairs.count() < 300 * 2000 / 10


def test_rows_that_share_common_values_do_not_meet(spark, monkeypatch):
    """Most rows agree in all parts of few values; only those that share a tool or an order are looked up."""
    met = {}
    write = sim.materialize
    monkeypatch.setattr(sim, "materialize", lambda df, name: met.setdefault(name, write(df, name)))
    rng = random.Random(3)
    alike = lambda r: (r[0], "chain", *r[2:6], ["A"], True, 1, *r[9:])
    rows, pool = (spark.createDataFrame([alike(r) for r in some(rng, first, n, 900, skew=0)], SCHEMA) for first, n in ((0, 200), (1000, 3000)))
    want = slow_nearest(rows.collect(), pool.collect())
    got = sim.nearest_structure(rows, pool.withColumnRenamed("id", "near"), "id", "near").collect()
    assert len(got) == 200 and all(abs(r.score - want[r.id][0]) < 1.5e-4 and r.near in want[r.id][1] for r in got)
    assert met["match_met"].count() < 200 * 3000 / 20


@pytest.mark.parametrize("vocabulary", [40, 300])
def test_one_common_tool_is_looked_up_by_class(spark, monkeypatch, vocabulary):
    """Of the rows of a class and size with a tool, only the smallest id meets others; equal numbers of calls make no pairs."""
    met = {}
    write = sim.materialize
    monkeypatch.setattr(sim, "materialize", lambda df, name: met.setdefault(name, write(df, name)) if name == "match_met" else write(df, name))
    rng = random.Random(9)
    wide = lambda r: (r[0], *r[1:6], [["A"], ["B"], ["A", "B"]][r[0] % 3], True, 1, *r[9:])
    rows, pool = (spark.createDataFrame([wide(r) for r in some(rng, first, n, vocabulary, skew=0)], SCHEMA) for first, n in ((0, 200), (1000, 6000)))
    want = slow_nearest(rows.collect(), pool.collect())
    got = sim.nearest_structure(rows, pool.withColumnRenamed("id", "near"), "id", "near").collect()
    assert len(got) == 200 and all(abs(r.score - want[r.id][0]) < 1.5e-4 and r.near in want[r.id][1] for r in got)
    assert met["match_met"].count() < 10 * 200


def test_registered_query(spark, sf):
    rows = [r for r in compare.structures(registry.Tables(spark, sf)).withColumnRenamed("o_orderkey", "id").collect()]
    asked, pool = [r for r in rows if r.o_orderstatus == "F"][:40], [r for r in rows if r.o_orderstatus != "F"]
    want = slow_nearest(asked, pool)
    got = {r.o_orderkey: r for r in registry.QUERIES["nearest_trace"](spark, sf).collect()}
    assert len(got) == sum(r.o_orderstatus == "F" for r in rows)
    assert all(abs(got[i].score - w[0]) < 1.5e-4 and got[i].near_orderkey in w[1] for i, w in want.items())


def _pairs_by_loop(sets, threshold):
    out = {}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and len(x & y) / len(x | y) >= threshold:
                out[a, b] = len(x & y) / len(x | y)
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.8])
def test_token_pairs_of_small_and_large_sets(spark, threshold):
    rng = random.Random(5)
    sets = {}
    for i in range(120):
        base = set(sets[rng.randrange(i)]) if i and rng.random() < 0.7 else {f"t{rng.randrange(90)}" for _ in range(rng.choice([1, 2, 5, 12, 30, 34, 50]))}
        for _ in range(rng.randrange(4)):
            base ^= {f"t{rng.randrange(90)}"}
        sets[i] = base
    # 11 of 20 tokens, all of them behind the rare ones: a bound rounded up would lose this pair at 0.55.
    sets[200], sets[201] = {f"c{i}" for i in range(11)} | {f"r{i}" for i in range(9)}, {f"c{i}" for i in range(11)}
    rows = spark.createDataFrame([(i, [*s, None]) for i, s in sets.items()], "id long, tokens array<string>")
    got = {(r.a_id, r.b_id): r.jaccard for r in curation.token_pairs(rows, rows, threshold, ordered=True).collect()}
    want = _pairs_by_loop(sets, threshold)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    both = {(r.a_id, r.b_id) for r in curation.token_pairs(rows.where("id < 60"), rows, threshold).collect()}
    assert both == {(i, j) for i in range(60) for j in sets if (min(i, j), max(i, j)) in want or (i == j and sets[i])}


def test_copies_and_unlike_sets_of_a_size_do_not_meet(spark, monkeypatch):
    """Copies are one class, and sets with one differing token of five share no key unless they reach the threshold."""
    met = {}
    write = curation.materialize
    monkeypatch.setattr(curation, "materialize", lambda df, name: met.setdefault(name, write(df, name)))
    rows = spark.range(3000).select(F.col("id"), F.array(*[F.concat(F.lit(c), (F.col("id") % m).cast("string")) for c, m in zip("abcde", (5, 7, 2, 3, 1))]).alias("tokens"))
    n = curation.token_pairs(rows, rows, 0.8, ordered=True).count()
    assert n == 60 * (15 * 14 // 2) + 150 * (14 * 13 // 2)  # 3000 rows of 210 sets
    assert met["token_keys"].where("n = m").groupBy("k").count().agg({"count": "max"}).first()[0] == 1
