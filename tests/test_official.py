"""The official score against a loop over rows."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import official
from tracelake.plans import registry, traces

CALLS = "array<struct<name: string, args: array<struct<k: string, v: string>>>>"


def slow_f1(gold, pred):
    """Macro precision, recall and F1 over the labels of ``gold``, whose rows are lists of labels."""
    labels = {x for g in gold for x in g}
    scores = []
    for x in labels:
        tp = sum(x in g and x in p for g, p in zip(gold, pred, strict=True))
        ng, np_ = sum(x in g for g in gold), sum(x in p for p in pred)
        scores.append((tp / np_ if np_ else 0.0, tp / ng, 2 * tp / (ng + np_)))
    return [sum(s[i] for s in scores) / len(scores) for i in range(3)]


def slow_score(rows):
    close = lambda v: "None" if v is None else v + "$" if v.startswith("$") and not v.endswith("$") else v
    text = lambda c, cut: c[0] + "(" + ", ".join(sorted(f"{k} = {close(v) if cut else v}" for k, v in c[1])) + ")"
    parts, slots_g, slots_p = [], [], []
    for gold, pred, _ in rows:
        for name in {c[0] for c in gold + pred}:
            last = lambda calls, cut, name=name: next(([f"{k} = {close(v) if cut else v}" for k, v in c[1]] for c in reversed(calls) if c[0] == name), [])
            slots_g.append(last(gold, False))
            slots_p.append(last(pred, True))
        if not gold and not pred:
            parts.append(0.0)
        elif len(gold) == len(pred):
            parts.append(sum(text(a, False) == text(b, True) for a, b in zip(gold, pred, strict=True)) / len(gold))
        else:
            at, found, same = 0, 0, 0
            for c in pred:
                place = next((i for i in range(at, len(gold)) if gold[i][0] == c[0]), None)
                if place is None:
                    break
                found, same, at = found + 1, same + (text(gold[place], False) == text(c, True)), place + 1
            parts.append(same / (len(gold) + len(pred) - found))
    names = slow_f1([[c[0] for c in g] for g, _, _ in rows], [[c[0] for c in p] for _, p, _ in rows])
    slots = slow_f1(slots_g, slots_p)
    n = len(rows)
    return [n, sum(parts) / n, sum(p == 1 for p in parts) / n, sum(bool(w) for *_, w in rows) / n, *names, *slots]


def test_score_is_the_loop(spark):
    rng = random.Random(9)
    call = lambda: (rng.choice("abc"), [(k, rng.choice(["1", "2", "$var1.x$", None])) for k in rng.sample("xyz", rng.randint(0, 2))])
    rows = []
    for _ in range(80):
        gold = [call() for _ in range(rng.randint(0, 4))]
        pred = [c if rng.random() < 0.7 else call() for c in gold if rng.random() < 0.9] + [call()] * rng.choice([0, 0, 1])
        rows.append((gold, [(n, [(k, v[:-1] if v and v.startswith("$") and rng.random() < 0.5 else v) for k, v in args]) for n, args in pred], rng.choice([True, False, None])))
    df = spark.createDataFrame(rows, f"gold {CALLS}, pred {CALLS}, won boolean")
    row = official.official_score(df, "gold", "pred", F.col("won")).first()
    got = [row[c] for c in ("n", "partial", "full", "win_rate", "precision_name", "recall_name", "f1_name", "precision_slot", "recall_slot", "f1_slot")]
    assert got == pytest.approx(slow_score(rows))
    empty = official.official_score(df.where("false"), "gold", "pred", F.col("won")).first()
    assert empty.n == 0 and empty.f1_name is None and empty.partial is None


def test_registered_score(spark, sf):
    plain = lambda calls: [(c.name, [(a.k, a.v) for a in c.args]) for c in calls or []]
    rows = [(plain(r.gold), plain(r.pred), r.l_orderkey % 3 == 0) for r in traces.traces(registry.Tables(spark, sf)).collect()]
    row = registry.QUERIES["official_score"](spark, sf).first()
    got = [row[c] for c in ("n", "partial", "full", "win_rate", "precision_name", "recall_name", "f1_name", "precision_slot", "recall_slot", "f1_slot")]
    assert got == pytest.approx(slow_score(rows), abs=2e-9)
    assert 0 < row.f1_slot < 1 and 0 < row.partial < 1


def test_rows_are_read_once(spark, sf):
    plan = registry.QUERIES["official_score"](spark, sf)._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 1


def test_odd_rows(spark):
    rows = [(None, [("a", [("x", "1")])], True), ([("a", [("x", None), ("x", None)])], None, None), ([("a", [("x", "1")]), ("b", []), ("a", [("y", "2")])], [("a", [("x", "1")]), ("a", [("y", "2")])], False), (None, None, True)]
    row = official.official_score(spark.createDataFrame(rows, f"gold {CALLS}, pred {CALLS}, won boolean"), "gold", "pred", F.col("won")).first()
    got = [row[c] for c in ("n", "partial", "full", "win_rate", "precision_name", "recall_name", "f1_name", "precision_slot", "recall_slot", "f1_slot")]
    assert got == pytest.approx(slow_score([(g or [], p or [], w) for g, p, w in rows]))
