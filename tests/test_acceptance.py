"""Running caps against one walk, an exactly-once log through crashes, and the loop that learns and stops."""

import pytest
from pyspark.sql import functions as F

from tracelake.plans import registry, streams
from tracelake.streaming import acceptance as acc

CANDIDATES = "id long, stage string, score double, kind string, tier string, reason string"
RULES = [
    acc.Rule("score", "score", share=0.4, after=5), acc.Rule("kind", "kind", share=0.5, after=5), acc.Rule("easy", "tier", share=0.25, value="easy", after=3),
    acc.Rule("need", "tier", floor=0.3, value="good", after=3), acc.Rule("full", "kind", limit=9),
]


def slow_walk(rows, rules, columns, start=()):
    """(id, reason) by the rules as they read, over dictionaries; rows are (id, stage, values by column, reason)."""
    n, counts, out = {}, {}, {}
    for _, stage, values, _ in start:
        n[stage] = n.get(stage, 0) + 1
        for c in columns:
            counts[stage, c, values[c]] = counts.get((stage, c, values[c]), 0) + 1
    for i, stage, values, reason in sorted(rows, key=lambda r: r[0]):
        total, why = n.get(stage, 0), reason
        for r in rules:
            if why is None and total >= r.after:
                own, value = counts.get((stage, r.column, values[r.column]), 0), values[r.column]
                if r.floor is not None:
                    if value != r.value and counts.get((stage, r.column, r.value), 0) / (total + 1) < r.floor:
                        why = r.reason
                elif r.value in (None, value) and ((r.share is not None and (own + 1) / (total + 1) > r.share) or (r.limit is not None and own >= r.limit)):
                    why = r.reason
        out[i] = why
        if why is None:
            n[stage] = total + 1
            for c in columns:
                counts[stage, c, values[c]] = counts.get((stage, c, values[c]), 0) + 1
    return out


def some(n, first=0):
    return [(i, "ab"[i % 2] if i % 17 else None, [0.5, 0.504, None, 0.25][i * i % 4], ["x", "y", "", None, "z"][i * 7 % 5], ["easy", "good", "part"][i * 5 % 3], "bad" if i % 13 == 0 else None) for i in range(first, first + n)]


def plain(rows):
    text = lambda v: "unknown" if v in (None, "") else f"{v:.2f}" if isinstance(v, float) else v
    return [(r[0], r[1], {"score": text(r[2]), "kind": text(r[3]), "tier": text(r[4])}, r[5]) for r in rows]


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_caps_are_one_walk_however_the_stream_is_cut(spark, batches):
    rows = some(150)
    got = acc.judged_in_batches(spark.createDataFrame(rows, CANDIDATES), "stage", "id", RULES, batches).collect()
    assert len(got) == 150
    assert {r.id: r.reason for r in got} == slow_walk(plain(rows), RULES, ["score", "kind", "tier"])


def test_a_large_stage_comes_in_more_batches(spark, monkeypatch):
    monkeypatch.setattr(acc, "AT_ONCE", 20)
    batches, judge = [], acc.judge_new
    monkeypatch.setattr(acc, "judge_new", lambda *a: (batches.append(1), judge(*a))[1])
    rows = some(150)
    df = spark.createDataFrame(rows, CANDIDATES)
    part, placed, parts = acc.parts_of(df, "stage", "id", 2)
    held = placed.groupBy("stage", part.alias("part")).agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).orderBy("stage", "part").collect()
    # 71 and 70 rows of a and b, 9 without a stage.
    assert sum(r.n for r in held) == 150 and max(r.n for r in held) <= 22 and parts == 4
    assert all(a.last < b.first for a, b in zip(held, held[1:], strict=False) if a.stage == b.stage)
    got = acc.judged_in_batches(df, "stage", "id", RULES, 2).collect()
    assert len(batches) == 4 and len(got) == 150
    assert {r.id: r.reason for r in got} == slow_walk(plain(rows), RULES, ["score", "kind", "tier"])
    assert acc.judged_in_batches(df.where("false"), "stage", "id", RULES, 2).count() == 0


def test_caps_go_on_from_an_earlier_run(spark):
    first, rows = some(60), some(60, 60)
    earlier = acc.judged_in_batches(spark.createDataFrame(first, CANDIDATES), "stage", "id", RULES, 1).where("reason is null")
    seed = acc.seeds(earlier, "stage", RULES)
    got = acc.judged_in_batches(spark.createDataFrame(rows, CANDIDATES), "stage", "id", RULES, 2, seed).collect()
    both = slow_walk(plain(first + rows), RULES, ["score", "kind", "tier"])
    assert {r.id: r.reason for r in got} == {i: both[i] for i in range(60, 120)}


def numbers(spark, folder, n):
    spark.range(n).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@pytest.mark.parametrize("crash", ["before the record", "after the record"])
def test_a_crash_leaves_no_row_twice_or_lost(spark, tmp_path, monkeypatch, crash):
    folder = f"file://{tmp_path}"
    ledger, commit = acc.Ledger(spark, f"{folder}/log"), acc.Ledger.commit
    stream = numbers(spark, folder, 5)
    acc.append_once(stream, ledger, "r", f"{folder}/marks").awaitTermination()

    def die(self, entry):
        if crash == "after the record":
            commit(self, entry)
        raise RuntimeError("power")

    numbers(spark, folder, 7)
    with monkeypatch.context() as m, pytest.raises(Exception, match="power"):
        m.setattr(acc.Ledger, "commit", die)
        acc.append_once(stream, ledger, "r", f"{folder}/marks").awaitTermination()
    assert ledger.table().count() == (5 if crash == "before the record" else 12)
    numbers(spark, folder, 1)
    acc.append_once(stream, acc.Ledger(spark, f"{folder}/log"), "r", f"{folder}/marks").awaitTermination()
    assert sorted(r.id for r in ledger.table().collect()) == sorted([*range(5), *range(7), 0])
    assert ledger.vacuum() == (crash == "before the record") and ledger.table().count() == 13
    with pytest.raises(OSError, match="already"):
        ledger.commit({"run": "r", "batch": 0, "attempt": "x"})
    with pytest.raises(ValueError):
        acc.Ledger(spark, f"{folder}/none").table()
    assert acc.Ledger(spark, f"{folder}/none").table("id long").count() == 0


def test_the_loop_learns_stops_and_goes_on(spark, tmp_path):
    rules = [acc.Rule("kind", "kind", share=0.5, after=4)]
    told = []

    def generate(number, learnings):
        told.append((number, list(learnings)))
        kinds = ["x"] * 6 if "kind" not in learnings else ["y", "z", "y"]
        return spark.createDataFrame([(number * 100 + i, "s", k) for i, k in enumerate(kinds)], "id long, stage string, kind string")

    run = lambda target, most, least=0.0: acc.generate_until(spark, generate, "stage", "id", rules, f"file://{tmp_path}", "r", target, most, 2, least)
    why, control = run(100, 1)
    assert (why, control.batches, control.accepted, control.refused, control.learnings) == ("budget", 1, 4, {"kind": 2}, ["kind"])
    why, control = run(7, 9)  # goes on with the second batch, and its state
    assert why == "target" and control.batches == 2 and control.accepted == 7
    assert told == [(0, []), (1, ["kind"])]
    assert run(100, 9, least=0.9)[0] == "rate"
    assert len(told) == 2  # a run that has stopped makes nothing more


def test_stage_caps_are_the_walk_over_the_table(spark, sf):
    rows = streams.candidates(registry.Tables(spark, sf)).collect()
    text = lambda v: "unknown" if v is None else f"{v:.2f}"
    want = slow_walk([(r.event_id, r.stage, {"weak_score": text(r.weak_score), "failure_type": r.failure_type, "tier": r.tier}, None) for r in rows], streams.STAGE_RULES, ["weak_score", "failure_type", "tier"])
    got = registry.QUERIES["stream_stage_caps"](spark, sf).collect()
    assert {r.event_id: r.reason for r in got} == want and len(got) == len(rows)
    assert len({r.reason for r in got}) >= 4


def test_several_caps_in_a_stream_are_those_of_a_batch(spark, sf):
    ids = lambda name: sorted(r.event_id for r in registry.QUERIES[name](spark, sf).collect())
    assert ids("stream_several_caps") == ids("several_caps")


def test_generation_loop_is_the_loop_over_the_table(spark, sf):
    table = streams.candidates(registry.Tables(spark, sf)).where("stage = 0").withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(4))).collect()
    text = lambda v: "unknown" if v is None else f"{v:.2f}"
    columns, done, want, learnings, accepted, refused = ["weak_score", "failure_type", "tier"], [], {}, [], 0, 0
    for number in range(4):
        if number >= 2 and accepted / max(1, accepted + refused) < 0.02:
            break
        rows = [r for r in table if r.part == number and not ("diversity_cap_failure_type" in learnings and r.failure_type == "error")]
        batch = [(r.event_id, 0, {"weak_score": text(r.weak_score), "failure_type": r.failure_type, "tier": r.tier}, None) for r in rows]
        out = slow_walk(batch, streams.STAGE_RULES, columns, done)
        done += [b for b in batch if out[b[0]] is None]
        want |= out
        reasons = [w for w in out.values() if w]
        accepted, refused = accepted + len(out) - len(reasons), refused + len(reasons)
        learnings = (sorted(set(reasons), key=lambda w: (-reasons.count(w), w))[:3] + learnings)[:6]
    got = registry.QUERIES["stream_generation_loop"](spark, sf).collect()
    assert {r.event_id: r.reason for r in got} == want and len(got) == len(want)
