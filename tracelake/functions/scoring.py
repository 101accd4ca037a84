"""Classification ladders, value equality and reward arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first condition that is true; null if none is."""
    return F.coalesce(*[F.when(condition, F.lit(reason)) for condition, reason in checks])


#: The scores of a trajectory in the order in which the first short of 1 names the error.
ERROR_LADDER = {
    "call_count_score": "wrong_call_count", "tool_name_score": "wrong_tool", "label_score": "wrong_labels", "argument_key_score": "wrong_argument_keys",
    "argument_value_score": "wrong_argument_values", "reference_score": "wrong_references", "dependency_depth_score": "wrong_dependency_depth", "final_answer_score": "wrong_final_answer",
}


def trajectory_error(valid: Column, n_calls: Column, exact_answer: Column, exact: Column, scores: dict[str, Column]) -> Column:
    """The first thing wrong with a trajectory; ``scores`` by the names of the ladder, absent and null ones count as 0."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    short = [(F.coalesce(scores.get(name, F.lit(None)).cast("double"), F.lit(0.0)) < 1.0, error) for name, error in ERROR_LADDER.items()]
    silent = (F.coalesce(n_calls, F.lit(0)) == 0) & ~yes(exact_answer)
    found = first_reason((~yes(valid), "invalid_json"), (silent, "missing_output"), *short, (yes(exact), "exact_match"))
    return F.coalesce(found, F.lit("partial_match"))


def difficulty_bucket(passes: Column, n: Column) -> Column:
    rate = passes / n
    return (
        F.when(n <= 0, "unknown").when(passes == 0, "hard_failed").when(passes == n, "easy")
        .when(rate >= 0.75, "mostly_ok").when(rate >= 0.375, "unstable").otherwise("mostly_failed")
    )


def difficulty_bucket_by_count(passes: Column, n: Column) -> Column:
    """The other ladder: mostly_fail up to a quarter of the attempts, one at least."""
    few = F.greatest(F.lit(1), F.floor(n / 4))
    return (
        F.when(n <= 0, "unknown").when(passes == 0, "hard_fail").when(passes == n, "easy")
        .when(passes <= few, "mostly_fail").when(passes >= n - few, "mostly_pass").otherwise("unstable")
    )


def bandpass(p: Column, k: int, low: float = 0.25, high: float = 0.75, width: float = 0.12) -> Column:
    """0 below 1/k, 1 within the band, Gaussian tails outside."""
    away = F.greatest(F.lit(low) - p, p - F.lit(high), F.lit(0.0))
    return F.when(p < 1.0 / k, 0.0).otherwise(F.exp(-(away * away) / (2 * width * width)))


def value_match(a: Column, b: Column, policy: str) -> Column:
    """Equality of two strings under one of the named policies; null never matches.

    - ``strict9``: numbers within 1e-9 of each other unless both are written without a point, when the
      text decides; else text without its white space.
    - ``typed9``: numbers within 1e-9, however they are written; else text with single blanks.
    - ``loose6``: numbers within 1e-6; else lower case without marks at the end.
    - ``abs3``: numbers within 1e-3; else text.
    - ``rel6``: numbers within 1e-6 of the larger; else text.
    - ``places``: numbers equal at the second's decimal places; else text.
    """
    x, y = a.try_cast("double"), b.try_cast("double")
    numbers = x.isNotNull() & y.isNotNull()
    whole = a.rlike(r"^[+-]?[0-9]+$") | b.rlike(r"^[+-]?[0-9]+$")
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    end = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[.,;:!?]+$", "")
    if policy == "strict9":
        out = F.when(numbers & ~whole, F.abs(x - y) < 1e-9).otherwise(bare(a) == bare(b))
    elif policy == "typed9":
        single = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
        out = F.when(numbers, F.abs(x - y) < 1e-9).otherwise(single(a) == single(b))
    elif policy == "loose6":
        out = F.when(numbers, F.abs(x - y) < 1e-6).otherwise(end(a) == end(b))
    elif policy == "abs3":
        out = F.when(numbers, F.abs(x - y) < 1e-3).otherwise(a == b)
    elif policy == "rel6":
        out = F.when(numbers, F.abs(x - y) <= 1e-6 * F.greatest(F.abs(x), F.abs(y), F.lit(1.0))).otherwise(a == b)
    elif policy == "places":
        places = F.length(F.regexp_extract(b, r"\.([0-9]+)$", 1))
        out = F.when(numbers, F.abs(x - y) < F.pow(F.lit(10.0), -places) / 2).otherwise(a == b)
    else:
        raise ValueError(f"no policy {policy!r}")
    return F.coalesce(out, F.lit(False))


def multiset_f1(common: Column, n_pred: Column, n_gold: Column, empty: float = 1.0) -> Column:
    """2 common / (pred + gold); ``empty`` if both sides are."""
    return F.when(n_pred + n_gold == 0, F.lit(empty)).otherwise(2.0 * common / (n_pred + n_gold))


def call_score(name: Column, shared: Column, n_pred_keys: Column, n_gold_keys: Column, matching: Column) -> Column:
    """0.2 for the name, 0.3 key F1, 0.5 share of matching values on shared keys."""
    keys = multiset_f1(shared, n_pred_keys, n_gold_keys)
    values = F.when((n_pred_keys == 0) & (n_gold_keys == 0), 1.0).when(shared == 0, 0.0).otherwise(matching / shared)
    return 0.2 * name.cast("double") + 0.3 * keys + 0.5 * values


def greedy_assignment(gold: Column, pred: Column, score: Callable[[Column, Column], Column]) -> Column:
    """Mean over gold calls, in order, of the best unused prediction's ``score`` of at most 1; ties go to the first, 0 never matches.

    Less for predictions beyond the number of gold calls.  What is used is not scored again, nor what comes after a score of 1.
    """
    bind = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    n_gold, n_pred = F.size(gold), F.size(pred)
    # States are small: what a lambda returns is copied.
    start = F.struct(F.lit(0.0).alias("total"), F.array().cast("array<int>").alias("used"))
    none = F.struct(F.lit(0.0).alias("best"), F.lit(-1).alias("at"), F.lit(0).alias("j"))
    state = lambda best, at, j: F.struct(best.alias("best"), at.alias("at"), (j + 1).alias("j"))

    def step(taken: Column, g: Column) -> Column:
        def better(s: Column, p: Column) -> Column:
            same = state(s["best"], s["at"], s["j"])
            scored = bind(score(g, p), lambda x: F.when(x > s["best"], state(x, s["j"], s["j"])).otherwise(same))
            return F.when((s["best"] >= 1) | F.array_contains(taken["used"], s["j"]), same).otherwise(scored)

        def take(found: Column) -> Column:
            more = F.struct((taken["total"] + found["best"]).alias("total"), F.array_append(taken["used"], found["at"]).alias("used"))
            return F.when(found["best"] > 0, more).otherwise(taken)

        return bind(F.aggregate(pred, none, better), take)

    base = F.aggregate(gold, start, step, lambda s: s["total"])
    extra = F.greatest(F.lit(0), n_pred - n_gold)
    return (
        F.when(n_gold == 0, F.when(n_pred == 0, 1.0).otherwise(0.0)).when(n_pred == 0, 0.0)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base / n_gold / (1 + 0.25 * extra))))
    )


def capped(score: Column, *caps: tuple[Column, float]) -> Column:
    """Every cap whose condition holds, in order."""
    for condition, cap in caps:
        score = F.when(condition, F.least(score, F.lit(cap))).otherwise(score)
    return score


def execution_reward(final: Column, executable: Column, complete: Column, refs: Column, gold: Column, failed: Column, extra: Column, missing: Column) -> Column:
    """Execution-aware reward: zero on failure, weights .35/.15/.20/.10/.20, penalties, soft caps, floor.

    ``final`` and ``failed`` are booleans, the other components fractions, ``extra`` and ``missing`` counts of calls.
    """
    won = final.cast("double")
    score = 0.35 * won + 0.15 * executable + 0.20 * complete + 0.10 * refs + 0.20 * gold
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    score = score - F.when(final, F.least(F.lit(0.10), 0.02 * extra)).otherwise(0.0) - F.least(F.lit(0.40), 0.10 * missing)
    score = capped(
        score, (refs < 1, 0.30), (executable < 1, 0.25), ((missing > 0) & ~final, 0.25), (~final, 0.35), (final & (gold < 0.5), 0.55)
    )
    score = F.when((executable == 1) & final & (gold >= 0.75), F.greatest(score, F.lit(0.70))).otherwise(score)
    return F.when(failed, 0.0).otherwise(F.greatest(score, F.lit(0.0)))


def chain_depth(refs_by_call: Column) -> Column:
    """Longest path of calls, in calls, when each refers back to earlier ones (1-based); references forward do not count."""

    def step(depths: Column, refs: Column) -> Column:
        back = F.filter(refs, lambda r: (r >= 1) & (r <= F.size(depths)))
        deepest = F.coalesce(F.array_max(F.transform(back, lambda r: F.element_at(depths, r))), F.lit(0))
        return F.array_append(depths, deepest + 1)

    return F.coalesce(F.array_max(F.aggregate(refs_by_call, F.array().cast("array<int>"), step)), F.lit(0))


def suffix_returns(rewards: Column, gamma: float, final: Column, weight: float) -> Column:
    """G_t = sum of gamma^(k-t) r_k from t on, plus weight * gamma^(T-t+1) * final; one backward pass."""
    start = F.struct((final * weight).alias("g"), F.array().cast("array<double>").alias("out"))
    step = lambda s, r: F.struct((r + gamma * s["g"]).alias("g"), F.array_append(s["out"], r + gamma * s["g"]).alias("out"))
    return F.reverse(F.aggregate(F.reverse(rewards), start, step, lambda s: s["out"]))
