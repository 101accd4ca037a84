"""Comparison and rewards of call traces: a call is a struct (name, args), args an array of (k, v) sorted by key.

Everything is an expression over two arrays of calls, gold and predicted, of one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import scoring

#: Component weights and caps of the rewards, which results depend on.
STEPWISE_WEIGHTS = {"format": 0.10, "tools": 0.20, "values": 0.15, "references": 0.15, "dependency": 0.10, "executable": 0.10, "count": 0.10, "final": 0.10}
STEPWISE_CAPS = {"invalid_reference": 0.10, "too_few": 0.30, "wrong_tool": 0.35, "wrong_args": 0.60, "too_many": 0.70, "wrong_final": 0.75}
STEPWISE_FLOOR = 0.90
BAND_WEIGHTS = {"format": 0.10, "count": 0.20, "tools": 0.20, "values": 0.20, "references": 0.10, "executable": 0.10, "final": 0.10}
BANDS = {
    "parse_error": (0.0, 0.0), "clipped": (0.0, 0.0), "no_tool_call": (0.02, 0.02), "premature_final_nonterminal": (0.04, 0.04), "invalid_reference": (0.05, 0.15), "wrong_tool": (0.10, 0.35),
    "too_few_calls": (0.10, 0.45), "correct_tool_wrong_args": (0.35, 0.60), "too_many_calls": (0.45, 0.70), "executable_wrong_final": (0.60, 0.80), "fully_correct": (0.90, 1.00), "partial_progress": (0.10, 0.55),
}
CURRICULUM_WEIGHTS = {"format": 0.15, "count": 0.10, "name": 0.15, "labels": 0.10, "keys": 0.10, "values": 0.15, "references": 0.15, "final": 0.10}
PROCESS_WEIGHTS = {"format": 0.10, "known": 0.15, "keys": 0.15, "types": 0.15, "references": 0.15, "executed": 0.15, "integrity": 0.15}


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def _mean(values: Column, n: Column) -> Column:
    """Sum of an array over ``n``; 0 if n is."""
    return F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)


def keys_of(call: Column) -> Column:
    return F.transform(call["args"], lambda e: e["k"])


def value_of(call: Column, key: Column) -> Column:
    return F.get(F.filter(call["args"], lambda e: e["k"] == key), F.lit(0))["v"]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: inside lambdas Spark evaluates an expression as often as it is written."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_reference(value: Column) -> Column:
    return value.startswith("$") & value.rlike(r"^\$[A-Za-z_]\w*(\.[^$]*)?\$$")


def referred(value: Column) -> Column:
    """The call a value refers to, from 1; null if it is no reference."""
    return F.when(value.startswith("$"), F.nullif(F.regexp_extract(value, r"^\$var_?([0-9]+)(?:\.[A-Za-z0-9_]+)?\$$", 1), F.lit("")).cast("int"))


def references_of(call: Column) -> Column:
    return F.filter(F.transform(call["args"], lambda e: referred(e["v"])), lambda x: x.isNotNull())


def step_text(call: Column) -> Column:
    """A call as ``name(k = v, ...)``, keys in order."""
    return F.concat(call["name"], F.lit("("), F.array_join(F.transform(call["args"], lambda e: F.concat(e["k"], F.lit(" = "), e["v"])), ", "), F.lit(")"))


def grounded(calls: Column) -> Column:
    """Calls whose references name the function that made the value instead of its place; others stay."""

    def value(v: Column) -> Column:
        producer = F.get(calls, referred(v) - 1)["name"]
        return F.when(producer.isNotNull(), F.concat(F.lit("$"), producer, F.regexp_replace(v, r"^\$var_?[0-9]+", ""))).otherwise(v)

    return F.transform(calls, lambda c: F.struct(c["name"].alias("name"), F.transform(c["args"], lambda e: F.struct(e["k"].alias("k"), value(e["v"]).alias("v"))).alias("args")))


def ordered_arguments(call: Column) -> Column:
    """Arguments ``arg_N`` by their number, the others after them by name."""
    number = lambda e: F.coalesce(F.nullif(F.regexp_extract(e["k"], r"^arg_([0-9]+)$", 1), F.lit("")).cast("long"), F.lit(1 << 40))
    keyed = F.transform(call["args"], lambda e: F.struct(number(e).alias("n"), e["k"].alias("k"), e["v"].alias("v")))
    return F.transform(F.array_sort(keyed), lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v")))


#: What is known of a turn.
TURN_FIELDS = ("there", "name", "keys", "values", "loose", "graded", "exact", "shared", "n")


def turns(gold: Column, pred: Column, *fields: str) -> Column:
    """Per gold position: name, keys and all arguments right, share of gold arguments with the right value, and two graded forms.

    ``values`` counts equal values over gold keys, ``loose`` also a reference for any other; ``graded`` gives a reference for a reference 1, a
    literal for a reference a half, and is diluted by unexpected keys.  Of TURN_FIELDS only ``fields`` are made, if any are named: each costs time.
    """

    yes = lambda c: F.coalesce(c, F.lit(False))

    def values(g: Column, p: Column) -> Column:
        """Of each gold argument whether the value is equal, and whether that of gold and that of the prediction are there and references."""
        one = lambda want, have: F.struct(yes(have == want).alias("equal"), yes(is_reference(want)).alias("wants"), have.isNotNull().alias("has"), yes(is_reference(have)).alias("refers"))
        return F.transform(g["args"], lambda e: _let(value_of(p, e["k"]), lambda have: one(e["v"], have)))

    wanted = set(fields or TURN_FIELDS)
    any_of = lambda *names: bool(wanted & set(names))

    def turn(g: Column, i: Column) -> Column:
        return _let(F.get(pred, i), lambda p: _let(seen(g, p), scores))

    def seen(g: Column, p: Column) -> Column:
        own, theirs = keys_of(g), F.coalesce(keys_of(p), F.array().cast("array<string>"))
        parts = [p.isNotNull().alias("there"), F.size(g["args"]).alias("n"), yes(p["name"] == g["name"]).alias("name")]
        if any_of("keys", "shared"):
            parts.append(own.alias("own"))
        if any_of("keys", "shared", "graded"):
            parts.append(theirs.alias("theirs"))
        if any_of("graded", "exact"):
            parts.append(F.size(F.array_except(theirs, own)).alias("extra"))
        if any_of("values", "loose", "graded", "exact"):
            parts.append(values(g, p).alias("values"))
        return F.struct(*parts)

    def scores(s: Column) -> Column:
        n, there = s["n"], s["there"]
        equal = lambda: F.size(F.filter(s["values"], lambda v: v["equal"]))
        loose = lambda: F.size(F.filter(s["values"], lambda v: v["equal"] | (v["wants"] & v["refers"])))
        credit = lambda v: F.when(~v["has"], 0.0).when(v["wants"], F.when(v["refers"], 1.0).otherwise(0.5)).otherwise(v["equal"].cast("double"))
        share = lambda: F.aggregate(s["values"], F.lit(0.0), lambda a, v: a + credit(v)) / n * n / (n + s["extra"])
        made = {
            "there": lambda: there, "name": lambda: s["name"], "keys": lambda: there & (F.array_sort(s["own"]) == F.array_sort(s["theirs"])),
            "values": lambda: F.when(n == 0, F.lit(1.0)).otherwise(equal() / n), "loose": lambda: F.when(n == 0, F.lit(1.0)).otherwise(loose() / n),
            "graded": lambda: F.when(~there, 0.0).when(n == 0, F.when(F.size(s["theirs"]) == 0, 1.0).otherwise(0.5)).otherwise(share()),
            "exact": lambda: s["name"] & (equal() == n) & (s["extra"] == 0), "shared": lambda: F.size(F.array_intersect(s["own"], s["theirs"])), "n": lambda: n,
        }
        return F.struct(*[made[f]().alias(f) for f in TURN_FIELDS if f in wanted])

    return F.transform(gold, turn)


def strict_reward(checks: Column, n_pred: Column, clean: Column, final: Column) -> Column:
    """(reward, prefix, first_error): 1 only for the gold trace turn by turn and the gold answer; ``clean`` are booleans by position."""
    passed = F.transform(checks, lambda t, i: t["name"] & t["keys"] & F.coalesce(F.get(clean, i), F.lit(False)))
    first = F.nullif(F.array_position(passed, F.lit(False)), F.lit(0))
    whole = first.isNull() & (F.size(checks) > 0) & (n_pred == F.size(checks))
    return F.struct(_flag(whole & final).alias("reward"), F.coalesce(first - 1, F.size(checks).cast("long")).alias("prefix"), (first - 1).alias("first_error"))


def partial_reward(checks: Column, n_pred: Column, clean: Column, final: Column, length_penalty: float = 0.0) -> Column:
    """0.7 of the mean turn (0.4 name, then 0.3 keys and 0.3 execution with the name) and 0.3 for the answer."""
    turn = lambda t, i: _flag(t["name"]) * (0.4 + 0.3 * _flag(t["keys"]) + 0.3 * _flag(F.get(clean, i)))
    extra = F.greatest(n_pred - F.size(checks), F.lit(0))
    return F.greatest(F.lit(0.0), 0.7 * _mean(F.transform(checks, turn), F.size(checks)) + 0.3 * _flag(final) - length_penalty * extra)


def structural_score(checks: Column, gold: Column, pred: Column) -> Column:
    """Multiset F1 of names, calls right over gold calls, share of right arguments over the calls compared, and the first error."""
    names = lambda c: F.transform(c, lambda x: x["name"])
    count = lambda c, v: F.size(F.filter(c, lambda x: x == v))
    common = F.aggregate(F.array_distinct(names(gold)), F.lit(0), lambda a, v: a + F.least(count(names(gold), v), count(names(pred), v)))
    n, m = F.size(gold), F.size(pred)
    compared = F.filter(checks, lambda t: t["there"])
    exact = F.size(F.filter(compared, lambda t: t["name"] & (t["loose"] >= 1)))
    ratio = F.transform(compared, lambda t: t["loose"])
    full = (n == m) & (exact == n)
    return F.struct(
        F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(2.0 * common / (n + m)).alias("name_f1"), F.when(n > 0, exact / n).otherwise(0.0).alias("call_accuracy"),
        _mean(ratio, F.size(compared)).alias("arg_ratio"), (full & (m > 0)).alias("full_match"),
        F.when(m == 0, "parse_failure").when(n != m, "length_mismatch").when(full, "none").when(F.exists(compared, lambda t: ~t["name"]), "name_mismatch").otherwise("arg_mismatch").alias("error"),
    )


def same_call(gold: Column, pred: Column, policy: str = "typed9") -> Column:
    """Equal names, equal sets of keys, and equal values under ``policy``; null values are equal."""
    paired = lambda e: F.exists(pred["args"], lambda o: (o["k"] == e["k"]) & (o["v"].eqNullSafe(e["v"]) | scoring.value_match(o["v"], e["v"], policy)))
    return (gold["name"] == pred["name"]) & (F.size(gold["args"]) == F.size(pred["args"])) & F.forall(gold["args"], paired)


def ast_match(gold: Column, pred: Column, policy: str = "typed9") -> Column:
    """Whether each gold call in turn finds a free prediction that is the same call, and no prediction is left; keys of a call are distinct."""

    def take(used: Column, call: Column) -> Column:
        free = F.filter(F.transform(pred, lambda p, j: F.when(same_call(call, p, policy) & ~F.array_contains(used, j), j)), lambda j: j.isNotNull())
        return F.when(F.size(free) > 0, F.array_append(used, F.get(free, F.lit(0)))).otherwise(used)

    found = F.size(F.aggregate(gold, F.array().cast("array<int>"), take))
    return (F.size(gold) == F.size(pred)) & (found == F.size(gold))


def category_check(gold: Column, pred: Column, category: Column, optional: Column) -> Column:
    """Calls checked by kind: none may be made if 'irrelevance'; else the first must fit, whatever else it holds.

    A gold argument that the prediction lacks is forgiven if its key is among ``optional``; unexpected
    arguments are not looked at.
    """
    g, p = F.get(gold, F.lit(0)), F.get(pred, F.lit(0))
    wrong = F.exists(g["args"], lambda e: F.coalesce(value_of(p, e["k"]) != e["v"], ~F.array_contains(optional, e["k"])))
    return F.when(category == "irrelevance", F.size(pred) == 0).otherwise(F.coalesce((p["name"] == g["name"]) & ~wrong, F.lit(False)))


def valid_reference_share(calls: Column) -> Column:
    """Share of references that point back to an earlier call; null without references."""
    marked = F.flatten(F.transform(calls, lambda c, i: F.transform(references_of(c), lambda r: (r >= 1) & (r <= i))))
    return _let(marked, lambda m: F.when(F.size(m) > 0, F.size(F.filter(m, lambda x: x)) / F.size(m)))


def stepwise_reward(checks: Column, gold: Column, pred: Column, clean: Column, final: Column, terminal: Column, has_final: Column, parsed: Column) -> Column:
    """Weighted components, then the first cap that applies, then a floor for what is wholly right."""
    n, m = F.size(gold), F.size(pred)
    w, caps = STEPWISE_WEIGHTS, STEPWISE_CAPS
    executable = F.when(m > 0, F.size(F.filter(clean, lambda x: x)) / m).otherwise(0.0)
    refs = valid_reference_share(pred)
    gold_refs = F.flatten(F.transform(gold, lambda c, i: F.transform(F.filter(c["args"], lambda e: is_reference(e["v"])), lambda e: F.struct(i.alias("i"), e["k"].alias("k")))))
    used = F.filter(gold_refs, lambda s: F.coalesce(is_reference(value_of(F.get(pred, s["i"]), s["k"])), F.lit(False)))
    dependency = F.when(F.size(gold_refs) > 0, F.size(used) / F.size(gold_refs)).otherwise(1.0)
    ending = F.when(terminal, _flag(final)).otherwise(_flag(~has_final))
    score = (
        w["format"] * _flag(parsed) + w["tools"] * _mean(F.transform(checks, lambda t: _flag(t["name"])), n) + w["values"] * _mean(F.transform(checks, lambda t: t["graded"]), n)
        + w["references"] * F.coalesce(refs, F.when(F.size(gold_refs) > 0, 0.0).otherwise(1.0)) + w["dependency"] * dependency + w["executable"] * executable
        + w["count"] * F.when(n > 0, F.greatest(F.lit(0.0), 1 - F.abs(m - n) / n)).otherwise(0.0) + w["final"] * ending
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    tools = F.forall(checks, lambda t: t["name"])
    args = F.forall(checks, lambda t: t["graded"] >= 1)
    runs = executable >= 1
    cap = (
        F.when(~parsed | (m == 0) | (~terminal & has_final), 0.0).when(refs < 1, caps["invalid_reference"]).when(m < n, caps["too_few"]).when(~tools, caps["wrong_tool"])
        .when(~args, caps["wrong_args"]).when(m > n, caps["too_many"]).when(runs & terminal & ~final, caps["wrong_final"])
    )
    right = tools & args & runs & (m == n) & (final | ~terminal)
    return F.when(cap.isNotNull(), F.least(score, cap)).when(right, F.greatest(score, F.lit(STEPWISE_FLOOR))).otherwise(score)


def _dependency_share(gold: Column, pred: Column) -> Column:
    """Share of the gold references' places at which the prediction has a reference, too; null without gold references."""
    places = F.flatten(F.transform(gold, lambda c, i: F.transform(F.filter(c["args"], lambda e: is_reference(e["v"])), lambda e: F.struct(i.alias("i"), e["k"].alias("k")))))
    used = F.filter(places, lambda s: F.coalesce(is_reference(value_of(F.get(pred, s["i"]), s["k"])), F.lit(False)))
    return F.when(F.size(places) > 0, F.size(used) / F.size(places))


def banded_reward(checks: Column, gold: Column, pred: Column, clean: Column, final: Column, terminal: Column, has_final: Column, parsed: Column, clipped: Column) -> Column:
    """(kind, quality, reward): the first kind of failure that applies sets a band, the weighted components the place in it.

    Quality is dense, so equal failures still differ; the bands keep the kinds in order whatever it is.
    """
    n, m, w = F.size(gold), F.size(pred), BAND_WEIGHTS
    refs, used = valid_reference_share(pred), _dependency_share(gold, pred)
    executable = F.when(m > 0, F.size(F.filter(clean, lambda x: x)) / m).otherwise(0.0)
    reference = F.coalesce(refs, F.when(used.isNull(), 1.0).otherwise(0.0))
    quality = (
        w["format"] * _flag(parsed & ~clipped) + w["count"] * F.when(n > 0, F.least(F.lit(1.0), m / n)).otherwise(0.0) + w["tools"] * _mean(F.transform(checks, lambda t: _flag(t["name"])), n)
        + w["values"] * _mean(F.transform(checks, lambda t: t["graded"]), n) + w["references"] * F.coalesce(0.5 * reference + 0.5 * used, reference)
        + w["executable"] * executable + w["final"] * F.when(terminal, _flag(final)).otherwise(_flag(~has_final))
    )
    tools = (n > 0) & F.forall(checks, lambda t: t["name"])
    args = F.forall(checks, lambda t: t["graded"] >= 1)
    runs, ended = executable >= 1, F.when(terminal, final).otherwise(~has_final)
    kinds = (
        (~parsed, "parse_error"), (clipped, "clipped"), (m == 0, "no_tool_call"), (~terminal & has_final, "premature_final_nonterminal"), (refs < 1, "invalid_reference"),
        (tools & args & runs & (m == n) & ended, "fully_correct"), (m < n, "too_few_calls"), ((n > 0) & ~tools, "wrong_tool"), (tools & ~args, "correct_tool_wrong_args"),
        (m > n, "too_many_calls"), (tools & args & runs & terminal & ~final, "executable_wrong_final"),
    )
    kind = F.coalesce(*[F.when(condition, F.lit(name)) for condition, name in kinds], F.lit("partial_progress"))
    in_unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality))
    low, high = (F.element_at(F.create_map(*[F.lit(x) for name, band in BANDS.items() for x in (name, band[side])]), kind) for side in (0, 1))
    return F.struct(kind.alias("kind"), in_unit.alias("quality"), F.round(low + (high - low) * in_unit, 6).alias("reward"))


def curriculum_components(checks: Column, gold: Column, pred: Column, labels: Column, answered: Column, final: Column) -> Column:
    """Eight components in [0, 1] and their weighted sum; ``labels`` are the predicted calls' labels."""
    n, m = F.size(gold), F.size(pred)
    there = F.filter(checks, lambda t: t["there"])
    key_score = lambda t: F.when(t["n"] == 0, 1.0).otherwise(t["shared"] / t["n"])

    def reference_score(g: Column, i: Column) -> Column:
        p = F.get(pred, i)
        found = F.filter(p["args"], lambda e: referred(e["v"]).isNotNull())
        points = F.transform(found, lambda e: F.when((referred(e["v"]) < 1) | (referred(e["v"]) > i), 0.0).when(F.coalesce(value_of(g, e["k"]) == e["v"], F.lit(False)), 1.0).when(~F.contains(e["v"], F.lit(".")), 0.5).otherwise(0.0))
        return F.when(p.isNull(), 0.0).when(F.size(found) == 0, 1.0).otherwise(_mean(points, F.size(found)))

    parts = {
        "format": F.when(m == 0, 0.0).otherwise(F.least(0.5 + 0.5 * _flag(answered), F.when((n > 0) & (m != n), 0.5).otherwise(1.0))),
        "count": F.when(m == n, 1.0).when(m > n, F.greatest(F.lit(0.0), 0.5 - 0.1 * (m - n))).otherwise(m / F.greatest(n, F.lit(1))),
        "name": _mean(F.transform(checks, lambda t: _flag(t["name"])), n),
        "labels": F.when(m != n, 0.0).otherwise(_mean(F.transform(labels, lambda x, i: _flag(x == F.concat(F.lit("$var_"), (i + 1).cast("string")))), n)),
        "keys": _mean(F.transform(there, key_score), n), "values": _mean(F.transform(there, lambda t: t["values"]), n),
        "references": _mean(F.transform(gold, reference_score), n), "final": _flag(answered & final),
    }
    total = sum((CURRICULUM_WEIGHTS[k] * v for k, v in parts.items()), F.lit(0.0))
    return F.struct(*[v.alias(k) for k, v in parts.items()], F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("total"))


def process_score(pred: Column, known: Column, allowed: Column, required: Column, clean: Column, parsed: Column) -> Column:
    """Seven shares that need no gold trace, weighted: format, known tools, keys, number types, references, execution twice."""
    m = F.size(pred)
    share = lambda good: F.when(m > 0, F.size(F.filter(pred, good)) / m).otherwise(0.0)
    is_known = lambda c: F.array_contains(known, c["name"])
    fits = lambda c: is_known(c) & (F.size(F.array_except(keys_of(c), allowed)) == 0) & (F.size(F.array_except(required, keys_of(c))) == 0)
    typed = lambda c: is_known(c) & F.forall(c["args"], lambda e: F.array_contains(allowed, e["k"]) & (is_reference(e["v"]) | e["v"].rlike(r"^-?[0-9.]+$")))
    ran = F.when(m > 0, F.size(F.filter(clean, lambda x: x)) / m).otherwise(0.0)
    parts = {
        "format": _flag(parsed), "known": share(is_known), "keys": share(fits), "types": share(typed), "references": F.coalesce(valid_reference_share(pred), F.lit(1.0)), "executed": ran, "integrity": ran,
    }
    return sum((PROCESS_WEIGHTS[k] * v for k, v in parts.items()), F.lit(0.0))


def invalid_reference(calls: Column) -> Column:
    """Why a trace's first bad reference is bad: itself or a later call; null if all point back."""
    marked = F.flatten(F.transform(calls, lambda c, i: F.transform(references_of(c), lambda r: F.when(r == i + 1, "self").when(r > i + 1, "future").when(r < 1, "none"))))
    return F.get(F.filter(marked, lambda x: x.isNotNull()), F.lit(0))


def missing_dependency(calls: Column, depth: Column, mode: str) -> Column:
    """Why a trace lacks the dependencies its kind needs; null if it has them.  ``depth`` is its longest chain."""
    n = F.size(calls)
    back = F.transform(calls, lambda c, i: F.filter(references_of(c), lambda r: (r >= 1) & (r <= i)))
    place = lambda good: F.nullif(F.array_position(F.transform(back, good), F.lit(True)), F.lit(0))
    none = F.forall(back, lambda b: F.size(b) == 0)
    alone = place(lambda b, i: (i > 0) & (F.size(b) == 0))
    if mode == "strict_chain":
        broken = place(lambda b, i: (i > 0) & ~F.array_contains(b, i))
        why = F.when(broken.isNotNull(), F.concat(F.lit("broken_at_"), broken.cast("string"))).when(depth < n, "too_shallow")
    elif mode == "dag_chain":
        roots = F.size(F.filter(back, lambda b, i: (i > 0) & (F.size(b) == 0)))
        why = F.when(roots > F.floor(n / 2), "too_many_roots").when(F.size(F.element_at(back, -1)) == 0, "last_independent").when(depth < F.greatest(F.lit(3), n - 3), "too_shallow")
    elif mode == "relaxed_nested":
        why = F.when((n == 2) & ~F.array_contains(F.element_at(back, 2), 1), "second_independent").when(depth < 2, "too_shallow").when(alone.isNotNull(), "independent_call")
    else:
        raise ValueError(f"no mode {mode!r}")
    return F.when(n < 2, F.lit(None)).when(none, "no_dependency").otherwise(why)
