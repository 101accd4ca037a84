"""Which predicted call stands for which gold one: best assignments, calls in any order, aligned steps."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import scoring

#: Calls up to which ``any_order`` looks at every assignment, by used sets; a fixed value.
MOST_EXACT = 8


def _bit(j: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), j)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _best_columns(scores: list[list[float | None]]) -> list[int] | None:
    """The column of each row in an assignment of the best sum (shortest augmenting paths); a null score cannot be taken, None if that leaves no assignment."""
    finite = [abs(x) for row in scores for x in row if x is not None and math.isfinite(x)]
    beyond = 1 + 2 * sum(finite)
    # Infinite scores and such as are no number outweigh all others.
    cost = [[math.inf if x is None else -x if math.isfinite(x) else beyond if x == -math.inf else -beyond for x in row] for row in scores]
    m = len(scores[0])
    owner, of_row, of_column = [-1] * (m + 1), [0.0] * len(scores), [0.0] * (m + 1)
    for i in range(len(scores)):
        # Column m stands for the row that is to be placed; the way to each column is its cost less what rows and columns hold.
        owner[m], at, seen = i, m, [False] * (m + 1)
        way, before = [math.inf] * m, [m] * m
        while owner[at] >= 0:
            seen[at] = True
            row = cost[owner[at]]
            for j in range(m):
                if not seen[j] and (x := row[j] - of_row[owner[at]] - of_column[j]) < way[j]:
                    way[j], before[j] = x, at
            following = min((j for j in range(m) if not seen[j]), key=way.__getitem__, default=m)
            if following == m or way[following] == math.inf:
                return None
            step = way[following]
            for j in range(m + 1):
                if seen[j]:
                    of_row[owner[j]] += step
                    of_column[j] -= step
                elif j < m:
                    way[j] -= step
            at = following
        while at != m:
            owner[at], at = owner[before[at]], before[at]
    return [owner.index(i) for i in range(len(scores))]


def best_assignment(scores: Column) -> Column:
    """Best sum of one score per row of ``scores`` (arrays of numbers, one per column), no column being taken twice.

    Exact at any size: where the rows' first best columns are all unlike, these are the assignment, else shortest augmenting
    paths find it, n rows and m columns in n^2 m steps.  A null score cannot be taken.  Null if there are more rows than
    columns, or no assignment; 0 without rows.
    """

    # Arrow, since pandas would make nulls of arrays NaN.
    @F.arrow_udf("double")
    def search(tables: pa.Array) -> pa.Array:
        def best(rows: list | None) -> float | None:
            at = None if rows is None else _best_columns(rows)
            return None if at is None else sum(row[j] for row, j in zip(rows, at, strict=True))

        return pa.array([best(rows) for rows in tables.to_pylist()], pa.float64())

    m = F.size(F.get(scores, F.lit(0)))
    at = F.transform(scores, lambda row: F.array_position(row, F.array_max(row)))
    unlike = F.coalesce(F.forall(at, lambda i: i > 0) & (F.size(F.array_distinct(at)) == F.size(scores)), F.lit(False))
    plain = F.aggregate(scores, F.lit(0.0), lambda s, row: s + F.array_max(row))
    fits = F.size(scores) <= m
    searched = search(F.when(fits & (F.size(scores) > 0) & ~unlike, scores.cast("array<array<double>>")))
    return F.when(F.size(scores) == 0, F.lit(0.0)).when(fits & unlike, plain).when(fits, searched)


def any_order(meets: Column, n_gold: Column) -> Column:
    """(valid, error) of predicted calls in any order; ``meets`` has an array per prediction, whether it meets each gold call.

    Up to eight calls, valid if some one-to-one assignment meets throughout: a fold over the predictions carries the
    sets of gold calls that can be used.  Beyond, each prediction in turn takes the first free call that it meets.
    Null ``meets`` is no prediction.
    """
    pred = F.coalesce(meets, F.array().cast("array<array<boolean>>"))
    n = F.size(pred)

    def grow(sets: Column, row: Column) -> Column:
        more = lambda s: F.filter(F.transform(row, lambda ok, j: F.when(ok & (s.bitwiseAND(_bit(j)) == 0), s.bitwiseOR(_bit(j)))), lambda x: x.isNotNull())
        return F.array_distinct(F.flatten(F.transform(sets, more)))

    exact = F.size(F.aggregate(pred, F.array(F.lit(0)), grow)) > 0

    def take(used: Column, row: Column) -> Column:
        free = F.filter(F.transform(row, lambda ok, j: F.when(ok & ~F.array_contains(used, j), j)), lambda x: x.isNotNull())
        # A prediction that meets nothing uses nothing up, which leaves the set too small in the end.
        return F.when(F.size(free) > 0, F.array_append(used, F.get(free, F.lit(0)))).otherwise(used)

    walked = F.size(F.aggregate(pred, F.array().cast("array<int>"), take)) == n
    exactly = n <= MOST_EXACT
    error = (
        F.when(n == 0, "no_function_call").when(n != n_gold, F.concat(F.lit("expected_"), n_gold.cast("string"), F.lit("_calls_got_"), n.cast("string")))
        .when(exactly & ~exact, "no_valid_permutation").when(~exactly & ~walked, "unmatched_call").otherwise("")
    )
    return F.struct((error == "").alias("valid"), error.alias("error"))


def call_meets(pred: Column, gold: Column, policy: str = "loose6") -> Column:
    """Whether a call, struct(name, args map<string,string>), meets a gold one, struct(name, args map<string,array<string>>).

    Every gold argument has one of its acceptable values; one that accepts the empty string or null may be missing.  Other
    arguments do not matter.
    """
    entries = F.map_entries(F.coalesce(gold["args"], F.create_map().cast("map<string,array<string>>")))
    given = F.coalesce(pred["args"], F.create_map().cast("map<string,string>"))

    def fits(entry: Column) -> Column:
        own = F.get(F.filter(F.map_entries(given), lambda e: e["key"] == entry["key"]), F.lit(0))
        either = lambda v: v.eqNullSafe(own["value"]) | scoring.value_match(own["value"], v, policy)
        optional = F.exists(entry["value"], lambda v: v.isNull() | (v == ""))
        return F.when(own.isNull(), optional).otherwise(F.exists(entry["value"], either))

    return (pred["name"] == gold["name"]) & F.forall(entries, fits)


def call_pair_score(gold: Column, pred: Column, policy: str = "strict9") -> Column:
    """0.2 for an equal name, 0.3 times the F1 of argument names, 0.5 times the share of shared arguments of equal value; calls are struct(name, args map<string,string>)."""
    args = lambda c: F.coalesce(c["args"], F.create_map().cast("map<string,string>"))
    name = F.trim(F.coalesce(gold["name"], F.lit("")))
    value = lambda c, k: F.element_at(args(c), k)
    match = lambda k: value(gold, k).eqNullSafe(value(pred, k)) | scoring.value_match(value(gold, k), value(pred, k), policy)
    equal = F.transform(F.filter(F.map_keys(args(gold)), lambda k: F.map_contains_key(args(pred), k)), match)
    same = (name == F.trim(F.coalesce(pred["name"], F.lit("")))) & (name != "")
    return _bound(equal, lambda e: scoring.call_score(same, F.size(e), F.size(args(pred)), F.size(args(gold)), F.size(F.filter(e, lambda x: x))))


def call_accuracy(gold: Column, pred: Column, policy: str = "strict9") -> Column:
    """Mean best score of the gold calls, each in turn taking the best free prediction, less for predictions beyond their number.

    Null arrays are empty.  Without gold calls 1 if there are no predictions either, else 0.
    """
    empty = F.array().cast("array<struct<name:string,args:map<string,string>>>")
    g, p = F.coalesce(gold, empty), F.coalesce(pred, empty)
    both = F.struct(g.alias("gold"), p.alias("pred"))
    return _bound(both, lambda s: scoring.greedy_assignment(s["gold"], s["pred"], lambda x, y: call_pair_score(x, y, policy)))


def aligned_accuracy(gold: Column, pred: Column) -> Column:
    """Share of equal places of two lists of step names, aligned if they are of unlike length; names are not null or empty.

    Unlike lists have in common the longest beginning of the predictions that is found in order within the gold
    steps; every other step stands against nothing.  Two empty lists agree.
    """
    n, m = F.size(gold), F.size(pred)
    equal = F.size(F.filter(F.zip_with(gold, pred, lambda a, b: a == b), lambda x: x))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("found"), F.lit(True).alias("on"))

    def step(s: Column, x: Column) -> Column:
        ahead = F.array_position(F.slice(gold, s["at"].cast("int") + 1, n), x)
        hit = s["on"] & (ahead > 0)
        return F.struct(F.when(hit, s["at"] + ahead).otherwise(s["at"]).alias("at"), (s["found"] + hit.cast("int")).alias("found"), hit.alias("on"))

    found = F.aggregate(pred, start, step, lambda s: s["found"])
    return F.when(n + m == 0, 1.0).when(n == m, equal / n).otherwise(_bound(found, lambda f: f / (n + m - f)))
