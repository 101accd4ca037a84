"""Rewards, checks and rewrites of call traces.  Stand-in: an order's lines are its gold calls, named by
flag and status, with arguments d, q and, on every third part, r, a reference to the call before; the
prediction drops, renames and alters some of them by their part and supplier numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import scoring
from tracelake.functions import traces as tr
from tracelake.operators import official
from tracelake.plans.registry import Tables, query
from tracelake.plans.rollups import LINE_ORDER, LINE_ORDER_SQL

#: The same as CTEs: g gold and p predicted calls by position, o an order's counts and answer, t gold with the prediction at its place.
_LINES = f"""l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}, l_quantity) AS pos, CAST(l_quantity AS INTEGER) AS qi,
  CAST(round(l_discount * 100) AS INTEGER) AS di FROM lineitem),
g AS (SELECT l_orderkey, pos, l_returnflag || l_linestatus AS name, CAST(di AS VARCHAR) AS d, CAST(qi AS VARCHAR) AS q,
  CASE WHEN pos > 1 AND l_partkey % 3 = 0 THEN '$var_' || (pos - 1) || '.result$' END AS r FROM l),
p AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS pos, CASE WHEN l_suppkey % 7 = 0 THEN 'X' ELSE l_returnflag || l_linestatus END AS name,
  CASE WHEN l_partkey % 13 <> 0 THEN CAST(di AS VARCHAR) END AS d, CAST(CASE WHEN l_suppkey % 5 = 0 THEN qi + 1 ELSE qi END AS VARCHAR) AS q,
  CASE WHEN pos > 1 AND l_partkey % 3 = 0 THEN CASE WHEN l_suppkey % 6 = 0 THEN '1' ELSE '$var_' || (pos - 1) || '.result$' END END AS r,
  CASE WHEN l_partkey % 17 = 0 THEN '0' END AS x, l_tax < 0.08 AS clean FROM l WHERE l_partkey % 11 <> 0),
o AS (SELECT l_orderkey, sum(qi) % 3 <> 0 AS final, count(*) AS n, count_if(l_partkey % 11 <> 0) AS m FROM l GROUP BY 1)"""
_TURNS = f"""{_LINES}, t AS (SELECT g.l_orderkey, g.pos, o.final, o.n, o.m, coalesce(p.clean, false) AS clean, p.name IS NOT NULL AS there, coalesce(p.name = g.name, false) AS name_ok,
  p.name IS NOT NULL AND (p.d IS NOT NULL) AND (p.r IS NULL) = (g.r IS NULL) AND p.x IS NULL AS keys_ok, 2 + CAST(g.r IS NOT NULL AS INTEGER) AS k,
  CAST(coalesce(p.d = g.d, false) AS INTEGER) + CAST(coalesce(p.q = g.q, false) AS INTEGER) AS plain_ok, CAST(coalesce(p.r = g.r, false) AS INTEGER) AS ref_equal,
  CAST(coalesce(g.r IS NOT NULL AND p.r LIKE '$%', false) AS INTEGER) AS ref_any, CAST(coalesce(g.r IS NOT NULL AND p.r IS NOT NULL, false) AS INTEGER) AS ref_there,
  CAST(p.x IS NOT NULL AS INTEGER) + CAST(g.r IS NULL AND p.r IS NOT NULL AS INTEGER) AS extra, CAST(p.d IS NOT NULL AS INTEGER) + CAST(p.q IS NOT NULL AS INTEGER) AS plain_there
  FROM g JOIN o USING (l_orderkey) LEFT JOIN p ON p.l_orderkey = g.l_orderkey AND p.pos = g.pos)"""

#: Further CTEs: w has an order's shares of right tools, arguments, references and executed calls.
_STEPS = """pr AS (SELECT l_orderkey, count_if(r LIKE '$%') AS refs, count_if(r LIKE '$%' AND CAST(regexp_extract(r, '([0-9]+)', 1) AS INTEGER) < pos) AS back, count_if(clean) * 1.0 / count(*) AS ran FROM p GROUP BY 1),
s AS (SELECT l_orderkey, any_value(n) AS n, any_value(m) AS m, any_value(final) AS final, avg(CAST(name_ok AS INTEGER)) AS tools, bool_and(name_ok) AS all_tools,
  avg(CASE WHEN there THEN (plain_ok + ref_any + 0.5 * (ref_there - ref_any)) * 1.0 / (k + extra) ELSE 0 END) AS args, bool_and(there AND plain_ok + ref_any = k AND extra = 0) AS all_args,
  count_if(k = 3) AS gold_refs, sum(ref_any) AS used FROM t GROUP BY 1),
w AS (SELECT s.*, back * 1.0 / nullif(refs, 0) AS refs, coalesce(ran, 0) AS ran FROM s LEFT JOIN pr USING (l_orderkey))"""


def traces(t: Tables) -> DataFrame:
    """(l_orderkey, gold, pred, clean, final)."""
    supp, name = F.col("l_suppkey"), F.concat("l_returnflag", "l_linestatus")
    d, q, called = F.round(F.col("l_discount") * 100).cast("int"), F.col("l_quantity").cast("int"), F.when(supp % 7 == 0, "X").otherwise(name)
    line = F.struct(*LINE_ORDER, "l_quantity", "l_returnflag", "l_linestatus", "l_discount", "l_tax", d.alias("d"), q.alias("q"), name.alias("name"), called.alias("called"))
    lines = t.lineitem.select("l_orderkey", line.alias("line"))
    rows = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("calls"), (F.sum("line.q") % 3 != 0).alias("final"))
    refers = lambda x, i: (i > 0) & (x["l_partkey"] % 3 == 0)
    label = lambda i: F.concat(F.lit("$var_"), i.cast("string"), F.lit(".result$"))
    kept = lambda x: x["l_partkey"] % 11 != 0

    def given(**values: Column) -> Column:
        keys, vals = F.array(*map(F.lit, values)), F.array(*[v.cast("string") for v in values.values()])
        return F.filter(F.arrays_zip(keys.alias("k"), vals.alias("v")), lambda e: e["v"].isNotNull())

    def gold(x: Column, i: Column) -> Column:
        return given(d=x["d"], q=x["q"], r=F.when(refers(x, i), label(i)))

    def pred(x: Column, i: Column) -> Column:
        altered = F.when(refers(x, i), F.when(x["l_suppkey"] % 6 == 0, F.lit("1")).otherwise(label(i)))
        wrong_q = F.when(x["l_suppkey"] % 5 == 0, x["q"] + 1).otherwise(x["q"])
        return F.when(kept(x), given(d=F.when(x["l_partkey"] % 13 != 0, x["d"]), q=wrong_q, r=altered, x=F.when(x["l_partkey"] % 17 == 0, F.lit("0"))))

    named = lambda field, args: F.arrays_zip(F.col(f"calls.{field}").alias("name"), F.transform("calls", args).alias("args"))
    preds = F.filter(named("called", pred), lambda c: c["args"].isNotNull())
    return rows.select("l_orderkey", named("name", gold).alias("gold"), preds.alias("pred"), F.transform(F.filter("calls", kept), lambda x: x["l_tax"] < 0.08).alias("clean"), "final")


def _checked(t: Tables, *fields: str) -> DataFrame:
    return traces(t).withColumn("checks", tr.turns(F.col("gold"), F.col("pred"), *fields))


def _rounded(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n.rsplit(".")[-1]) for n in names]


@query(f"""WITH {_TURNS}, k AS (SELECT *, name_ok AND keys_ok AND clean AS passed FROM t), s AS (SELECT l_orderkey, any_value(n) AS n, any_value(m) AS m, any_value(final) AS final, min(pos) FILTER (WHERE NOT passed) AS bad FROM k GROUP BY 1)
SELECT l_orderkey, CASE WHEN bad IS NULL AND n = m AND final THEN 1.0 ELSE 0.0 END AS reward, coalesce(bad - 1, n) AS prefix, bad - 1 AS first_error FROM s""")
def strict_gold_trace(t: Tables) -> DataFrame:
    """All turns by name, keys and execution, then the answer; or nothing."""
    return _checked(t, "name", "keys").select("l_orderkey", tr.strict_reward(F.col("checks"), F.size("pred"), F.col("clean"), F.col("final")).alias("s")).select("l_orderkey", "s.reward", "s.prefix", "s.first_error")


@query(f"""WITH {_TURNS} SELECT l_orderkey, round(0.7 * sum(CASE WHEN name_ok THEN 0.4 + 0.3 * CAST(keys_ok AS INTEGER) + 0.3 * CAST(clean AS INTEGER) ELSE 0 END) / any_value(n)
  + 0.3 * CAST(any_value(final) AS INTEGER), 6) AS reward FROM t GROUP BY 1""")
def partial_gold_trace(t: Tables) -> DataFrame:
    """Turn credit and answer credit, with their weights."""
    return _checked(t, "name", "keys").select("l_orderkey", F.round(tr.partial_reward(F.col("checks"), F.size("pred"), F.col("clean"), F.col("final")), 6).alias("reward"))


@query(f"""WITH {_TURNS}, c AS (SELECT l_orderkey, name, count(*) AS a FROM g GROUP BY 1, 2), e AS (SELECT l_orderkey, name, count(*) AS b FROM p GROUP BY 1, 2),
f AS (SELECT l_orderkey, sum(least(a, coalesce(b, 0))) AS common FROM c LEFT JOIN e USING (l_orderkey, name) GROUP BY 1),
s AS (SELECT l_orderkey, any_value(n) AS n, any_value(m) AS m, count_if(there AND name_ok AND plain_ok + ref_any = k) AS exact, avg(CASE WHEN there THEN (plain_ok + ref_any) * 1.0 / k END) AS ratio,
  count_if(there AND NOT name_ok) AS wrong FROM t GROUP BY 1)
SELECT l_orderkey, round(CASE WHEN m = 0 THEN 0.0 ELSE 2.0 * common / (n + m) END, 6) AS name_f1, round(exact * 1.0 / n, 6) AS call_accuracy, round(coalesce(ratio, 0), 6) AS arg_ratio, n = m AND exact = n AS full_match,
  CASE WHEN m = 0 THEN 'parse_failure' WHEN n <> m THEN 'length_mismatch' WHEN exact = n THEN 'none' WHEN wrong > 0 THEN 'name_mismatch' ELSE 'arg_mismatch' END AS error FROM s JOIN f USING (l_orderkey)""")
def structural_score(t: Tables) -> DataFrame:
    """Names as multisets, calls by place, and the first kind of error."""
    out = _checked(t, "there", "name", "loose").select("l_orderkey", tr.structural_score(F.col("checks"), F.col("gold"), F.col("pred")).alias("s"))
    return out.select("l_orderkey", *_rounded("s.name_f1", "s.call_accuracy", "s.arg_ratio"), "s.full_match", "s.error")


@query(f"""WITH {_TURNS}, {_STEPS},
v AS (SELECT *, 0.10 + 0.20 * tools + 0.15 * args + 0.15 * coalesce(refs, CASE WHEN gold_refs > 0 THEN 0 ELSE 1 END) + 0.10 * CASE WHEN gold_refs > 0 THEN used * 1.0 / gold_refs ELSE 1 END
  + 0.10 * ran + 0.10 * greatest(0, 1 - abs(m - n) * 1.0 / n) + 0.10 * CAST(final AS INTEGER) AS score FROM w),
c AS (SELECT *, CASE WHEN m = 0 THEN 0.0 WHEN refs < 1 THEN 0.10 WHEN m < n THEN 0.30 WHEN NOT all_tools THEN 0.35 WHEN NOT all_args THEN 0.60 WHEN m > n THEN 0.70 WHEN ran >= 1 AND NOT final THEN 0.75 END AS cap FROM v)
SELECT l_orderkey, round(CASE WHEN cap IS NOT NULL THEN least(score, cap) WHEN ran >= 1 AND final THEN greatest(score, 0.90) ELSE score END, 6) AS reward FROM c""")
def stepwise_reward(t: Tables) -> DataFrame:
    """Eight weighted components under a ladder of caps of which the first applies."""
    true = F.lit(True)
    reward = tr.stepwise_reward(*[F.col(c) for c in ("checks", "gold", "pred", "clean", "final")], true, true, true)
    return _checked(t, "name", "graded").select("l_orderkey", F.round(reward, 6).alias("reward"))


@query(f"""WITH {_TURNS}, {_STEPS}, q AS (SELECT *, 0.10 + 0.20 * least(1, m * 1.0 / n) + 0.20 * tools + 0.20 * args
  + 0.10 * CASE WHEN gold_refs > 0 THEN 0.5 * coalesce(refs, 0) + 0.5 * used / gold_refs ELSE coalesce(refs, 1) END + 0.10 * ran + 0.10 * CAST(final AS INTEGER) AS quality,
  CASE WHEN m = 0 THEN 'no_tool_call' WHEN refs < 1 THEN 'invalid_reference' WHEN all_tools AND all_args AND ran >= 1 AND m = n AND final THEN 'fully_correct' WHEN m < n THEN 'too_few_calls'
  WHEN NOT all_tools THEN 'wrong_tool' WHEN NOT all_args THEN 'correct_tool_wrong_args' WHEN m > n THEN 'too_many_calls' WHEN ran >= 1 AND NOT final THEN 'executable_wrong_final' ELSE 'partial_progress' END AS kind FROM w),
b(kind, low, high) AS (VALUES {", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in tr.BANDS.items())})
SELECT l_orderkey, kind, round(quality, 6) AS quality, round(low + (high - low) * quality, 6) AS reward FROM q JOIN b USING (kind)""")
def banded_reward(t: Tables) -> DataFrame:
    """A band by the first kind of failure, and the place in it by dense components."""
    true = F.lit(True)
    reward = tr.banded_reward(*[F.col(c) for c in ("checks", "gold", "pred", "clean", "final")], true, true, true, ~true)
    return _checked(t, "name", "graded").select("l_orderkey", reward.alias("s")).select("l_orderkey", "s.kind", F.round("s.quality", 6).alias("quality"), "s.reward")


@query(f"""WITH {_TURNS}, x AS (SELECT p.l_orderkey, p.pos, CAST(regexp_extract(p.r, '([0-9]+)', 1) AS INTEGER) >= p.pos AS late, p.r LIKE '$%' AS is_ref, p.r = g.r AS same FROM p JOIN g USING (l_orderkey, pos)),
s AS (SELECT t.l_orderkey, any_value(n) AS n, any_value(m) AS m, any_value(final) AS final, avg(CAST(name_ok AS INTEGER)) AS name, avg(CASE WHEN there THEN (plain_there + ref_there) * 1.0 / k ELSE 0 END) AS keys,
  avg(CASE WHEN there THEN (plain_ok + ref_equal) * 1.0 / k ELSE 0 END) AS vals, avg(CASE WHEN NOT there THEN 0 WHEN NOT coalesce(is_ref, false) THEN 1 WHEN late THEN 0 WHEN same THEN 1 ELSE 0 END) AS refs
  FROM t LEFT JOIN x USING (l_orderkey, pos) GROUP BY 1),
c AS (SELECT *, CASE WHEN m = 0 THEN 0 WHEN m <> n THEN 0.5 ELSE 1 END AS format, CASE WHEN m = n THEN 1 ELSE m * 1.0 / n END AS cnt, CASE WHEN m = n THEN 1 ELSE 0 END AS labels FROM s)
SELECT l_orderkey, round(format, 6) AS format, round(cnt, 6) AS count, round(name, 6) AS name, round(keys, 6) AS keys, round(vals, 6) AS values, round(refs, 6) AS references,
  round(0.15 * format + 0.10 * cnt + 0.15 * name + 0.10 * labels + 0.10 * keys + 0.15 * vals + 0.15 * refs + 0.10 * CAST(final AS INTEGER), 6) AS total FROM c""")
def curriculum_reward(t: Tables) -> DataFrame:
    """Eight components and their sum."""
    labels = F.transform("pred", lambda c, i: F.concat(F.lit("$var_"), (i + 1).cast("string")))
    parts = tr.curriculum_components(F.col("checks"), F.col("gold"), F.col("pred"), labels, F.lit(True), F.col("final"))
    return _checked(t, "there", "name", "values", "shared", "n").select("l_orderkey", parts.alias("s")).select("l_orderkey", *_rounded(*[f"s.{c}" for c in ("format", "count", "name", "keys", "values", "references", "total")]))


@query(f"""WITH {_LINES}, s AS (SELECT l_orderkey, avg(CAST(name <> 'X' AS INTEGER)) AS known, avg(CAST(name <> 'X' AND x IS NULL AS INTEGER)) AS keys,
  coalesce(count_if(r LIKE '$%' AND CAST(regexp_extract(r, '([0-9]+)', 1) AS INTEGER) < pos) * 1.0 / nullif(count_if(r LIKE '$%'), 0), 1) AS refs, avg(CAST(clean AS INTEGER)) AS ran FROM p GROUP BY 1)
SELECT o.l_orderkey, round(0.10 + 0.15 * (coalesce(known, 0) + coalesce(keys, 0) + coalesce(keys, 0) + coalesce(refs, 1) + 2 * coalesce(ran, 0)), 6) AS score FROM o LEFT JOIN s USING (l_orderkey)""")
def process_score(t: Tables) -> DataFrame:
    """What can be verified without a gold trace."""
    known = F.array(*[F.lit(a + b) for a in "ANR" for b in "FO"])
    allowed, required = F.array(*map(F.lit, "dqr")), F.array(F.lit("q"))
    return traces(t).select("l_orderkey", F.round(tr.process_score(F.col("pred"), known, allowed, required, F.col("clean"), F.lit(True)), 6).alias("score"))


_TEXT = "name || '(' || array_to_string(list_filter([CASE WHEN d IS NOT NULL THEN 'd = ' || d END, 'q = ' || q, CASE WHEN r IS NOT NULL THEN 'r = ' || r END], lambda s: s IS NOT NULL), ', ') || ')'"


@query(f"""WITH {_LINES}, a AS (SELECT l_orderkey, list({_TEXT} ORDER BY {_TEXT}) AS s FROM g GROUP BY 1),
b AS (SELECT l_orderkey, list({_TEXT.replace("], lambda", ", CASE WHEN x IS NOT NULL THEN 'x = ' || x END], lambda")} ORDER BY {_TEXT.replace("], lambda", ", CASE WHEN x IS NOT NULL THEN 'x = ' || x END], lambda")}) AS s FROM p GROUP BY 1)
SELECT l_orderkey, coalesce(a.s = b.s, false) AS matches FROM a LEFT JOIN b USING (l_orderkey)""")
def ast_match(t: Tables) -> DataFrame:
    """Gold and predicted calls as the same multiset."""
    return traces(t).select("l_orderkey", tr.ast_match(F.col("gold"), F.col("pred")).alias("matches"))


@query(f"""WITH {_LINES} SELECT o.l_orderkey, CASE WHEN o.l_orderkey % 4 = 0 THEN m = 0 ELSE coalesce(p.name = g.name AND p.q = g.q AND (p.d IS NULL OR p.d = g.d)
  AND (g.r IS NULL OR coalesce(p.r = g.r, false)), false) END AS correct FROM o JOIN g ON g.l_orderkey = o.l_orderkey AND g.pos = 1 LEFT JOIN p ON p.l_orderkey = o.l_orderkey AND p.pos = 1""")
def category_check(t: Tables) -> DataFrame:
    """First calls by kind of question; d may be left out, and a fourth of the questions wants no call."""
    kind = F.when(F.col("l_orderkey") % 4 == 0, "irrelevance").otherwise("simple")
    return traces(t).select("l_orderkey", tr.category_check(F.col("gold"), F.col("pred"), kind, F.array(F.lit("d"))).alias("correct"))


@query(f"""WITH {_LINES}, s AS (SELECT l_orderkey, list({_TEXT} ORDER BY pos) AS s FROM g GROUP BY 1), q AS (SELECT l_orderkey, list({_TEXT} ORDER BY pos) AS s FROM (SELECT * FROM p WHERE x IS NULL) GROUP BY 1)
SELECT l_orderkey, array_to_string(s.s, '; ') AS steps, round(len(list_filter(range(1, greatest(len(s.s), len(coalesce(q.s, []))) + 1), lambda i: s.s[i] = q.s[i])) * 1.0 / greatest(len(s.s), len(coalesce(q.s, []))), 6) AS accuracy
FROM s LEFT JOIN q USING (l_orderkey)""")
def canonical_steps(t: Tables) -> DataFrame:
    """Calls as text, and the share of equal places over the longer list; predictions with an unexpected argument are left out."""
    plain = F.filter("pred", lambda c: ~F.array_contains(tr.keys_of(c), "x"))
    rows = traces(t).select("l_orderkey", F.transform("gold", tr.step_text).alias("a"), F.transform(plain, tr.step_text).alias("b"))
    same = F.filter(F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x)
    return rows.select("l_orderkey", F.array_join("a", "; ").alias("steps"), F.round(F.size(same) / F.greatest(F.size("a"), F.size("b")), 6).alias("accuracy"))


@query(f"""WITH {_LINES} SELECT a.l_orderkey, a.pos, '$' || b.name || '.result$' AS producer FROM g a JOIN g b ON a.l_orderkey = b.l_orderkey AND b.pos = a.pos - 1 WHERE a.r IS NOT NULL""")
def grounded_references(t: Tables) -> DataFrame:
    """References by the name of the function that they take their value from."""
    calls = traces(t).select("l_orderkey", F.posexplode(tr.grounded(F.col("gold"))).alias("at", "call"))
    return calls.select("l_orderkey", (F.col("at") + 1).cast("long").alias("pos"), tr.value_of(F.col("call"), F.lit("r")).alias("producer")).where("producer is not null")


@query(f"""WITH {_LINES} SELECT l_orderkey, CAST(pos AS INTEGER) AS turn, coalesce(string_agg(name, '>') OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, {_TEXT} AS target FROM g""")
def turn_rows(t: Tables) -> DataFrame:
    """A training row per gold call, with what came before it."""
    rows = traces(t).select("l_orderkey", "gold", F.posexplode("gold").alias("at", "call"))
    before = F.array_join(F.transform(F.slice("gold", 1, F.col("at")), lambda c: c["name"]), ">")
    return rows.select("l_orderkey", (F.col("at") + 1).alias("turn"), before.alias("before"), tr.step_text(F.col("call")).alias("target"))


@query(f"""WITH {_LINES} SELECT l_orderkey, pos, regexp_replace(r, '^\\$var_([0-9]+)\\.result\\$$', '$call\\1.output$') AS rewritten FROM g WHERE r IS NOT NULL""")
def reference_rewrite(t: Tables) -> DataFrame:
    """References with another label and another field."""
    calls = traces(t).select("l_orderkey", F.posexplode("gold").alias("at", "call"))
    value = F.regexp_replace(tr.value_of(F.col("call"), F.lit("r")), r"^\$var_([0-9]+)\.result\$$", r"\$call$1.output\$")
    return calls.select("l_orderkey", (F.col("at") + 1).cast("long").alias("pos"), value.alias("rewritten")).where("rewritten is not null")


@query(f"""WITH {_LINES}, x AS (SELECT l_orderkey, pos, CAST(regexp_extract(r, '([0-9]+)', 1) AS INTEGER) AS ref FROM p WHERE r LIKE '$%')
SELECT o.l_orderkey, arg_min(CASE WHEN ref = x.pos THEN 'self' WHEN ref > x.pos THEN 'future' END, x.pos) FILTER (WHERE ref >= x.pos) AS reason FROM o LEFT JOIN x USING (l_orderkey) GROUP BY 1""")
def reference_validation(t: Tables) -> DataFrame:
    """Predicted references that do not point back, which a dropped call causes."""
    return traces(t).select("l_orderkey", tr.invalid_reference(F.col("pred")).alias("reason"))


@query(f"""WITH {_LINES}, r AS (SELECT l_orderkey, pos, r IS NOT NULL AS has, count_if(r IS NULL) OVER (PARTITION BY l_orderkey ORDER BY pos) AS run FROM g),
d AS (SELECT l_orderkey, max(c) AS depth FROM (SELECT l_orderkey, run, count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT l_orderkey, count(*) AS n, count_if(has) AS refs, min(pos) FILTER (WHERE pos > 1 AND NOT has) AS broken, count_if(pos > 1 AND NOT has) AS roots, arg_max(has, pos) AS last_has FROM r GROUP BY 1)
SELECT l_orderkey, CASE WHEN n < 2 THEN NULL WHEN refs = 0 THEN 'no_dependency' WHEN broken IS NOT NULL THEN 'broken_at_' || broken WHEN depth < n THEN 'too_shallow' END AS strict_chain,
  CASE WHEN n < 2 THEN NULL WHEN refs = 0 THEN 'no_dependency' WHEN roots > floor(n / 2) THEN 'too_many_roots' WHEN NOT last_has THEN 'last_independent' WHEN depth < greatest(3, n - 3) THEN 'too_shallow' END AS dag_chain,
  CASE WHEN n < 2 THEN NULL WHEN refs = 0 THEN 'no_dependency' WHEN depth < 2 THEN 'too_shallow' WHEN broken IS NOT NULL THEN 'independent_call' END AS relaxed_nested FROM s JOIN d USING (l_orderkey)""")
def required_dependency(t: Tables) -> DataFrame:
    """Traces that lack the dependencies of each kind of task."""
    depth = scoring.chain_depth(F.transform("gold", tr.references_of))
    rows = traces(t).select("l_orderkey", "gold", depth.alias("depth"))
    return rows.select("l_orderkey", *[tr.missing_dependency(F.col("gold"), F.col("depth"), m).alias(m) for m in ("strict_chain", "dag_chain", "relaxed_nested")])


@query()
def official_score(t: Tables) -> DataFrame:
    """F1 of names and slots, partial and full accuracy, and wins of the predicted traces; tests hold it against a loop."""
    score = official.official_score(traces(t), "gold", "pred", F.col("l_orderkey") % 3 == 0)
    return score.select("n", *[F.round(c, 9).alias(c) for c in score.columns if c != "n"])


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '1.result,2' WHEN 1 THEN (user_id % 9 + 1) || '' WHEN 2 THEN '' ELSE '3.x,3.y,12' END AS refs FROM events""")
def nested_references(t: Tables) -> DataFrame:
    """References at any depth of arguments, and strings that only look like some."""
    k = F.col("event_id") % 4
    shapes = [
        F.lit('{"a": {"b": ["$var_1.result$", 5]}, "c": [["$var2$"]]}'), F.concat(F.lit('{"x": ["text $var1$", {"$var7$": " $var_'), F.col("user_id") % 9 + 1, F.lit('$ "}]}')),
        F.lit('{"a": "say \\"$var1$\\" to", "b": "$var1", "c": "$varx$"}'), F.lit('[{"k": "$var3.x$"}, {"k": {"k": ["$var3.y$", "$var_12$"]}}]'),
    ]
    refs = official.references_in(F.get(F.array(*shapes), k.cast("int")))
    return t.events.select("event_id", F.array_join(F.transform(refs, lambda r: F.concat_ws(".", r["call"].cast("string"), r["field"])), ",").alias("refs"))
