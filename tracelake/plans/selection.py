"""Quotas with backfill, caps, signals of batches, menus, scores of turns and their errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import calls, scoring
from tracelake.operators import selection as sel
from tracelake.operators import windows as win
from tracelake.plans.registry import Tables, query
from tracelake.plans.rollups import LINE_ORDER


@query("""WITH p AS (SELECT p_partkey, p_type, CASE WHEN p_size <= 2 THEN 'easy' WHEN p_size <= 30 THEN 'medium' ELSE 'hard' END AS lv, md5(CAST(p_partkey AS VARCHAR)) AS h FROM part),
q(p_type, quota, easy, medium, hard) AS (VALUES ('ECONOMY', 40, 20, 12, 8), ('PROMO', 20, 10, 6, 4), ('none such', 30, 15, 9, 6)),
one AS (SELECT * FROM (SELECT p.*, quota, CASE lv WHEN 'easy' THEN easy WHEN 'medium' THEN medium ELSE hard END AS need, row_number() OVER (PARTITION BY p.p_type, lv ORDER BY h, p_partkey) AS r FROM p JOIN q USING (p_type)) WHERE r <= need),
short AS (SELECT q.p_type, q.quota - count(p_partkey) AS need FROM q LEFT JOIN one USING (p_type) GROUP BY q.p_type, q.quota),
two AS (SELECT p_partkey FROM (SELECT p.*, need, row_number() OVER (PARTITION BY p_type ORDER BY h, p_partkey) AS r FROM p JOIN short USING (p_type) WHERE p_partkey NOT IN (SELECT p_partkey FROM one)) WHERE r <= need),
x AS (SELECT p_partkey, 1 AS pass FROM one UNION ALL SELECT p_partkey, 2 FROM two),
three AS (SELECT p_partkey, row_number() OVER (ORDER BY h, p_partkey) AS r FROM p WHERE p_partkey NOT IN (SELECT p_partkey FROM x))
SELECT p_partkey, pass FROM x UNION ALL SELECT p_partkey, 3 FROM three WHERE r <= 90 - (SELECT count(*) FROM x)""")
def quota_backfill(t: Tables) -> DataFrame:
    """Ninety rows by domain, then difficulty; what one lacks is filled from the domain, then from all."""
    level = F.when(F.col("p_size") <= 2, "easy").when(F.col("p_size") <= 30, "medium").otherwise("hard")
    rows = t.part.select("p_partkey", "p_type", level.alias("lv"), F.md5(F.col("p_partkey").cast("string")).alias("h"))
    quotas = {"ECONOMY": 40, "PROMO": 20, "none such": 30}
    chosen = sel.quota_with_backfill(rows, quotas, "p_type", "lv", {"easy": 0.5, "medium": 0.3, "hard": 0.2}, "p_partkey", [F.col("h"), F.col("p_partkey")])
    return chosen.select("p_partkey", "pass")


@query("""WITH k AS (SELECT p_partkey, p_brand, -ln((('0x' || substring(md5(CAST(p_partkey AS VARCHAR)), 1, 8))::UINTEGER + 1) / 4294967297.0) * (1 + p_size) AS k FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY k, p_partkey) AS r FROM k) SELECT p_partkey, p_brand FROM r WHERE r <= 4 ORDER BY k, p_partkey LIMIT 80""")
def share_capped(t: Tables) -> DataFrame:
    """Eighty rows by inverse frequency, no brand over a twentieth."""
    rows = t.part.select("p_partkey", "p_brand", "p_size")
    return sel.share_capped_pick(rows, "p_brand", 1.0 / (1 + F.col("p_size")), F.col("p_partkey"), 80, 0.05).select("p_partkey", "p_brand")


@query("""WITH a AS (SELECT event_id, user_id % 7 AS tier, row_number() OVER (PARTITION BY user_id % 7, event_type ORDER BY ts, event_id) AS r, ts FROM events),
b AS (SELECT event_id, tier, row_number() OVER (PARTITION BY tier ORDER BY ts, event_id) AS r FROM a WHERE r <= 15) SELECT event_id, tier FROM b WHERE r <= 50""")
def tier_failure_caps(t: Tables) -> DataFrame:
    """Fifty of each tier as they come, no more than fifteen of a failure type."""
    rows = t.events.select("event_id", "ts", "event_type", (F.col("user_id") % 7).alias("tier"))
    return sel.nested_caps(rows, "tier", "event_type", 15, 50, [F.col("ts"), F.col("event_id")]).select("event_id", "tier")


@query()
def several_caps(t: Tables) -> DataFrame:
    """Events as they come under three caps at once; tests hold it against the walk."""
    trace = F.concat_ws(":", "user_id", "event_type")
    rows = t.events.select("event_id", trace.alias("trace"), (F.col("event_id") % 31).alias("template"), F.col("event_type").alias("tools"))
    return sel.capped_walk(rows, "event_id", {"trace": 2, "template": 8, "tools": 60}).select("event_id")


@query("""WITH b AS (SELECT user_id % 5 AS run, strftime(ts, '%Y-%m-%d') AS batch, count(*) AS n, count_if(event_type = 'purchase') AS accepted FROM events GROUP BY 1, 2),
r AS (SELECT *, sum(accepted) OVER w * 1.0 / sum(n) OVER w AS rate, count(*) OVER w AS k FROM b WINDOW w AS (PARTITION BY run ORDER BY batch))
SELECT run, batch, n, accepted, rate, NOT coalesce(bool_or(k >= 3 AND rate < 0.2) OVER (PARTITION BY run ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ran FROM r""")
def accept_rate(t: Tables) -> DataFrame:
    """Daily batches of a run up to where too few are accepted."""
    batches = t.events.groupBy((F.col("user_id") % 5).alias("run"), F.date_format("ts", "yyyy-MM-dd").alias("batch")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("accepted"))
    return sel.accept_rate_stop(batches, "run", "batch", "n", "accepted", 3, 0.2)


@query("""WITH c AS (SELECT user_id % 5 AS run, strftime(ts, '%Y-%m-%d') AS batch, event_type AS reason, count(*) AS n FROM events WHERE event_type <> 'purchase' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY run, batch ORDER BY n DESC, reason) AS r FROM c),
x AS (SELECT run, batch, reason, r, dense_rank() OVER (PARTITION BY run ORDER BY batch) AS b FROM r WHERE r <= 3),
l AS (SELECT a.run, a.batch, x.reason, row_number() OVER (PARTITION BY a.run, a.batch ORDER BY x.b DESC, x.r) AS k FROM (SELECT DISTINCT run, batch, b FROM x) a JOIN x ON a.run = x.run AND x.b <= a.b AND x.b > a.b - 8)
SELECT run, batch, string_agg(reason, ',' ORDER BY k) AS learnings, string_agg(reason, ',' ORDER BY k) FILTER (WHERE k <= (SELECT count(*) FROM x y WHERE y.run = l.run AND y.batch = l.batch)) AS top FROM l WHERE k <= 8 GROUP BY run, batch""")
def rejection_feedback(t: Tables) -> DataFrame:
    """What a batch was refused for, and what the next one is told."""
    rows = t.events.select((F.col("user_id") % 5).alias("run"), F.date_format("ts", "yyyy-MM-dd").alias("batch"), F.when(F.col("event_type") != "purchase", F.col("event_type")).alias("reason"))
    out = sel.rejection_feedback(rows, "run", "batch", "reason")
    return out.select("run", "batch", F.array_join("learnings", ",").alias("learnings"), F.array_join("top", ",").alias("top"))


@query("""SELECT event_id, step FROM (SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS step, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id) AS r FROM events) WHERE r <= 2""")
def step_samples(t: Tables) -> DataFrame:
    """Two samples a step for the log."""
    return win.top_k(t.events.select("event_id", F.date_trunc("hour", "ts").alias("step")), ["step"], [F.col("event_id")], 2)


@query("""WITH c AS (SELECT DISTINCT p_brand AS c FROM part), u AS (SELECT DISTINCT l_orderkey AS k, p_brand AS c FROM lineitem JOIN part ON p_partkey = l_partkey),
a AS (SELECT k, c, c IN (SELECT c FROM u WHERE u.k = o.k) AS used FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) o, c),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY NOT used, CASE WHEN used THEN c ELSE md5(k || ':' || c) END, c) AS r, count_if(used) OVER (PARTITION BY k) AS n FROM a)
SELECT k AS l_orderkey, string_agg(c, ',' ORDER BY r) AS menu FROM r WHERE r <= least(5, greatest(n, 4)) GROUP BY k""")
def menu_trim(t: Tables) -> DataFrame:
    """The brands of an order and others up to four, five at most."""
    used = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(t.part.select("p_partkey", "p_brand"), "p_partkey")
    # The catalogue is the list of brands, a few dozen at every size.
    catalog = t.part.agg(F.array_sort(F.collect_set("p_brand")).alias("catalog"))
    menus = used.groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("own")).join(F.broadcast(catalog), F.lit(True))
    return menus.select("l_orderkey", F.array_join(sel.trimmed_menu(F.col("own"), F.col("catalog"), F.col("l_orderkey"), 4, 5), ",").alias("menu"))


@query()
def turn_scorer(t: Tables) -> DataFrame:
    """The second half of an order's lines as predictions of the first; tests hold it against the loop."""
    args = F.create_map(F.lit("status"), F.concat(F.lit(" '"), "l_linestatus", F.lit("'")), F.lit("session"), F.col("l_suppkey").cast("string"))
    call = F.struct(F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag")).alias("name"), args.alias("args"))
    at = F.struct(*LINE_ORDER, F.col("l_quantity"))
    numbered = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), F.struct(call["name"].alias("name"), F.map_entries(call["args"]).alias("args")).alias("call")))).alias("c"))
    every = F.transform("c", lambda x: F.struct(x["call"]["name"].alias("name"), F.map_from_entries(x["call"]["args"]).alias("args")))
    half = F.ceil(F.size("c") / 2).cast("int")
    rows = numbered.select("l_orderkey", F.slice(every, 1, half).alias("gold"), F.slice(every, half + 1, F.size("c")).alias("pred"))
    return rows.select("l_orderkey", calls.turn_score(F.col("pred"), F.col("gold"), ("session",)).alias("s")).select("l_orderkey", "s.*")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"a":[1,' || json_extract_string(props, '$.k') || ',2.5],"b":{"c":[3,-4]}}' WHEN 1 THEN '{"a":"$var_1$","b":[{"k":' || json_extract_string(props, '$.k') || '}]}'
  WHEN 2 THEN '{"a":"' || event_type || ', ' || json_extract_string(props, '$.k') || '","b":null}' END AS args FROM events""")
def plain_arguments(t: Tables) -> DataFrame:
    """Arguments with JSON and lists of numbers inside strings."""
    k = F.get_json_object("props", "$.k")
    shapes = [
        F.concat(F.lit('{"b": {"c": " 3 -4"}, "a": "1, '), k, F.lit(' ,2.5"}')), F.concat(F.lit('{"a": "$var_1$", "b": "[{\\"k\\": '), k, F.lit('}]"}')),
        F.concat(F.lit('{"a": "'), "event_type", F.lit(", "), k, F.lit('", "b": null}')), F.concat(F.lit("["), k, F.lit("]")),
    ]
    return t.events.select("event_id", calls.plain_arguments(F.get(F.array(*shapes), (F.col("event_id") % 4).cast("int"))).alias("args"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'invalid_json' WHEN event_id % 13 = 0 AND user_id % 2 > 0 THEN 'missing_output' WHEN event_id % 13 < 3 THEN 'wrong_call_count' WHEN user_id % 3 = 0 THEN 'wrong_tool'
  WHEN value IS NULL OR value < 50 THEN 'wrong_argument_values' WHEN user_id % 5 = 0 THEN 'wrong_final_answer' WHEN event_id % 2 = 0 THEN 'exact_match' ELSE 'partial_match' END AS error FROM events""")
def trajectory_errors(t: Tables) -> DataFrame:
    """The first thing wrong with each trajectory."""
    one, share = F.lit(1.0), lambda c: F.when(c, 1.0).otherwise(0.5)
    scores = {name: one for name in scoring.ERROR_LADDER} | {
        "call_count_score": share(F.col("event_id") % 13 >= 3), "tool_name_score": share(F.col("user_id") % 3 != 0),
        "argument_value_score": F.when(F.col("value") >= 50, 1.0), "final_answer_score": share(F.col("user_id") % 5 != 0),
    }
    error = scoring.trajectory_error(F.col("event_type") != "error", F.col("event_id") % 13, F.col("user_id") % 2 == 0, F.col("event_id") % 2 == 0, scores)
    return t.events.select("event_id", error.alias("error"))
