"""Gates, eligibility, group signals, cohorts, replay and weighted picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import assignment, calls, scoring
from tracelake.plans.grading import _sequences
from tracelake.plans.registry import Tables, query
from tracelake.plans.rollups import LINE_ORDER
from tracelake.storage import materialize


@query("""WITH g AS (SELECT o_orderpriority AS stage, count(*) AS n, count_if(o_orderstatus = 'F') * 1.0 / count(*) AS rate FROM orders GROUP BY 1)
SELECT stage, CASE WHEN n < 100 THEN 'skipped' WHEN rate >= 0.34 THEN 'pass' ELSE 'fail' END AS gate FROM g""")
def stage_gates(t: Tables) -> DataFrame:
    """Pass, fail, or skipped for want of rows."""
    g = t.orders.groupBy(F.col("o_orderpriority").alias("stage")).agg(F.count("*").alias("n"), (F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("rate"))
    return g.select("stage", F.when(F.col("n") < 100, "skipped").when(F.col("rate") >= 0.34, "pass").otherwise("fail").alias("gate"))


@query("""WITH a AS (SELECT event_type AS arm, count_if(value > 50) * 1.0 / count(*) AS rate FROM events GROUP BY 1), c AS (SELECT rate AS control FROM a WHERE arm = 'view')
SELECT arm, round(rate - control, 9) + 0.0 AS delta, CASE WHEN rate - control < -0.05 THEN 'FAIL' WHEN rate - control < -0.02 THEN 'CONDITIONAL' ELSE 'PASS' END AS verdict FROM a, c""")
def arm_gates(t: Tables) -> DataFrame:
    """Arms against the control: more than five points worse fails, more than two is conditional."""
    a = t.events.groupBy(F.col("event_type").alias("arm")).agg((F.count_if(F.col("value") > 50) / F.count("*")).alias("rate"))
    d = F.col("rate") - F.max(F.when(F.col("arm") == "view", F.col("rate"))).over(Window.partitionBy())
    return a.withColumn("d", d).select("arm", (F.round("d", 9) + 0.0).alias("delta"), F.when(F.col("d") < -0.05, "FAIL").when(F.col("d") < -0.02, "CONDITIONAL").otherwise("PASS").alias("verdict"))


@query("""WITH k AS (SELECT p_brand, count(*) AS n, avg(p_size) AS size, count(DISTINCT p_type) AS kinds FROM part GROUP BY 1)
SELECT p_brand, CASE WHEN n < 20 THEN 'too_few' WHEN size < 20 THEN 'small' WHEN kinds < 3 THEN 'monotone' END AS reason FROM k""")
def checkpoint_eligibility(t: Tables) -> DataFrame:
    """The first check that a checkpoint fails."""
    k = t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("p_size").alias("size"), F.countDistinct("p_type").alias("kinds"))
    return k.select("p_brand", scoring.first_reason((F.col("n") < 20, "too_few"), (F.col("size") < 20, "small"), (F.col("kinds") < 3, "monotone")).alias("reason"))


@query("""WITH g AS (SELECT l_orderkey, count(DISTINCT l_quantity) AS u, coalesce(var_pop(l_quantity), 0) AS v, (max(l_quantity) - min(l_quantity)) / 50.0 AS s, count_if(l_returnflag <> 'R') * 1.0 / count(*) AS p FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN u < 2 THEN 'too_few_unique' WHEN v <= 0 THEN 'no_variance' WHEN s < 0.05 THEN 'small_range' WHEN p >= 1 THEN 'all_correct' WHEN p BETWEEN 0.125 AND 0.75 THEN 'frontier' WHEN p > 0.75 THEN 'easy_anchor' ELSE 'partial_frontier' END AS signal FROM g""")
def group_signal(t: Tables) -> DataFrame:
    """What each task's rollouts can teach."""
    x = F.col("l_quantity")
    g = t.lineitem.groupBy("l_orderkey").agg(F.countDistinct(x).alias("u"), F.var_pop(x).alias("v"), ((F.max(x) - F.min(x)) / 50.0).alias("s"), (F.count_if(F.col("l_returnflag") != "R") / F.count("*")).alias("p"))
    return g.select("l_orderkey", calls.group_signal(F.col("u"), F.col("v"), F.col("s"), F.col("p")).alias("signal"))


@query("""WITH c AS (SELECT l_orderkey, count(*) AS n, count_if(l_partkey % 3 = 0) AS refs, count(DISTINCT l_suppkey % 4) AS depth, count_if(l_tax > 0.05) AS fans, bool_or(l_quantity > 45) AS co, bool_or(l_discount > 0.09) AS ca FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(round(least(1.0, 0.30 * least(n / 10.0, 1.0) + 0.25 * least(refs * 1.0 / n, 1.0) + 0.25 * least(depth / 10.0, 1.0) + least(0.05 * fans, 0.2) + 0.15 * CAST(co AS INTEGER) + 0.10 * CAST(ca AS INTEGER)), 4) + 1e-9, 3) AS difficulty FROM c""")
def motif_difficulty(t: Tables) -> DataFrame:
    """Weighted difficulty of a trace."""
    n = lambda c: F.count_if(c)
    c = t.lineitem.groupBy("l_orderkey").agg(
        F.count("*").alias("n"), n(F.col("l_partkey") % 3 == 0).alias("refs"), F.countDistinct(F.col("l_suppkey") % 4).alias("depth"), n(F.col("l_tax") > 0.05).alias("fans"),
        F.bool_or(F.col("l_quantity") > 45).alias("co"), F.bool_or(F.col("l_discount") > 0.09).alias("ca"),
    )
    return c.select("l_orderkey", F.round(calls.motif_difficulty(*[F.col(x) for x in ("n", "refs", "depth", "fans", "co", "ca")]) + 1e-9, 3).alias("difficulty"))


@query("""WITH r AS (SELECT l_orderkey, 0.4 * CAST(l_returnflag <> 'R' AS INTEGER) + CAST(l_returnflag <> 'R' AS INTEGER) * (0.3 * CAST(l_discount < 0.05 AS INTEGER) + 0.3 * CAST(l_tax < 0.04 AS INTEGER)) AS s, CAST(l_linestatus = 'O' AS INTEGER) AS f FROM lineitem)
SELECT l_orderkey, round(0.7 * avg(s) + 0.3 * max(f), 8) AS reward FROM r GROUP BY 1""")
def partial_trace(t: Tables) -> DataFrame:
    """Turn scores gated on the name, and the episode's final part."""
    turn = calls.partial_trace_reward(F.col("l_returnflag") != "R", F.col("l_discount") < 0.05, F.col("l_tax") < 0.04)
    return t.lineitem.groupBy("l_orderkey").agg(F.round(0.7 * F.avg(turn) + 0.3 * F.max((F.col("l_linestatus") == "O").cast("int")), 8).alias("reward"))


@query("""WITH p AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_mktsegment = 'BUILDING' THEN 'building' WHEN c_custkey % 3 = 0 THEN 'third' END AS cohort FROM customer)
SELECT cohort, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS r FROM p WHERE cohort IS NOT NULL) WHERE r <= 40""")
def cohort_assignment(t: Tables) -> DataFrame:
    """Overlapping pools, one cohort each by priority, filled to a target in hash order."""
    cohort = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_mktsegment") == "BUILDING", "building").when(F.col("c_custkey") % 3 == 0, "third")
    rows = t.customer.select("c_custkey", cohort.alias("cohort")).where("cohort is not null")
    rank = F.row_number().over(Window.partitionBy("cohort").orderBy(F.md5(F.col("c_custkey").cast("string")), "c_custkey"))
    return rows.withColumn("r", rank).where("r <= 40").select("cohort", "c_custkey")


@query("""WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY md5(CAST(s_suppkey AS VARCHAR)), s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier)
SELECT s_suppkey, count(*) AS times FROM (SELECT unnest(range(250)) AS k) JOIN s ON i = k % n GROUP BY 1""")
def mixed_replay(t: Tables) -> DataFrame:
    """More rows than there are: the hash order is gone through again and again."""
    order = [F.md5(F.col("s_suppkey").cast("string")), F.col("s_suppkey")]
    first = t.supplier.select("s_suppkey").orderBy(*order).limit(250)  # no further row is reached
    n = t.supplier.agg(F.count("*").alias("n"))
    rows = first.withColumn("i", F.row_number().over(Window.orderBy(*order)) - 1).join(F.broadcast(n), F.lit(True))
    need = F.floor((F.lit(250) - F.col("i") - 1) / F.col("n")) + 1
    return rows.withColumn("times", F.greatest(need, F.lit(0)).cast("long")).where("times > 0").select("s_suppkey", "times")


@query("""SELECT p_partkey FROM (SELECT p_partkey, p_brand, p_size, -ln((('0x' || substring(md5(CAST(p_partkey AS VARCHAR)), 1, 8))::UINTEGER + 1) / 4294967297.0) / p_size AS k FROM part) ORDER BY k, p_partkey LIMIT 100""")
def weighted_pick(t: Tables) -> DataFrame:
    """A hundred rows without replacement, likelier with weight: smallest -ln(u) / w, u from a hash."""
    u = (F.conv(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 8), 16, 10).cast("long") + 1) / 4294967297.0
    return t.part.select("p_partkey", (-F.log(u) / F.col("p_size")).alias("k")).orderBy("k", "p_partkey").limit(100).select("p_partkey")


@query("""SELECT user_id, CASE WHEN p = 0 THEN 'hard_fail' WHEN p = n THEN 'easy' WHEN p <= greatest(1, n // 4) THEN 'mostly_fail' WHEN p >= n - greatest(1, n // 4) THEN 'mostly_pass' ELSE 'unstable' END AS bucket
FROM (SELECT user_id, count(*) AS n, count_if(event_type <> 'error') AS p FROM events GROUP BY 1)""")
def difficulty_by_count(t: Tables) -> DataFrame:
    """The ladder by counts."""
    by = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("p"))
    return by.select("user_id", scoring.difficulty_bucket_by_count(F.col("p"), F.col("n")).alias("bucket"))


@query()
def aligned_accuracy(t: Tables) -> DataFrame:
    """Step lists of unlike lengths aligned by name."""
    shorter = F.filter("pred", lambda x, i: i % 4 != 3)
    return _sequences(t).select("l_orderkey", assignment.aligned_accuracy(F.col("gold"), shorter).alias("accuracy"))


@query()
def permutation_match(t: Tables) -> DataFrame:
    """Calls in any order."""
    whole = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(*LINE_ORDER, "l_quantity"))), lambda x: x["l_quantity"]).alias("q"))
    gold, pred = F.slice("q", 1, F.ceil(F.size("q") / 2).cast("int")), F.reverse("q")
    scores = F.transform(gold, lambda g: F.transform(pred, lambda p: (g == p).cast("double")))
    scored = materialize(whole.select("l_orderkey", scores.alias("scores")), "call_scores")
    return scored.select("l_orderkey", calls.permutation_match(F.col("scores")).alias("score"))
