"""Windows over ordered rows: top-k, returns, advantages, gains, plateaus, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import scoring, text
from tracelake.operators import windows as win
from tracelake.plans.registry import Tables, query
from tracelake.plans.rollups import LINE_ORDER, LINE_ORDER_SQL


@query("""SELECT p_partkey, fp FROM (SELECT p_partkey, sha1(p_brand || '|' || CAST(p_size AS VARCHAR)) AS fp, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 2""")
def topk_per_fingerprint(t: Tables) -> DataFrame:
    """The two best of each fingerprint."""
    rows = t.part.select("p_partkey", "p_retailprice", text.fingerprint(F.col("p_brand"), F.col("p_size")).alias("fp"))
    return win.top_k(rows, ["fp"], [F.desc("p_retailprice"), F.col("p_partkey")], 2).select("p_partkey", "fp")


def _rollouts(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_id", "value", (F.col("event_type") != "error").alias("passed"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS r FROM events) WHERE r = 1")
def best_rollout(t: Tables) -> DataFrame:
    """Each task's rollout with the highest score."""
    return win.one_per_key(_rollouts(t), "user_id", "best_score", "value", "passed", "event_id").select("user_id", "event_id", "value")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'error' DESC, value DESC NULLS LAST, event_id) AS r FROM events) WHERE r = 1")
def pass_first(t: Tables) -> DataFrame:
    """A passing rollout if there is one."""
    return win.one_per_key(_rollouts(t), "user_id", "pass_first", "value", "passed", "event_id").select("user_id", "event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def first_rollout(t: Tables) -> DataFrame:
    """The rollout with index 0."""
    return win.one_per_key(_rollouts(t), "user_id", "rollout_idx_0", "value", "passed", "event_id").select("user_id", "event_id")


_TURNS = f"turns AS (SELECT l_orderkey, l_quantity AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}, l_quantity) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"


@query(f"""WITH {_TURNS} SELECT a.l_orderkey, a.k AS turn, sum(b.r * power(0.5, b.k - a.k)) + 0.5 * power(0.5, a.n - a.k + 1) * a.n AS g
FROM turns a JOIN turns b ON a.l_orderkey = b.l_orderkey AND b.k >= a.k GROUP BY a.l_orderkey, a.k, a.n""")
def discounted_returns(t: Tables) -> DataFrame:
    """Suffix sums of turn rewards, halved at each step so that they are exact, with a weighted final one."""
    turns = F.array_sort(F.collect_list(F.struct(*LINE_ORDER, "l_quantity")))
    rewards = F.transform(F.col("turns"), lambda x: x["l_quantity"])
    whole = t.lineitem.groupBy("l_orderkey").agg(turns.alias("turns"))
    g = scoring.suffix_returns(rewards, 0.5, F.size("turns").cast("double"), 0.5)
    flat = whole.select("l_orderkey", F.posexplode(g).alias("pos", "g"))
    return flat.select("l_orderkey", (F.col("pos") + 1).cast("long").alias("turn"), "g")


_ADV = f"""{_TURNS}, j AS (SELECT o_custkey, turns.* FROM turns JOIN orders ON o_orderkey = l_orderkey),
m AS (SELECT *, avg(r) OVER w AS mu, stddev_pop(r) OVER w AS sd, count(*) OVER w AS c FROM j WINDOW w AS (PARTITION BY o_custkey, k))"""


def _positions(t: Tables) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER, "l_quantity"))
    turns = t.lineitem.select("l_orderkey", F.col("l_quantity").alias("r"), turn.cast("long").alias("turn"))
    return win.position_advantage(turns.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey"), ["o_custkey", "turn"], "r")


@query(f"WITH {_ADV} SELECT l_orderkey, k AS turn, round(CASE WHEN c >= 2 AND sd > 1e-9 THEN (r - mu) / (sd + 1e-8) ELSE 0 END, 5) + 0.0 AS advantage FROM m")
def position_advantage(t: Tables) -> DataFrame:
    """Standardized within task and turn position."""
    return _positions(t).select("l_orderkey", "turn", (F.round("advantage", 5) + 0.0).alias("advantage"))


@query(f"WITH {_ADV} SELECT o_custkey, count(DISTINCT k) AS positions, coalesce(max(CASE WHEN c >= 2 THEN sd END), 0) <= 1e-9 AS dead FROM m GROUP BY 1")
def dead_groups(t: Tables) -> DataFrame:
    """Groups no position of which has spread."""
    by = _positions(t).groupBy("o_custkey", "turn").agg(F.max("std").alias("s"), F.count("*").alias("c"))
    return by.groupBy("o_custkey").agg(F.count("*").alias("positions"), (F.coalesce(F.max(F.when(F.col("c") >= 2, F.col("s"))), F.lit(0.0)) <= 1e-9).alias("dead"))


_MONTHLY = "SELECT o_orderpriority, year(o_orderdate) * 12 + month(o_orderdate) AS epoch, count(*) AS v FROM orders GROUP BY 1, 2"


def _monthly(t: Tables) -> DataFrame:
    epoch = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    return t.orders.groupBy("o_orderpriority", epoch.alias("epoch")).agg(F.count("*").alias("v"))


@query(f"SELECT o_orderpriority, epoch, v, coalesce(v <= max(v) OVER (PARTITION BY o_orderpriority ORDER BY epoch ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS plateau FROM ({_MONTHLY})")
def plateau_gate(t: Tables) -> DataFrame:
    """No better than the best of three epochs before."""
    return win.plateau(_monthly(t), ["o_orderpriority"], "epoch", "v", 3).drop("best_before")


@query(f"SELECT o_orderpriority, epoch, v - lag(v) OVER (PARTITION BY o_orderpriority ORDER BY epoch) AS gain FROM ({_MONTHLY})")
def checkpoint_gains(t: Tables) -> DataFrame:
    """Difference to the checkpoint before."""
    return win.gains(_monthly(t), ["o_orderpriority"], "epoch", "v").drop("v")


@query(f"SELECT o_orderpriority, epoch, v >= coalesce(max(v) OVER (PARTITION BY o_orderpriority ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS eligible FROM ({_MONTHLY})")
def best_so_far_guard(t: Tables) -> DataFrame:
    """Whether a checkpoint is no worse than all before."""
    before = Window.partitionBy("o_orderpriority").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return _monthly(t).select("o_orderpriority", "epoch", (F.col("v") >= F.coalesce(F.max("v").over(before), F.lit(0))).alias("eligible"))


@query("""SELECT n_name, row_number() OVER (ORDER BY hi DESC NULLS LAST, n DESC, n_name) AS place FROM (SELECT n_name, max(s_acctbal) AS hi, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)""")
def rank_lexicographic(t: Tables) -> DataFrame:
    """Several keys in order, null worst; ranks a row per nation."""
    by = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.max("s_acctbal").alias("hi"), F.count("s_suppkey").alias("n"))
    return by.select("n_name", F.row_number().over(Window.orderBy(F.col("hi").desc_nulls_last(), F.desc("n"), "n_name")).cast("long").alias("place"))


@query("""WITH b AS (SELECT event_type, CAST(floor((row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) / 100) AS BIGINT) AS bucket, value FROM events)
SELECT event_type, bucket, count(*) AS n, count_if(value > 50) AS high FROM b GROUP BY 1, 2""", bigint="high")
def count_buckets(t: Tables) -> DataFrame:
    """Buckets of a hundred rows each, by order of arrival."""
    return win.count_buckets(t.events, ["event_type"], ["ts", "event_id"], 100).groupBy("event_type", "bucket").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"))


@query("""WITH a AS (SELECT l_orderkey, l_returnflag AS arm, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY v DESC) AS rk FROM a)
SELECT arm, rk AS place, count(*) AS n FROM r GROUP BY 1, 2""")
def arm_ranks(t: Tables) -> DataFrame:
    """How often each arm takes each place."""
    by = t.lineitem.groupBy("l_orderkey", F.col("l_returnflag").alias("arm")).agg(F.max("l_extendedprice").alias("v"))
    ranked = by.withColumn("place", F.rank().over(Window.partitionBy("l_orderkey").orderBy(F.desc("v"))).cast("long"))
    return ranked.groupBy("arm", "place").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, event_type || '>' || lead(event_type) OVER w || '>' || lead(event_type, 2) OVER w AS gram FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT gram, count(*) AS n FROM s WHERE gram IS NOT NULL GROUP BY 1""")
def tool_ngrams(t: Tables) -> DataFrame:
    """Trigrams of the sequence of types."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    following = [F.lead("event_type", k).over(own) for k in (1, 2)]
    grams = t.events.select(F.concat("event_type", F.lit(">"), following[0], F.lit(">"), following[1]).alias("gram"))
    return grams.where("gram is not null").groupBy("gram").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, min(turn) FILTER (WHERE role = 'assistant' AND length(text) < 200) AS first_short, count(*) AS turns FROM conversations GROUP BY 1""")
def first_error_turn(t: Tables) -> DataFrame:
    """The first turn of a kind, null without one."""
    bad = (F.col("role") == "assistant") & (F.length("text") < 200)
    return t.conversations.groupBy("conv_id").agg(F.min(F.when(bad, F.col("turn"))).alias("first_short"), F.count("*").alias("turns"))


@query("""SELECT count_if(value > 50) * 1.0 / count(*) AS rate, count(*) AS n FROM (SELECT value FROM events ORDER BY ts, event_id LIMIT 50)""")
def first_n_rate(t: Tables) -> DataFrame:
    """A rate over the first fifty rows."""
    first = t.events.orderBy("ts", "event_id").limit(50)
    return first.agg((F.count_if(F.col("value") > 50) / F.count("*")).alias("rate"), F.count("*").alias("n"))
