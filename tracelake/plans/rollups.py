"""Task rollups, overviews, modes and counts.  Stand-ins: an order is a task, its lines are rollouts in a
total order, a line that was not returned passed; an event is a rollout of its user's task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import scoring
from tracelake.operators import aggregates as agg
from tracelake.plans.registry import Tables, query

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
LINE_ORDER_SQL = "l_linenumber, l_partkey, l_suppkey, l_shipdate"


def rollouts(t: Tables) -> DataFrame:
    failure = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_discount") > 0.05, "WRONG_VALUE").when(F.col("l_tax") > 0.04, "FORMAT_ERROR").otherwise("REASONING_ERROR"))
    return t.lineitem.select(F.col("l_orderkey").alias("task_id"), (F.col("l_returnflag") != "R").alias("passed"), failure.alias("failure"), *LINE_ORDER)


ROLLOUTS = f"""rollouts AS (SELECT l_orderkey AS task_id, l_returnflag <> 'R' AS passed,
  CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_discount > 0.05 THEN 'WRONG_VALUE' WHEN l_tax > 0.04 THEN 'FORMAT_ERROR' ELSE 'REASONING_ERROR' END END AS failure,
  {LINE_ORDER_SQL} FROM lineitem)"""
BUCKET = """CASE WHEN n <= 0 THEN 'unknown' WHEN passes = 0 THEN 'hard_failed' WHEN passes = n THEN 'easy' WHEN passes * 1.0 / n >= 0.75 THEN 'mostly_ok'
  WHEN passes * 1.0 / n >= 0.375 THEN 'unstable' ELSE 'mostly_failed' END"""
ROLLUP = f"""WITH {ROLLOUTS}, tasks AS (SELECT task_id, count(*) AS n, count_if(passed) AS passes FROM rollouts GROUP BY 1),
fails AS (SELECT task_id, failure, count(*) AS c, min(row({LINE_ORDER_SQL})) AS first_at FROM rollouts WHERE failure IS NOT NULL GROUP BY 1, 2),
dominant AS (SELECT task_id, failure AS dominant_failure FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY c DESC, first_at) AS r FROM fails) WHERE r = 1)"""


def tasks(t: Tables) -> DataFrame:
    rows = rollouts(t)
    by_task = rows.groupBy("task_id").agg(F.count("*").alias("n"), F.count_if("passed").alias("passes"))
    dominant = agg.mode(rows, ["task_id"], "failure", LINE_ORDER, "dominant_failure")
    bucket = scoring.difficulty_bucket(F.col("passes"), F.col("n")).alias("bucket")
    return by_task.join(dominant, "task_id", "left").select("task_id", "n", "passes", (F.col("passes") / F.col("n")).alias("pass_rate"), bucket, "dominant_failure")


@query(f"{ROLLUP} SELECT task_id, n, passes, passes * 1.0 / n AS pass_rate, {BUCKET} AS bucket, dominant_failure FROM tasks LEFT JOIN dominant USING (task_id)", bigint="passes")
def task_rollup(t: Tables) -> DataFrame:
    """Attempts, passes, difficulty bucket and dominant failure of every task."""
    return tasks(t)


@query(f"""{ROLLUP} SELECT {BUCKET} AS bucket, count(*) AS tasks, count(*) * 1.0 / sum(count(*)) OVER () AS share, CAST(sum(n) AS BIGINT) AS rollouts
FROM tasks GROUP BY 1""")
def overview(t: Tables) -> DataFrame:
    """Tasks by bucket with their share of all."""
    counted = tasks(t).groupBy("bucket").agg(F.count("*").alias("tasks"), F.sum("n").alias("rollouts"))
    return agg.with_share(counted, "tasks")


@query("""WITH e AS (SELECT event_id, user_id, event_type <> 'error' AS passed, list_filter([event_type, CASE WHEN value > 50 THEN 'large' END, CASE WHEN event_id % 7 = 0 THEN 'seventh' END], lambda x: x IS NOT NULL) AS kinds FROM events),
x AS (SELECT user_id, passed, unnest(kinds) AS problem_type FROM e)
SELECT problem_type, count(DISTINCT user_id) AS tasks, count(*) AS rollouts, count_if(passed) * 1.0 / count(*) AS pass_rate FROM x GROUP BY 1""")
def problem_type_rollup(t: Tables) -> DataFrame:
    """Several labels a rollout: distinct tasks, rollouts and pass rate by label."""
    kinds = F.array_compact(F.array("event_type", F.when(F.col("value") > 50, F.lit("large")), F.when(F.col("event_id") % 7 == 0, F.lit("seventh"))))
    flat = t.events.select("user_id", (F.col("event_type") != "error").alias("passed"), F.explode(kinds).alias("problem_type"))
    return flat.groupBy("problem_type").agg(F.countDistinct("user_id").alias("tasks"), F.count("*").alias("rollouts"), (F.count_if("passed") / F.count("*")).alias("pass_rate"))


@query(f"""WITH {ROLLOUTS} SELECT failure, count(*) AS n, count(*) * 1.0 / sum(count(*)) OVER () AS share, count(DISTINCT task_id) AS affected_tasks
FROM rollouts WHERE failure IS NOT NULL GROUP BY 1""")
def failure_share(t: Tables) -> DataFrame:
    """Each failure's part of all failures and how many tasks it affects."""
    by = rollouts(t).where("failure is not null").groupBy("failure").agg(F.count("*").alias("n"), F.countDistinct("task_id").alias("affected_tasks"))
    return agg.with_share(by, "n")


@query("""WITH x AS (SELECT lang, unnest(list_filter([CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN contains(text, 'icense') THEN 'license' END, CASE WHEN source = 'src0' THEN 'hot' END], lambda x: x IS NOT NULL)) AS flag FROM documents)
SELECT lang, flag, count(*) AS n FROM x GROUP BY 1, 2""")
def heatmap(t: Tables) -> DataFrame:
    """Counts over two labels, one of them multi-valued."""
    flags = F.array_compact(F.array(F.when(F.col("n_chars") < 500, F.lit("short")), F.when(F.contains("text", F.lit("icense")), F.lit("license")), F.when(F.col("source") == "src0", F.lit("hot"))))
    return t.documents.select("lang", F.explode(flags).alias("flag")).groupBy("lang", "flag").agg(F.count("*").alias("n"))


@query(f"""WITH {ROLLOUTS}, k AS (SELECT task_id, bool_or(passed) AS any_pass, count_if(passed) * 1.0 / count(*) AS acc FROM rollouts GROUP BY 1)
SELECT count(*) AS tasks, avg(CASE WHEN any_pass THEN 1.0 ELSE 0.0 END) AS pass_at_k, round(avg(acc), 9) AS accuracy FROM k""")
def pass_at_k(t: Tables) -> DataFrame:
    """Share of tasks with any pass, and mean accuracy."""
    by = rollouts(t).groupBy("task_id").agg(F.bool_or("passed").alias("any_pass"), (F.count_if("passed") / F.count("*")).alias("acc"))
    return by.agg(F.count("*").alias("tasks"), F.avg(F.col("any_pass").cast("double")).alias("pass_at_k"), F.round(F.avg("acc"), 9).alias("accuracy"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rank FROM c) WHERE rank <= 2""")
def dominant_mode(t: Tables) -> DataFrame:
    """The two commonest values of each key, ties by first seen."""
    return agg.counts_by_first_seen(t.events, ["user_id"], "event_type", ["event_id"]).where("rank <= 2").withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT status, count(*) AS n, count_if(score > 50) AS high, avg(CASE WHEN score > 50 THEN 1.0 ELSE 0.0 END) AS high_rate FROM (SELECT event_type AS status, value AS score FROM events) GROUP BY 1""", bigint="high")
def status_summary(t: Tables) -> DataFrame:
    """Counts by status and the rate of high scores."""
    return t.events.groupBy(F.col("event_type").alias("status")).agg(
        F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.coalesce(F.avg((F.col("value") > 50).cast("double")), F.lit(0.0)).alias("high_rate")
    )


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), (o_orderpriority, o_orderstatus), ())""")
def bucket_grouping_sets(t: Tables) -> DataFrame:
    """Counts at several grains in one pass."""
    cols = [F.col("o_orderpriority"), F.col("o_orderstatus")]
    return t.orders.groupingSets([[cols[0]], [cols[1]], cols, []], *cols).agg(F.count("*").alias("n")).select("o_orderpriority", "o_orderstatus", "n")


@query("SELECT n_calls, count(*) AS tasks, count_if(passes = n_calls) AS all_pass FROM (SELECT l_orderkey, count(*) AS n_calls, count_if(l_returnflag <> 'R') AS passes FROM lineitem GROUP BY 1) GROUP BY ROLLUP (n_calls)", bigint="all_pass")
def rollup_report(t: Tables) -> DataFrame:
    """The same aggregate by number of calls and overall."""
    by = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n_calls"), F.count_if(F.col("l_returnflag") != "R").alias("passes"))
    return by.rollup("n_calls").agg(F.count("*").alias("tasks"), F.count_if(F.col("passes") == F.col("n_calls")).alias("all_pass"))


@query("""SELECT l_linestatus AS failure_type, count_if(l_returnflag = 'A') AS A, count_if(l_returnflag = 'N') AS N, count_if(l_returnflag = 'R') AS R, count_if(l_returnflag = 'N') - count_if(l_returnflag = 'A') AS N_minus_A
FROM lineitem GROUP BY 1""", bigint="A N R N_minus_A")
def taxonomy_pivot(t: Tables) -> DataFrame:
    """Failure types by arm, and the difference between two arms."""
    wide = t.lineitem.groupBy(F.col("l_linestatus").alias("failure_type")).pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)
    return wide.withColumn("N_minus_A", F.col("N") - F.col("A"))


@query("""WITH k AS (SELECT text, count(*) AS c FROM documents GROUP BY 1) SELECT CAST(sum(c) AS BIGINT) AS rows, count(*) AS distinct_keys, CAST(sum(CASE WHEN c > 1 THEN c - 1 ELSE 0 END) AS BIGINT) AS extra, max(c) AS largest FROM k""")
def duplicate_statistics(t: Tables) -> DataFrame:
    """How many documents repeat a text."""
    return agg.duplicate_stats(t.documents.select(F.sha2("text", 256).alias("key")), "key")


@query("""SELECT c.conv_id, c.turn AS prefix_len, string_agg(p.role, '>' ORDER BY p.turn) AS roles, max_by(p.text, p.turn) AS answer
FROM (SELECT DISTINCT conv_id, turn FROM conversations) c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn <= c.turn WHERE c.turn <= 6 GROUP BY 1, 2""")
def prefix_expansion(t: Tables) -> DataFrame:
    """A row for each beginning of a conversation, with the last turn as its answer."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    whole = t.conversations.groupBy("conv_id").agg(turns.alias("turns"))
    each = whole.select("conv_id", "turns", F.explode(F.array_distinct(F.col("turns.turn"))).alias("prefix_len")).where("prefix_len <= 6")
    until = F.filter("turns", lambda x: x["turn"] <= F.col("prefix_len"))
    return each.select("conv_id", "prefix_len", F.array_join(F.transform(until, lambda x: x["role"]), ">").alias("roles"), F.element_at(until, -1)["text"].alias("answer"))
