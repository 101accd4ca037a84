"""Comparison of runs, agreement, selection and similarity.  Stand-ins: an order's priority is its arm's
name, its month its epoch; events of a user are rollouts of a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators import aggregates as agg
from tracelake.operators import matching as m
from tracelake.operators import similarity as sim
from tracelake.plans.registry import Tables, query

_MONTHLY = """monthly AS (SELECT o_orderpriority AS arm, year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, count_if(o_orderstatus = 'F') AS won FROM orders GROUP BY 1, 2, 3)"""


def _monthly(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("arm"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("won")
    )


@query(f"WITH {_MONTHLY} SELECT a.arm, a.m, a.n AS n_prev, b.n AS n_cur, b.won - a.won AS gained FROM monthly a JOIN monthly b ON a.arm = b.arm AND a.m = b.m AND b.y = a.y + 1 WHERE a.y = 1996")
def consecutive_pairs(t: Tables) -> DataFrame:
    """A checkpoint beside the next, by two keys."""
    both = _monthly(t)
    prev = both.where("y = 1996").select("arm", "m", F.col("n").alias("n_prev"), F.col("won").alias("won_prev"))
    cur = both.where("y = 1997").select("arm", "m", F.col("n").alias("n_cur"), F.col("won").alias("won_cur"))
    return prev.join(cur, ["arm", "m"]).select("arm", "m", "n_prev", "n_cur", (F.col("won_cur") - F.col("won_prev")).alias("gained"))


@query(f"""WITH {_MONTHLY}, o AS (SELECT o_orderpriority AS arm, year(o_orderdate) AS y, month(o_orderdate) AS m, round(avg(o_totalprice), 4) AS full_rate FROM orders GROUP BY 1, 2, 3)
SELECT arm, y, m, round(won * 1.0 / n, 6) AS local_rate, full_rate FROM monthly JOIN o USING (arm, y, m)""")
def transfer_gap(t: Tables) -> DataFrame:
    """Two measures of a checkpoint, by three keys."""
    full = t.orders.groupBy(F.col("o_orderpriority").alias("arm"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.round(F.avg("o_totalprice"), 4).alias("full_rate"))
    return _monthly(t).join(full, ["arm", "y", "m"]).select("arm", "y", "m", F.round(F.col("won") / F.col("n"), 6).alias("local_rate"), "full_rate")


@query("""WITH c AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'F') FILTER (WHERE o_orderpriority < '2') AS a, bool_or(o_orderstatus = 'F') FILTER (WHERE o_orderpriority >= '2' AND o_orderpriority < '4') AS b,
  bool_or(o_orderstatus = 'F') FILTER (WHERE o_orderpriority >= '4') AS c FROM orders GROUP BY 1)
SELECT a AS first, b AS second, c AS third, count(*) AS n FROM c WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2, 3""")
def three_way_transitions(t: Tables) -> DataFrame:
    """Outcomes of the tasks that three runs have in common."""
    won = lambda where, name: t.orders.where(where).groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias(name))
    arms = won("o_orderpriority < '2'", "first").join(won("o_orderpriority >= '2' and o_orderpriority < '4'", "second"), "o_custkey").join(won("o_orderpriority >= '4'", "third"), "o_custkey")
    return arms.groupBy("first", "second", "third").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT o_custkey AS k, max(o_orderkey) AS id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderkey) AS id FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT k, id FROM a UNION ALL SELECT k, id FROM b WHERE k NOT IN (SELECT k FROM a)""")
def fallback_union(t: Tables) -> DataFrame:
    """Results of one source, and of another where the first has none."""
    last = lambda s: t.orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("id"))
    return m.with_fallback(last("F"), last("O"), ["k"])


@query("""WITH c AS (SELECT c_custkey, c_nationkey AS nation, c_acctbal FROM customer), s AS (SELECT s_suppkey, s_nationkey AS nation, s_acctbal FROM supplier),
p AS (SELECT c_custkey, s_suppkey, -abs(c_acctbal - s_acctbal) AS score, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS nth FROM c JOIN s USING (nation))
SELECT c_custkey, s_suppkey, round(score, 6) AS score FROM p WHERE nth = 1""")
def nearest_neighbour(t: Tables) -> DataFrame:
    """For each row the nearest of another table in its block."""
    rows, pool = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal"), t.supplier.select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    return m.nearest_number(rows, pool, "nation", "c_acctbal", "s_acctbal", "c_custkey", "s_suppkey").withColumn("score", F.round("score", 6))


def structures(t: Tables) -> DataFrame:
    """An order's lines as a trace: suppliers are tools, return flags families, the priority its motif, discounts references."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount")
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    tool = F.transform("lines", lambda x: F.concat(F.lit("s"), x["l_suppkey"].cast("string")))
    traces = rows.select(
        F.col("l_orderkey").alias("o_orderkey"), F.size("lines").alias("calls"), F.array_distinct(tool).alias("tools"), F.array_join(tool, "->").alias("sequence"),
        F.when(F.size("lines") >= 3, F.array_join(F.slice(tool, 1, 3), "->")).otherwise("").alias("trigram"), F.array_distinct(F.transform("lines", lambda x: x["l_returnflag"])).alias("families"),
        (F.size(F.array_distinct(F.transform("lines", lambda x: x["l_linestatus"]))) == 1).alias("linear"), F.size(F.filter("lines", lambda x: x["l_discount"] > 0.05)).alias("references"),
    )
    return traces.join(t.orders.select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("motif")), "o_orderkey")


@query()
def nearest_trace(t: Tables) -> DataFrame:
    """For each finished order the structurally nearest of the others; tests hold it against all pairs."""
    rows = structures(t)
    pool = rows.where("o_orderstatus <> 'F'").withColumnRenamed("o_orderkey", "near_orderkey")
    return sim.nearest_structure(rows.where("o_orderstatus = 'F'"), pool, "o_orderkey", "near_orderkey")


@query("""WITH r AS (SELECT user_id, event_id % 2 AS epoch, value, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS slot FROM events)
SELECT a.user_id, count(*) AS slots, count_if(b.value > a.value) AS better FROM r a JOIN r b ON a.user_id = b.user_id AND a.slot = b.slot AND a.epoch = 0 AND b.epoch = 1 GROUP BY 1""")
def slot_join(t: Tables) -> DataFrame:
    """The i-th rollout of an epoch beside the i-th of the next, as many as both have."""
    slot = F.row_number().over(Window.partitionBy("user_id", "epoch").orderBy("event_id"))
    rows = t.events.select("user_id", (F.col("event_id") % 2).alias("epoch"), "event_id", "value").withColumn("slot", slot)
    a, b = rows.where("epoch = 0").select("user_id", "slot", F.col("value").alias("a")), rows.where("epoch = 1").select("user_id", "slot", F.col("value").alias("b"))
    return a.join(b, ["user_id", "slot"]).groupBy("user_id").agg(F.count("*").alias("slots"), F.count_if(F.col("b") > F.col("a")).alias("better"))


@query("""WITH p AS (SELECT o_orderkey, o_orderstatus = 'F' AS a, o_totalprice > 150000 AS b, o_orderpriority AS priority, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders)
SELECT 'priority' AS kind, priority AS bucket, count(*) AS n, count_if(b AND NOT a) AS gained, count_if(a AND NOT b) AS lost FROM p GROUP BY 2
UNION ALL SELECT 'year', y, count(*), count_if(b AND NOT a), count_if(a AND NOT b) FROM p GROUP BY 2""")
def bucketed_paired(t: Tables) -> DataFrame:
    """Two arms compared within each bucket of each kind, in one pass."""
    rows = t.orders.select((F.col("o_orderstatus") == "F").alias("a"), (F.col("o_totalprice") > 150000).alias("b"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").cast("string").alias("year"))
    long = rows.unpivot(["a", "b"], ["priority", "year"], "kind", "bucket")
    return long.groupBy("kind", "bucket").agg(F.count("*").alias("n"), F.count_if(F.col("b") & ~F.col("a")).alias("gained"), F.count_if(F.col("a") & ~F.col("b")).alias("lost"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT user_id, sum(n) AS total, max(n) FILTER (WHERE event_type <> 'error') AS top FROM c GROUP BY 1)
SELECT t.user_id, round(coalesce(top, 0) * 1.0 / total, 6) AS consistency, round(coalesce((SELECT n FROM c WHERE c.user_id = t.user_id AND event_type = 'click'), 0) * 1.0 / total, 6) AS success FROM t""")
def consistency(t: Tables) -> DataFrame:
    """Share of the commonest answer, and of the gold one ('click'), failures ('error') counting below."""
    counts = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    top, gold = F.max(F.when(F.col("event_type") != "error", F.col("n"))), F.sum(F.when(F.col("event_type") == "click", F.col("n")))
    share = lambda c: F.round(F.coalesce(c, F.lit(0)) / F.sum("n"), 6)
    return counts.groupBy("user_id").agg(share(top).alias("consistency"), share(gold).alias("success"))


@query("""SELECT count(*) AS n, round(avg(CAST(quality IS NOT DISTINCT FROM (CASE WHEN n_chars > 600 THEN 1 ELSE 0 END) AS INTEGER)), 6) AS quality, round(avg(CAST(toxic IS NOT DISTINCT FROM (CASE WHEN n_chars < 100 THEN 1 ELSE 0 END) AS INTEGER)), 6) AS toxic
FROM labels JOIN documents USING (doc_id)""")
def field_agreement(t: Tables) -> DataFrame:
    """How often two raters say the same, field by field; two nulls agree."""
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    same = lambda c, other: F.round(F.avg(F.col(c).eqNullSafe(other.cast("int")).cast("int")), 6).alias(c)
    return rows.agg(F.count("*").alias("n"), same("quality", F.col("n_chars") > 600), same("toxic", F.col("n_chars") < 100))


@query("SELECT o_orderpriority AS stage, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def partial_merge(t: Tables) -> DataFrame:
    """Rates from the sums and counts that shards report."""
    shards = t.orders.groupBy(F.col("o_orderpriority").alias("stage"), (F.col("o_orderkey") % 8).alias("shard")).agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("c"))
    return shards.groupBy("stage").agg(F.sum("c").alias("n"), F.round(F.sum("s") / F.sum("c"), 4).alias("mean"))


@query("""WITH s AS (SELECT l_orderkey, least(count(*), 5) AS calls FROM lineitem GROUP BY 1), c AS (SELECT calls, count(*) AS n FROM s GROUP BY 1)
SELECT CAST(calls AS INTEGER) AS calls, n, round(max(n) OVER () * 1.0 / sum(n) OVER (), 6) AS dominance FROM c""")
def capped_histogram(t: Tables) -> DataFrame:
    """Tasks by calls, the last bin open, and the share of the largest bin."""
    counts = t.lineitem.groupBy("l_orderkey").agg(F.least(F.count("*"), F.lit(5)).cast("int").alias("calls")).groupBy("calls").agg(F.count("*").alias("n"))
    return counts.withColumn("dominance", F.round(F.max("n").over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy()), 6))  # a row per bin


@query()
def bootstrap_rates(t: Tables) -> DataFrame:
    """Mean, deviation and interval of a rate over resamples; tests hold them against the normal approximation."""
    return agg.bootstrap_rate(t.orders, ["o_orderpriority"], F.col("o_orderstatus") == "F")


@query("""WITH e AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, avg(o_totalprice) AS reward FROM orders GROUP BY 1, 2)
SELECT y, m, round(reward, 4) AS reward, round(reward - lag(reward) OVER (ORDER BY y, m), 4) + 0.0 AS trend FROM e""")
def reward_timeline(t: Tables) -> DataFrame:
    """Mean reward by epoch and its change."""
    epochs = t.orders.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.avg("o_totalprice").alias("reward"))
    before = F.lag("reward").over(Window.orderBy("y", "m"))  # a row per epoch
    return epochs.select("y", "m", F.round("reward", 4).alias("reward"), (F.round(F.col("reward") - before, 4) + F.lit(0.0)).alias("trend"))


@query("""SELECT o_orderkey, ntile(4) OVER w AS quarter, lead(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END IGNORE NULLS) OVER w AS next_failed,
  count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(o_totalprice AS BIGINT) RANGE BETWEEN 20000 PRECEDING AND CURRENT ROW) AS near FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def window_frames(t: Tables) -> DataFrame:
    """Quartiles, the next value that is there, and counts within a range of values."""
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    # What follows is what came before in falling order; a frame that ends at the last row is built anew for each row.
    back = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.last(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")), ignorenulls=True).over(back)
    # Halves go to the even number, as in a cast of SQL's.
    near = F.count("*").over(Window.partitionBy("o_custkey").orderBy(F.rint("o_totalprice").cast("bigint")).rangeBetween(-20000, 0))
    return t.orders.select("o_orderkey", F.ntile(4).over(own).cast("long").alias("quarter"), after.alias("next_failed"), near.alias("near"))


@query()
def greedy_take(t: Tables) -> DataFrame:
    """The best rows with unlike inputs and outputs, at most twenty of a pattern; tests hold it against the walk."""
    rows = t.part.select("p_partkey", "p_brand", "p_name", "p_retailprice", F.concat_ws("|", "p_brand", "p_type", "p_size").alias("output"))
    return m.greedy_take(rows, [-F.col("p_retailprice"), F.col("p_partkey")], ["p_name", "output"], "p_brand", 20).select("p_partkey", "p_brand")


@query()
def weighted_quotas(t: Tables) -> DataFrame:
    """Rows of each segment by weights and availability, in hash order; tests hold the quotas against known ones."""
    counts = {r["c_mktsegment"]: r["n"] for r in t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n")).collect()}  # a row per segment
    wanted = m.quotas(counts, {"BUILDING": 5.0, "MACHINERY": 3.0, "HOUSEHOLD": 1.0}, sum(counts.values()) // 2)
    limits = t.spark.createDataFrame(sorted(wanted.items()), "c_mktsegment string, quota int")
    nth = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.xxhash64("c_custkey"), "c_custkey"))
    rows = t.customer.join(F.broadcast(limits), "c_mktsegment").withColumn("nth", nth)
    return rows.where("nth <= quota").select("c_custkey", "c_mktsegment")


@query("""WITH c AS (SELECT o_orderpriority AS stage, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT *, CAST(round_even(n * 0.25, 0) AS BIGINT) AS easy, CAST(round_even(n * 0.5, 0) AS BIGINT) AS medium FROM c)
SELECT stage, n, easy, least(n - easy, medium) AS medium, n - easy - least(n - easy, medium) AS hard FROM e""")
def difficulty_mix(t: Tables) -> DataFrame:
    """How many easy, medium and hard tasks a stage takes."""
    stages = t.orders.groupBy(F.col("o_orderpriority").alias("stage")).agg(F.count("*").alias("n"))
    return stages.withColumn("mix", m.difficulty_targets(F.col("n"), 0.25, 0.5)).select("stage", "n", "mix.easy", "mix.medium", "mix.hard")


@query("""WITH s AS (SELECT event_id, user_id, 0.5 * greatest(0, least(1, value / 100)) + 0.3 / (1 + count(*) OVER (PARTITION BY user_id, event_type)) + 0.2 * greatest(0, least(1, (event_id % 7) / 7.0)) AS score FROM events WHERE value IS NOT NULL)
SELECT user_id, event_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, event_id) AS nth FROM s) WHERE nth = 1""")
def best_of_n(t: Tables) -> DataFrame:
    """The best candidate of a user by gap, novelty and signal."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    seen = F.count("*").over(Window.partitionBy("user_id", "event_type"))
    rows = t.events.where("value is not null").select("user_id", "event_id", (0.5 * unit(F.col("value") / 100) + 0.3 / (1 + seen) + 0.2 * unit((F.col("event_id") % 7) / 7.0)).alias("score"))
    best = rows.groupBy("user_id").agg(F.max_by(F.struct("event_id", "score"), F.struct(F.round("score", 9), -F.col("event_id"))).alias("b"))
    return best.select("user_id", "b.event_id", F.round("b.score", 6).alias("score"))


@query("""WITH RECURSIVE t AS (SELECT p_type AS x, min(p_partkey) AS id, count(*) AS n FROM part GROUP BY 1), g AS (SELECT id, list_distinct(list_transform(range(1, greatest(length(x) - 2, 1) + 1), lambda i: x[i:i + 2])) AS s FROM t),
e AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.id <> b.id AND len(list_intersect(a.s, b.s)) >= 0.7 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))),
r AS (SELECT id AS a, id AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS id, min(b) AS cluster FROM r GROUP BY 1), z AS (SELECT cluster, sum(n) AS size FROM t JOIN c USING (id) GROUP BY 1)
SELECT p_partkey, cluster, round(-0.5 * size / (SELECT count(*) FROM part), 6) AS penalty FROM part JOIN t ON p_type = x JOIN c USING (id) JOIN z USING (cluster)""")
def repetition_penalty(t: Tables) -> DataFrame:
    """Texts clustered by character n-grams, and what a row loses for the size of its cluster."""
    clusters = m.ngram_clusters(t.part, "p_partkey", "p_type", 0.7)
    total = t.part.agg(F.count("*").alias("total"))
    return clusters.join(F.broadcast(total), F.lit(True)).select("p_partkey", "cluster", F.round(-0.5 * F.col("size") / F.col("total"), 6).alias("penalty"))  # one row


@query("SELECT p_partkey, round(levenshtein(p_name, p_type) * 1.0 / greatest(length(p_name), length(p_type)), 6) AS ratio, len(list_intersect(string_split(lower(p_name), ' '), string_split(lower(p_type), ' '))) AS common FROM part")
def edit_distance(t: Tables) -> DataFrame:
    """Levenshtein distance over the longer text's length, 0 for equal ones, and common words."""
    words = lambda c: F.split(F.lower(c), " ")
    ratio = F.levenshtein("p_name", "p_type") / F.greatest(F.length("p_name"), F.length("p_type"))
    return t.part.select("p_partkey", F.round(ratio, 6).alias("ratio"), F.size(F.array_intersect(words("p_name"), words("p_type"))).cast("long").alias("common"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, reverse(p_name) AS backwards, array_to_string(list_transform(list_filter(string_split(p_type, ' '), lambda w: w <> ''), lambda w: w[1]), '') AS initials,
  lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, repeat(left(p_brand, 2), 2) AS twice FROM part""")
def string_tools(t: Tables) -> DataFrame:
    """Slugs, reversal, initials, padding and repetition."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    initials = F.array_join(F.transform(F.filter(F.split("p_type", " "), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")
    return t.part.select("p_partkey", slug.alias("slug"), F.reverse("p_name").alias("backwards"), initials.alias("initials"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.repeat(F.substring("p_brand", 1, 2), F.lit(2)).alias("twice"))


@query("""SELECT event_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0') AS clock,
  (hour(ts) * 60 + minute(ts) + event_id % 90) % 1440 AS ends FROM events""")
def clock_tools(t: Tables) -> DataFrame:
    """Day numbers, minutes as a clock, and minutes added past midnight."""
    minutes = F.hour("ts") * 60 + F.minute("ts")
    clock = F.concat(F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))
    return t.events.select("event_id", F.datediff("ts", F.lit("2024-01-01")).alias("day"), clock.alias("clock"), ((minutes + F.col("event_id") % 90) % 1440).alias("ends"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE date_trunc('month', o_orderdate) = (SELECT max(date_trunc('month', o_orderdate)) FROM orders)")
def latest_run(t: Tables) -> DataFrame:
    """Rows of the last run only."""
    return m.latest(t.orders.withColumn("run", F.trunc("o_orderdate", "month")), "run").select("o_orderkey", "o_totalprice")
