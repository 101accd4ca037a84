"""Distributions, correlations, agreement and paired comparisons.  Arms are the same key under two predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators import aggregates as agg
from tracelake.plans.registry import Tables, query

TWO = """d AS (SELECT event_type, count_if(event_id % 2 = 0) AS a, count_if(event_id % 2 <> 0) AS b FROM events GROUP BY 1),
s AS (SELECT *, a * 1.0 / sum(a) OVER () AS p, b * 1.0 / sum(b) OVER () AS q FROM d)"""
ARMS = """arms AS (SELECT o_custkey AS task_id, bool_or(o_orderstatus = 'F') AS a, bool_or(o_totalprice > 300000) AS b FROM orders GROUP BY 1)"""


def two(t: Tables) -> DataFrame:
    return agg.two_distributions(t.events, F.col("event_id") % 2 == 0, "event_type")


def arms(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_custkey").alias("task_id")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("a"), F.bool_or(F.col("o_totalprice") > 300000).alias("b"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT user_id, n * 1.0 / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, round(-sum(p * log2(p)), 9) AS entropy FROM p GROUP BY 1""")
def entropy(t: Tables) -> DataFrame:
    """Bits of the event types of each user."""
    return agg.entropy(t.events, ["user_id"], "event_type").withColumn("entropy", F.round("entropy", 9))


@query("SELECT CAST(least(floor(CAST(l_discount * 10 AS DOUBLE) * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(t: Tables) -> DataFrame:
    """Ten bins on [0, 1], the last one closed."""
    return agg.histogram(t.lineitem, F.col("l_discount") * 10)


@query("""SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.9), 6) AS p90, round(median(o_totalprice), 6) AS med FROM orders GROUP BY 1""")
def percentiles(t: Tables) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    x = F.col("o_totalprice")
    return t.orders.groupBy("o_orderpriority").agg(F.round(F.percentile(x, 0.5), 6).alias("p50"), F.round(F.percentile(x, 0.9), 6).alias("p90"), F.round(F.median(x), 6).alias("med"))


@query("""SELECT l_returnflag, round(var_pop(l_quantity), 6) AS var_p, round(var_samp(l_quantity), 6) AS var_s, round(stddev_pop(l_quantity), 6) AS std_p FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def var_pop_samp(t: Tables) -> DataFrame:
    """Both variances; groups of one row are left out."""
    x = F.col("l_quantity")
    by = t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.var_pop(x), 6).alias("var_p"), F.round(F.var_samp(x), 6).alias("var_s"), F.round(F.stddev_pop(x), 6).alias("std_p"))
    return by.where("n > 1").drop("n")


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem GROUP BY 1 HAVING count(*) >= 3")
def pearson(t: Tables) -> DataFrame:
    """Correlation of quantity and price."""
    return agg.pearson(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice").withColumn("r", F.round("r", 8))


@query("""WITH r AS (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY user_id ORDER BY event_id) * 1.0 AS y FROM events WHERE value IS NOT NULL)
SELECT user_id, CASE WHEN count(*) >= 3 AND stddev_pop(x) > 0 THEN round(corr(x, y), 8) END AS rho FROM r GROUP BY 1""")
def spearman(t: Tables) -> DataFrame:
    """Rank correlation of value and order of events."""
    return agg.spearman(t.events, ["user_id"], "value", "event_id").withColumn("rho", F.round("rho", 8))


@query(f"WITH {TWO} SELECT round(sum(abs(p - q)), 9) AS l1 FROM s")
def l1_distance(t: Tables) -> DataFrame:
    """Sum of absolute differences of shares."""
    return agg.distances(two(t)).select(F.round("l1", 9).alias("l1"))


@query(f"WITH {TWO} SELECT round(sum(abs(p - q)) / 2, 9) AS tv FROM s")
def tv_distance(t: Tables) -> DataFrame:
    """Half of it."""
    return agg.distances(two(t)).select(F.round("tv", 9).alias("tv"))


@query(f"WITH {TWO} SELECT round(sum(CASE WHEN p > 0 THEN greatest(p, 1e-9) * ln(greatest(p, 1e-9) / greatest(q, 1e-9)) ELSE 0 END), 9) AS kl FROM s")
def kl_divergence(t: Tables) -> DataFrame:
    """Clamped on both sides, not renormalized."""
    return agg.distances(two(t)).select(F.round("kl", 9).alias("kl"))


@query(f"WITH {TWO} SELECT sum(least(a, b)) * 1.0 / sum(greatest(a, b)) AS jaccard FROM s")
def multiset_jaccard(t: Tables) -> DataFrame:
    """Common counts over all counts."""
    return agg.distances(two(t)).select(F.col("multiset_jaccard").alias("jaccard"))


@query("""WITH r AS (SELECT l_orderkey, list(DISTINCT l_returnflag || l_linestatus) AS g, list(DISTINCT CASE WHEN l_discount > 0.05 THEN l_returnflag || 'O' ELSE l_returnflag || l_linestatus END) AS p FROM lineitem GROUP BY 1),
x AS (SELECT g, p, unnest(list_distinct(list_concat(g, p))) AS label FROM r),
b AS (SELECT label, count_if(list_contains(g, label) AND list_contains(p, label)) AS tp, count_if(list_contains(g, label)) AS ng, count_if(list_contains(p, label)) AS np FROM x GROUP BY 1)
SELECT count(*) AS labels, round(avg(2.0 * tp / (ng + np)), 9) AS macro_f1 FROM b WHERE ng > 0""")
def macro_f1(t: Tables) -> DataFrame:
    """Over the gold labels' vocabulary."""
    gold = F.concat("l_returnflag", "l_linestatus")
    pred = F.when(F.col("l_discount") > 0.05, F.concat("l_returnflag", F.lit("O"))).otherwise(gold)
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(gold).alias("g"), F.collect_set(pred).alias("p"))
    return agg.macro_f1(rows, "g", "p").withColumn("macro_f1", F.round("macro_f1", 9))


@query("""WITH d AS (SELECT quality AS a, CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS b FROM labels JOIN documents USING (doc_id)),
c AS (SELECT a, b, count(*) AS n FROM d GROUP BY 1, 2), s AS (SELECT sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) * 1.0 / sum(n) AS agreement FROM c),
r AS (SELECT a AS k, sum(n) AS r FROM c GROUP BY 1), k AS (SELECT b AS k, sum(n) AS c FROM c GROUP BY 1), e AS (SELECT sum(r * c) AS rc FROM r JOIN k USING (k))
SELECT CAST(n AS BIGINT) AS n, agreement, round((agreement - rc * 1.0 / (n * n)) / (1 - rc * 1.0 / (n * n)), 9) AS kappa FROM s, e""")
def cohen_kappa(t: Tables) -> DataFrame:
    """Agreement of two raters beyond chance."""
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("a"), (F.col("n_chars") > 600).cast("int").alias("b"))
    return agg.cohen_kappa(rows, "a", "b").withColumn("kappa", F.round("kappa", 9))


@query(f"""WITH {ARMS}, c AS (SELECT count_if(b AND NOT a) AS gained, count_if(a AND NOT b) AS lost FROM arms)
SELECT gained, lost, CASE WHEN gained + lost > 0 THEN round(power(greatest(abs(gained - lost) - 1, 0), 2) / (gained + lost), 9) END AS chi2 FROM c""", bigint="gained lost")
def mcnemar(t: Tables) -> DataFrame:
    """Continuity-corrected; null without discordant pairs."""
    out = agg.overlap(arms(t), F.col("a"), F.col("b"))
    return out.select(F.col("a_fail_b_win").alias("gained"), F.col("a_win_b_fail").alias("lost"), F.round("chi2", 9).alias("chi2"))


@query()
def mcnemar_p_value(t: Tables) -> DataFrame:
    """The p-value, by erfc, which neither engine has."""
    return agg.overlap(arms(t), F.col("a"), F.col("b")).select("chi2", agg.erfc_p_value(F.col("chi2")).alias("p"))


@query()
def paired_bootstrap(t: Tables) -> DataFrame:
    """Confidence interval of the difference of two arms."""
    return agg.bootstrap_delta(arms(t).withColumnRenamed("task_id", "key"), "a", "b")


@query("""WITH c AS (SELECT c_mktsegment, count(*) AS n, count_if(c_acctbal > 0) AS k FROM customer GROUP BY 1)
SELECT c_mktsegment, n, round(greatest(0, k * 1.0 / n - 1.96 * sqrt((k * 1.0 / n) * (1 - k * 1.0 / n) / n)), 9) AS low, round(least(1, k * 1.0 / n + 1.96 * sqrt((k * 1.0 / n) * (1 - k * 1.0 / n) / n)), 9) AS high FROM c""")
def binomial_ci(t: Tables) -> DataFrame:
    """Normal intervals of a rate."""
    by = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("k"))
    ci = agg.binomial_ci(F.col("k"), F.col("n"))
    return by.select("c_mktsegment", "n", F.round(ci["low"], 9).alias("low"), F.round(ci["high"], 9).alias("high"))


@query(f"""WITH {ARMS} SELECT count(*) AS n, count_if(a AND b) AS both_win, count_if(a AND NOT b) AS a_win_b_fail, count_if(b AND NOT a) AS a_fail_b_win, count_if(NOT a AND NOT b) AS both_fail FROM arms""", bigint="both_win a_win_b_fail a_fail_b_win both_fail")
def overlap_2x2(t: Tables) -> DataFrame:
    """Wins and failures of two arms on common tasks."""
    return agg.overlap(arms(t), F.col("a"), F.col("b")).drop("chi2")


@query("""WITH base AS (SELECT l_orderkey AS task_id, bool_or(l_returnflag <> 'R') AS a FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1),
other AS (SELECT l_orderkey AS task_id, bool_or(l_returnflag <> 'R') AS b FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT a AS base_win, coalesce(b, false) AS other_win, count(*) AS n FROM base LEFT JOIN other USING (task_id) GROUP BY 1, 2""")
def head_to_head(t: Tables) -> DataFrame:
    """Driven by the base arm; a task that the other lacks is a failure of it."""
    win = F.bool_or(F.col("l_returnflag") != "R")
    base = t.lineitem.where("l_linestatus = 'O'").groupBy("l_orderkey").agg(win.alias("base_win"))
    other = t.lineitem.where("l_linestatus = 'F'").groupBy("l_orderkey").agg(win.alias("w"))
    return base.join(other, "l_orderkey", "left").groupBy("base_win", F.coalesce("w", F.lit(False)).alias("other_win")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
SELECT event_type AS from_type, nxt AS to_type, count(*) AS n FROM e WHERE nxt IS NOT NULL GROUP BY 1, 2""")
def transition_matrix(t: Tables) -> DataFrame:
    """How often one type follows another."""
    from pyspark.sql import Window

    follow = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select(F.col("event_type").alias("from_type"), follow.alias("to_type")).where("to_type is not null").groupBy("from_type", "to_type").agg(F.count("*").alias("n"))


_MEANS = """c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2),
g AS (SELECT i, avg(x) AS m FROM (SELECT generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1)"""


@query(f"WITH {_MEANS} SELECT label, round(sqrt(sum((c.m - g.m) * (c.m - g.m))), 8) AS distance FROM c JOIN g USING (i) GROUP BY 1")
def centroid_distance(t: Tables) -> DataFrame:
    """Distance of each checkpoint's centroid from that of all."""
    means, overall = agg.centroids(t.embeddings, ["label"], "embedding"), agg.centroids(t.embeddings, [], "embedding").withColumnRenamed("mean", "g")
    return means.join(F.broadcast(overall), "at").groupBy("label").agg(F.round(F.sqrt(F.sum(F.pow(F.col("mean") - F.col("g"), 2))), 8).alias("distance"))


@query(f"""WITH {_MEANS}, z AS (SELECT i, m FROM c WHERE label = 0) SELECT label, round(sum(c.m * z.m) / (sqrt(sum(c.m * c.m)) * sqrt(sum(z.m * z.m))), 8) AS cosine FROM c JOIN z USING (i) WHERE label <> 0 GROUP BY 1""")
def cosine_alignment(t: Tables) -> DataFrame:
    """Cosine of each centroid with that of the first label."""
    means = agg.centroids(t.embeddings, ["label"], "embedding")
    zero = means.where("label = 0").select("at", F.col("mean").alias("z"))
    dot = F.sum(F.col("mean") * F.col("z")) / (F.sqrt(F.sum(F.col("mean") * F.col("mean"))) * F.sqrt(F.sum(F.col("z") * F.col("z"))))
    return means.where("label <> 0").join(F.broadcast(zero), "at").groupBy("label").agg(F.round(dot, 8).alias("cosine"))


@query("""WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM events) SELECT event_id, round((value - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 8) AS z FROM events, s""")
def standard_scaling(t: Tables) -> DataFrame:
    """Population scaling; without spread only centred."""
    stats = t.events.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    z = (F.col("value") - F.col("m")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    return t.events.join(F.broadcast(stats), F.lit(True)).select("event_id", F.round(z, 8).alias("z"))
