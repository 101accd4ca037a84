"""Resampling, replay, balanced picks, exact percentiles and calls in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import assignment
from tracelake.operators import resampling as rs
from tracelake.plans.registry import Tables, query
from tracelake.plans.rollups import LINE_ORDER


@query()
def bootstrap_scores(t: Tables) -> DataFrame:
    """Mean of a real-valued score with its interval, resampled by customer; tests hold it against weights drawn one by one."""
    return rs.poisson_bootstrap(t.orders.select("o_orderpriority", "o_custkey", "o_totalprice"), ["o_orderpriority"], "o_totalprice", "o_custkey", resamples=400)


#: A draw's 48 bits as a share of the places.
_DRAW = "CAST(CAST(('0x' || substring(md5('42:' || {of} || ':' || d), 1, 12))::UBIGINT AS HUGEINT) * {size} // 281474976710656 AS BIGINT)"


@query(f"""WITH pool AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR))) - 1 AS place FROM customer WHERE c_nationkey < 20),
draws AS (SELECT {_DRAW.format(of="'all'", size="(SELECT count(*) FROM pool)")} AS place FROM range(3000) r(d))
SELECT c_custkey, count(*) AS times FROM pool JOIN draws USING (place) GROUP BY 1""")
def replay_draws(t: Tables) -> DataFrame:
    """Three thousand draws with replacement from the customers of earlier stages."""
    return rs.replay(t.customer.where("c_nationkey < 20"), "c_custkey", 3000)


@query(f"""WITH s AS (SELECT * FROM (VALUES ('O', 0.1), ('F', 0.1), ('P', 0.8)) v(stage, w)), n AS (SELECT o_orderstatus AS stage, count(*) AS size FROM orders GROUP BY 1),
plan AS (SELECT stage, size, CAST(round_even(w * (SELECT sum(size) FROM n JOIN s USING (stage)), 0) AS BIGINT) AS wanted FROM s JOIN n USING (stage)),
placed AS (SELECT o_orderkey, o_orderstatus AS stage, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR))) - 1 AS place FROM orders),
draws AS (SELECT stage, {_DRAW.format(of="stage", size="size")} AS place FROM (SELECT stage, size, unnest(range(wanted)) AS d FROM plan WHERE wanted > size))
SELECT stage, o_orderkey, CAST(1 AS BIGINT) AS times FROM placed JOIN plan USING (stage) WHERE wanted <= size AND place < wanted
UNION ALL SELECT stage, o_orderkey, count(*) FROM placed JOIN draws USING (stage, place) GROUP BY 1, 2""")
def stage_mix(t: Tables) -> DataFrame:
    """As many orders as there are, four fifths of them of the last stage, which has to repeat its own."""
    weights = rs.replay_weights(["O", "F", "P"], 0.2)
    return rs.mixed_pool(t.orders.select(F.col("o_orderstatus").alias("stage"), "o_orderkey"), "stage", "o_orderkey", weights)


@query("""WITH r AS (SELECT p_partkey, p_brand, md5(CAST(p_partkey AS VARCHAR)) AS h FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY h, p_partkey) AS nth FROM r),
a AS (SELECT p_partkey, p_brand, sum(nth * -ln((('0x' || substring(h, 9, 8))::UINTEGER + 1) / 4294967297.0)) OVER (PARTITION BY p_brand ORDER BY h, p_partkey ROWS UNBOUNDED PRECEDING) AS arrival FROM k WHERE nth <= 12)
SELECT p_partkey, p_brand FROM a ORDER BY arrival, p_partkey LIMIT 120""")
def balanced_pick(t: Tables) -> DataFrame:
    """A hundred and twenty parts drawn with weights that fall with every pick of a brand, none of which has more than a tenth."""
    return rs.balanced_pick(t.part.select("p_partkey", "p_brand"), "p_brand", "p_partkey", 120, 0.1)


@query("""SELECT o_orderpriority, count(o_totalprice) AS n, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders GROUP BY 1""")
def percentiles_at_size(t: Tables) -> DataFrame:
    """Median and high percentiles, exact, of groups that no task holds."""
    out = rs.exact_percentiles(t.orders.select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return out.select("o_orderpriority", "n", *[F.round(c, 4).alias(c) for c in ("p50", "p90", "p99")])


def _calls(t: Tables) -> DataFrame:
    """An order's lines as calls in their order, and its lines by price as predictions, of which a third lack the last and a tenth repeat one."""
    name = F.concat("l_returnflag", "l_linestatus").alias("name")
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*LINE_ORDER, "l_quantity", "l_extendedprice", name))).alias("lines"))
    args = lambda x: F.create_map(F.lit("line"), x["l_quantity"].cast("string"), F.concat(F.lit("supplier"), x["l_suppkey"] % 3), x["l_suppkey"].cast("string"))
    # Calls are made after the shuffle, which carries the columns that they come of.
    plain = lambda lines: F.transform(lines, lambda x: F.struct(x["name"].alias("name"), args(x).alias("args")))
    by_price = F.transform(F.array_sort(F.transform("lines", lambda x: F.struct(x["l_extendedprice"].alias("p"), x.alias("x")))), lambda y: y["x"])
    n = F.size("lines")
    short = F.when(F.col("l_orderkey") % 3 == 0, F.slice(by_price, 1, F.greatest(n - 1, F.lit(0)))).when(F.col("l_orderkey") % 10 == 1, F.concat(F.slice(by_price, 1, n - 1), F.slice(by_price, 1, 1))).otherwise(by_price)
    return rows.select("l_orderkey", plain(F.col("lines")).alias("gold"), plain(short).alias("pred"))


@query("""WITH l AS (SELECT l_orderkey, l_returnflag || l_linestatus AS name, l_extendedprice AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag, l_quantity) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
g AS (SELECT l_orderkey, list_sort(list(name)) AS gold, any_value(n) AS n FROM l GROUP BY 1),
p AS (SELECT l_orderkey, name FROM l WHERE i < n OR (l_orderkey % 3 <> 0 AND l_orderkey % 10 <> 1) UNION ALL SELECT l_orderkey, name FROM l WHERE i = 1 AND l_orderkey % 3 <> 0 AND l_orderkey % 10 = 1),
q AS (SELECT l_orderkey, list_sort(list(name)) AS pred, count(*) AS m FROM p GROUP BY 1)
SELECT l_orderkey, CASE WHEN pred IS NULL THEN 'no_function_call' WHEN m <> n THEN 'expected_' || n || '_calls_got_' || m WHEN pred = gold THEN '' WHEN n <= 8 THEN 'no_valid_permutation' ELSE 'unmatched_call' END AS error FROM g LEFT JOIN q USING (l_orderkey)""")
def calls_in_any_order(t: Tables) -> DataFrame:
    """Whether predicted calls are the gold ones in some order, by name; the SQL compares sorted lists."""
    rows = _calls(t).withColumn("meets", F.transform("pred", lambda p: F.transform("gold", lambda g: p["name"] == g["name"])))
    return rows.select("l_orderkey", assignment.any_order(F.col("meets"), F.size("gold"))["error"].alias("error"))


@query()
def call_accuracy_arguments(t: Tables) -> DataFrame:
    """Greedy call matching with argument maps; tests hold it against a loop."""
    return _calls(t).select("l_orderkey", F.round(assignment.call_accuracy(F.col("gold"), F.col("pred")), 9).alias("accuracy"))
