"""Filters, contamination, near duplicates, quotas, strata, splits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import scoring, text
from tracelake.operators import curation as cur
from tracelake.operators import windows as win
from tracelake.operators.components import connected_components
from tracelake.storage import materialize
from tracelake.plans.registry import Tables, query

_SQUASH = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH d AS (SELECT doc_id, text, {_SQUASH} AS norm FROM documents), b AS (SELECT item_id, text, {_SQUASH} AS norm FROM benchmark)
SELECT doc_id FROM d WHERE sha256(norm) NOT IN (SELECT sha256(norm) FROM b) AND doc_id NOT IN (SELECT item_id * 10 FROM b)""")
def contamination_anti(t: Tables) -> DataFrame:
    """Without documents that share a question hash or an id with the benchmark: an anti-join for each key."""
    docs = t.documents.select("doc_id", F.sha2(text.squash(F.col("text")), 256).alias("question"))
    held = t.benchmark.select((F.col("item_id") * 10).alias("doc_id"), F.sha2(text.squash(F.col("text")), 256).alias("question"))
    return cur.without_overlap(docs, held, "question", "doc_id").select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def blocked_ids(t: Tables) -> DataFrame:
    """Rows whose key is not on a block list."""
    blocked = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(blocked, "o_custkey", "left_anti").select("o_orderkey")


@query(r"""SELECT doc_id, CASE WHEN length(text) < 60 THEN 'too_short' WHEN regexp_matches(text, '(?i)licen[cs]ed? under') THEN 'license' WHEN contains(text, ' | ') THEN 'table'
  WHEN contains(text, '!!') THEN 'shouting' END AS reason FROM documents""")
def first_reason_validator(t: Tables) -> DataFrame:
    """The first check that a text fails, null for accepted ones."""
    c = F.col("text")
    reason = scoring.first_reason((F.length(c) < 60, "too_short"), (c.rlike("(?i)licen[cs]ed? under"), "license"), (F.contains(c, F.lit(" | ")), "table"), (F.contains(c, F.lit("!!")), "shouting"))
    return t.documents.select("doc_id", reason.alias("reason"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def dedup_fingerprint(t: Tables) -> DataFrame:
    """One document of each exact text."""
    rows = t.documents.select("doc_id", "n_chars", F.sha2("text", 256).alias("fp"))
    return win.top_k(rows, ["fp"], [F.desc("n_chars"), F.col("doc_id")]).select("doc_id")


_PART_SETS = """s AS (SELECT p_partkey AS id, list_distinct(string_split(lower(p_name || ' ' || p_brand || ' ' || p_type || ' s' || CAST(p_size AS VARCHAR)), ' ')) AS tokens FROM part),
x AS (SELECT id, len(tokens) AS n, unnest(tokens) AS t FROM s),
pairs AS (SELECT a.id AS a_id, b.id AS b_id, count(*) * 1.0 / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard FROM x a JOIN x b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2 HAVING count(*) * 1.0 / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.8)"""


def _part_sets(t: Tables) -> DataFrame:
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type", F.concat(F.lit("s"), F.col("p_size").cast("string")))), " ")
    return t.part.select(F.col("p_partkey").alias("id"), words.alias("tokens"))


@query(f"WITH {_PART_SETS} SELECT a_id, b_id, jaccard FROM pairs")
def similar_pairs(t: Tables) -> DataFrame:
    """Exact token-Jaccard self-join by prefix filter."""
    sets = _part_sets(t)
    return cur.token_pairs(sets, sets, 0.8, ordered=True)


@query(f"""WITH RECURSIVE {_PART_SETS}, e AS (SELECT a_id AS a, b_id AS b FROM pairs UNION ALL SELECT b_id, a_id FROM pairs),
reach AS (SELECT id AS a, id AS b FROM s UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a) SELECT a AS id, min(b) AS component FROM reach GROUP BY 1""")
def near_dup_clusters(t: Tables) -> DataFrame:
    """Clusters of similar rows; a row without a partner is its own."""
    rows = _part_sets(t).select("id", F.array_sort(F.array_distinct("tokens")).alias("tokens"))
    # Equal sets are one class before anything is compared.
    classes = materialize(rows.groupBy("tokens").agg(F.min("id").alias("id")), "token_classes")
    parts = connected_components(cur.token_pairs(classes, classes, 0.8, ordered=True), "a_id", "b_id").withColumnRenamed("node", "id")
    named = classes.join(parts, "id", "left").select("tokens", F.coalesce("component", "id").alias("component"))
    return rows.join(named, "tokens").select("id", "component")


@query("""WITH d AS (SELECT doc_id AS id, list_distinct(string_split(lower(text), ' ')) AS tokens FROM documents),
b AS (SELECT item_id AS id, list_distinct(string_split(lower(text), ' ')) AS tokens FROM benchmark),
x AS (SELECT id, len(tokens) AS n, unnest(tokens) AS t FROM d), y AS (SELECT id, len(tokens) AS n, unnest(tokens) AS t FROM b)
SELECT x.id AS a_id, y.id AS b_id, count(*) * 1.0 / (any_value(x.n) + any_value(y.n) - count(*)) AS jaccard FROM x JOIN y USING (t) GROUP BY 1, 2 HAVING count(*) * 1.0 / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.1""")
def token_overlap(t: Tables) -> DataFrame:
    """All texts against seeds by token Jaccard."""
    words = F.split(F.lower("text"), " ")
    docs = t.documents.select(F.col("doc_id").alias("id"), words.alias("tokens"))
    return cur.seed_pairs(docs, t.benchmark.select(F.col("item_id").alias("id"), words.alias("tokens")), 0.1)


_ALLOC = """q AS (SELECT stratum, n, n * 100.0 / sum(n) OVER () AS quota FROM strata), f AS (SELECT *, floor(quota) AS fl FROM q),
alloc AS (SELECT stratum, n, CAST(fl + CASE WHEN row_number() OVER (ORDER BY quota - fl DESC, stratum) <= 100 - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS alloc FROM f)"""
_STRATA = "strata AS (SELECT lang AS stratum, count(*) AS n FROM documents GROUP BY 1)"


def _allocation(t: Tables) -> DataFrame:
    return cur.largest_remainder(t.documents.groupBy(F.col("lang").alias("stratum")).agg(F.count("*").alias("n")), 100)


@query(f"WITH {_STRATA}, {_ALLOC} SELECT stratum, n, alloc FROM alloc")
def largest_remainder(t: Tables) -> DataFrame:
    """A hundred rows dealt to strata in proportion."""
    return _allocation(t)


@query(f"WITH {_STRATA}, {_ALLOC} SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) JOIN alloc ON lang = stratum WHERE r <= alloc")
def stratified_sample(t: Tables) -> DataFrame:
    """The rows of that allocation, in hash order."""
    rows = t.documents.select("doc_id", F.col("lang").alias("stratum"))
    return cur.take_per_stratum(rows, _allocation(t), "stratum", [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]).select("doc_id", F.col("stratum").alias("lang"))


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || CAST(doc_id AS VARCHAR)), doc_id) AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, CASE WHEN pos <= greatest(1, round(n * 0.1)) THEN 'val' ELSE 'train' END AS split FROM r""")
def stratified_split(t: Tables) -> DataFrame:
    """A tenth of each stratum, one at least, held out by hash order."""
    return cur.hash_split(t.documents.select("doc_id", "source"), "source", "doc_id", 0.1).select("doc_id", "split")


@query("SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) ORDER BY r, source LIMIT 50")
def round_robin_sample(t: Tables) -> DataFrame:
    """Fifty rows, one of each stratum in turn."""
    return cur.round_robin(t.documents.select("doc_id", "source"), "source", [F.col("doc_id")], 50).select("doc_id")


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS r FROM events)
SELECT event_id FROM r WHERE r <= CASE event_type WHEN 'error' THEN 50 WHEN 'purchase' THEN 30 ELSE 10 END""")
def quota_select(t: Tables) -> DataFrame:
    """Quotas by type."""
    quota = F.when(F.col("event_type") == "error", 50).when(F.col("event_type") == "purchase", 30).otherwise(10)
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("event_type").orderBy(F.md5(F.col("event_id").cast("string")), "event_id"))
    return t.events.select("event_id", "event_type", at.alias("r")).where(F.col("r") <= quota).select("event_id")


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id) AS r FROM events)
SELECT event_id, CASE event_type WHEN 'purchase' THEN r > 100 WHEN 'click' THEN r > 50 ELSE false END AS held_back, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS level FROM r""")
def tier_merge(t: Tables) -> DataFrame:
    """Tiers by priority, with what their caps hold back marked and, as in the reference, kept."""
    rows = t.events.select("event_id", "event_type", "value")
    return cur.tier_merge(rows, "event_type", {"purchase": 0, "click": 1}, {"purchase": 100, "click": 50}, [F.col("value").desc_nulls_last(), F.col("event_id")]).select("event_id", "held_back", "level")


@query("""WITH u AS (SELECT doc_id AS id, source AS shard, text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, source, text FROM documents WHERE doc_id % 2 = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY shard, id) AS r FROM u)
SELECT id, shard, 'row_' || lpad(CAST(row_number() OVER (PARTITION BY shard ORDER BY id) - 1 AS VARCHAR), 6, '0') AS new_id FROM f WHERE r = 1""")
def merge_shards(t: Tables) -> DataFrame:
    """Shards together, first seen of each text, numbered anew."""
    cols = [F.col("doc_id").alias("id"), F.col("source").alias("shard"), F.sha2("text", 256).alias("fp")]
    both = t.documents.where("doc_id % 2 = 0").select(*cols).unionByName(t.documents.where("doc_id % 2 = 1").select(*cols))
    return win.renumber(win.top_k(both, ["fp"], [F.col("shard"), F.col("id")]), ["shard"], ["id"], "row_").select("id", "shard", "new_id")


@query()
def first_seen_either_key(t: Tables) -> DataFrame:
    """The sequential rule over two keys, exactly: tests hold it against a loop."""
    rows = t.events.select("event_id", F.concat_ws(":", F.col("user_id"), F.pmod("event_id", F.lit(5))).alias("a"), F.concat_ws(":", F.pmod("event_id", F.lit(977)), "event_type").alias("b"))
    return cur.first_seen_by_either(rows, "event_id", "a", "b").select("event_id")


@query("""WITH v AS (SELECT doc_id FROM documents WHERE doc_id % 10 = 0), r AS (SELECT doc_id FROM documents WHERE doc_id % 10 <> 0)
SELECT (SELECT count(*) FROM (SELECT doc_id FROM v INTERSECT SELECT doc_id FROM r)) AS common, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT (SELECT doc_id FROM v UNION SELECT doc_id FROM r))) AS uncovered""")
def split_invariants(t: Tables) -> DataFrame:
    """A split's parts are disjoint and cover everything."""
    ids = t.documents.select("doc_id")
    v, r = ids.where("doc_id % 10 = 0"), ids.where("doc_id % 10 <> 0")
    marks = v.intersect(r).select(F.lit(1).alias("c"), F.lit(0).alias("u")).unionByName(ids.exceptAll(v.unionByName(r)).select(F.lit(0).alias("c"), F.lit(1).alias("u")))
    return marks.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("common"), F.coalesce(F.sum("u"), F.lit(0)).alias("uncovered"))


@query("""WITH p AS (SELECT task_id, CASE WHEN rate >= 0.9 THEN 'easy_drop' WHEN rate < 0.3 THEN 'dead_low' WHEN rate IS NOT NULL THEN 'keep' ELSE 'not_probed' END AS route
FROM (SELECT o_orderkey AS task_id, rate FROM orders LEFT JOIN (SELECT l_orderkey, count_if(l_returnflag <> 'R') * 1.0 / count(*) AS rate FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)) SELECT route, count(*) AS n FROM p GROUP BY 1""")
def probe_routing(t: Tables) -> DataFrame:
    """Tasks by what a probe found; those without lines were not probed."""
    rate = t.lineitem.groupBy("l_orderkey").agg((F.count_if(F.col("l_returnflag") != "R") / F.count("*")).alias("rate"))
    route = F.when(F.col("rate") >= 0.9, "easy_drop").when(F.col("rate") < 0.3, "dead_low").when(F.col("rate").isNotNull(), "keep").otherwise("not_probed")
    return t.orders.join(rate, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(route.alias("route")).agg(F.count("*").alias("n"))
