"""Sources and sinks as round trips: a table goes out in a format and comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import traces as tr
from tracelake.plans.registry import Tables, query
from tracelake.sources import files, versions
from tracelake.storage import materialize, new_path

_EVENT = "event_id long, user_id long, event_type string, value double, props string"


def _schema(t: Tables, text: str):
    return t.spark.createDataFrame([], text).schema


@query("SELECT event_id, user_id, event_type, value, props FROM events")
def jsonl_strict(t: Tables) -> DataFrame:
    """Events as JSON lines and back; a bad line would fail the read."""
    path = new_path(t.spark, "jsonl")
    files.write_jsonl(t.events.select("event_id", "user_id", "event_type", "value", "props"), path)
    return files.read_jsonl(t.spark, path, _schema(t, _EVENT))


def _damaged_lines(t: Tables) -> str:
    """Events as JSON lines, those of errors cut off, those of clicks without anything."""
    path = new_path(t.spark, "lines")
    line = F.to_json(F.struct("event_id", "user_id", "event_type"))
    lines = F.when(F.col("event_type") == "error", F.expr("left(line, length(line) - 4)")).when(F.col("event_type") == "click", "").otherwise(F.col("line"))
    t.events.withColumn("line", line).select(lines.alias("value")).write.text(path)
    return path


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type NOT IN ('error', 'click')")
def jsonl_tolerant(t: Tables) -> DataFrame:
    """What can be read of lines of which some are damaged and some empty."""
    return files.read_jsonl(t.spark, _damaged_lines(t), _schema(t, "event_id long, user_id long, event_type string"), strict=False)


@query("""SELECT left(line, length(line) - 4) AS line FROM (SELECT '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS line FROM events WHERE event_type = 'error')""")
def jsonl_bad_lines(t: Tables) -> DataFrame:
    """The damaged lines themselves."""
    return materialize(files.bad_lines(t.spark, _damaged_lines(t), _schema(t, "event_id long, user_id long, event_type string")), "bad_lines").select("line")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_acctbal > 0")
def json_arrays(t: Tables) -> DataFrame:
    """Customers as files of one array each, about a hundred to a file; rows without a name are placeholders."""
    path = new_path(t.spark, "arrays")
    name = F.when(F.col("c_acctbal") > 0, F.col("c_name"))
    some = t.customer.select(F.floor(F.col("c_custkey") / 100).alias("file"), F.struct("c_custkey", name.alias("c_name"), "c_nationkey").alias("row"))
    arrays = some.groupBy("file").agg(F.to_json(F.collect_list("row")).alias("value"))
    arrays.write.partitionBy("file").text(path)
    read = files.read_json_array(t.spark, path, _schema(t, "c_custkey long, c_name string, c_nationkey int"), ["c_name"])
    return read.select("c_custkey", "c_name", "c_nationkey")


@query("""SELECT p_partkey, p_name || ', "' || p_brand || '"' || chr(10) || p_type AS note, '{"size":' || p_size || ',"tags":["' || p_brand || '","a,b"]}' AS nested FROM part""")
def csv_round_trip(t: Tables) -> DataFrame:
    """Commas, quotes, line feeds and nested values through CSV."""
    path = new_path(t.spark, "csv")
    note = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"\n'), "p_type")
    nested = F.struct(F.col("p_size").alias("size"), F.array("p_brand", F.lit("a,b")).alias("tags"))
    files.write_csv(t.part.select("p_partkey", note.alias("note"), nested.alias("nested")), path)
    return files.read_csv(t.spark, path, _schema(t, "p_partkey long, note string, nested string"))


@query("SELECT o_orderkey, substring(o_orderpriority, 1, 1) AS experiment, CAST(year(o_orderdate) AS VARCHAR) AS epoch FROM orders")
def path_keys(t: Tables) -> DataFrame:
    """Orders in folders by experiment and epoch, both read back from the path of each row's file."""
    path = new_path(t.spark, "runs")
    t.orders.select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("exp"), F.year("o_orderdate").alias("ep")).write.partitionBy("exp", "ep").parquet(path)
    read = t.spark.read.schema("o_orderkey long").option("recursiveFileLookup", True).parquet(path)
    return files.with_origin(read, r"/exp=([^/]+)/ep=(\d+)/", ["experiment", "epoch"]).drop("_file")


@query("SELECT event_id, strftime(ts, '%Y%m%d') AS day FROM events WHERE strftime(ts, '%Y%m%d') = (SELECT max(strftime(ts, '%Y%m%d')) FROM events)")
def latest_run_folder(t: Tables) -> DataFrame:
    """Events in a folder for each day, and what the last folder holds."""
    path = new_path(t.spark, "days")
    t.events.select("event_id", F.date_format("ts", "yyyyMMdd").alias("day"), F.date_format("ts", "yyyyMMdd").alias("run")).write.partitionBy("run").parquet(path)
    return t.spark.read.parquet(versions.latest_run(t.spark, path, r"run=(\d{8})"))


@query("SELECT p_partkey, p_size + 1 AS p_size FROM part WHERE p_size + 1 <= 40")
def atomic_rewrite(t: Tables) -> DataFrame:
    """A table that is rewritten from itself."""
    table = versions.Versioned(t.spark, new_path(t.spark, "versions"))
    table.write(t.part.select("p_partkey", "p_size"))
    table.write(table.read().withColumn("p_size", F.col("p_size") + 1).where("p_size <= 40"))
    return table.read()


@query("SELECT count(*) AS rows, true AS same, false AS other FROM lineitem", bigint="rows")
def content_manifest(t: Tables) -> DataFrame:
    """Rows of a table, and whether its digest is that of the table dealt out otherwise, or of one with a value changed."""
    digest = lambda df: files.manifest(df, "l_orderkey")
    # Dealt out anew in parts of a size, so that no task reads more as the table grows.
    one, two = digest(t.lineitem), digest(t.lineitem.hint("rebalance", "l_suppkey"))
    changed = digest(t.lineitem.withColumn("l_tax", F.col("l_tax") + (F.col("l_orderkey") == 1).cast("int") + (F.col("l_linenumber") == 1).cast("int")))
    both = one.crossJoin(two.select(F.col("digest").alias("d2"))).crossJoin(changed.select(F.col("digest").alias("d3")))  # one row each
    return both.select("rows", (F.col("digest") == F.col("d2")).alias("same"), (F.col("digest") == F.col("d3")).alias("other"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'new' WHEN o_orderstatus = 'F' THEN 'old' END AS answer FROM orders")
def keyed_cache(t: Tables) -> DataFrame:
    """Answers by order: finished and open ones cached, the base compacted, the open ones then given new answers."""
    cache = versions.KeyedCache(t.spark, new_path(t.spark, "cache"), "o_orderkey", buckets=16)
    of = lambda where, answer: t.orders.where(where).select("o_orderkey", F.lit(answer).alias("answer"))
    cache.put(of("o_orderstatus <> 'P'", "old"))
    cache.compact()
    cache.put(of("o_orderstatus = 'O'", "new"))
    return cache.get(t.orders.select("o_orderkey")).select("o_orderkey", "cached.answer")


@query("SELECT event_id AS task_id, coalesce(event_type, props) AS question, value AS answer FROM events")
def role_aliases(t: Tables) -> DataFrame:
    """Columns by their roles: the first alias that exists and is not null."""
    return files.resolve(t.events, {"task_id": ["sample_id", "event_id"], "question": ["input", "event_type", "props"], "answer": ["gold_answer", "value"]}, ["task_id", "question"])


@query("SELECT p_partkey, 'arg_2,arg_10,' || CASE WHEN p_size % 2 = 0 THEN 'brand,kind' ELSE 'kind' END AS keys FROM part")
def argument_order(t: Tables) -> DataFrame:
    """Numbered arguments by their numbers, others by name."""
    arg = lambda k, v: F.struct(F.lit(k).alias("k"), F.col(v).cast("string").alias("v"))
    odd, even = F.array(arg("kind", "p_type"), arg("arg_10", "p_size"), arg("arg_2", "p_name")), F.array(arg("kind", "p_type"), arg("brand", "p_brand"), arg("arg_10", "p_size"), arg("arg_2", "p_name"))
    call = F.struct(F.lit("f").alias("name"), F.when(F.col("p_size") % 2 == 0, even).otherwise(odd).alias("args"))
    return t.part.select("p_partkey", F.array_join(F.transform(tr.ordered_arguments(call), lambda e: e["k"]), ",").alias("keys"))
