"""Call matching, trace comparison, parsing and reward ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import calls, scoring, text
from tracelake.plans.registry import Tables, query
from tracelake.plans.rollups import LINE_ORDER, LINE_ORDER_SQL

_SEQ = f"""s AS (SELECT l_orderkey, list(l_returnflag || l_linestatus ORDER BY {LINE_ORDER_SQL}, l_quantity) AS gold, list(l_returnflag || l_linestatus ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity) AS pred FROM lineitem GROUP BY 1)"""


def _sequences(t: Tables) -> DataFrame:
    name = F.concat("l_returnflag", "l_linestatus").alias("name")
    in_order = lambda *c: F.transform(F.array_sort(F.collect_list(F.struct(*c, name))), lambda x: x["name"])
    return t.lineitem.groupBy("l_orderkey").agg(
        in_order(*LINE_ORDER, "l_quantity").alias("gold"), in_order("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").alias("pred")
    )


@query(f"WITH {_SEQ} SELECT l_orderkey, len(list_filter(range(1, len(gold) + 1), lambda i: gold[i] = pred[i])) AS matches, len(gold) AS n FROM s")
def zip_call_match(t: Tables) -> DataFrame:
    """Predicted against gold calls, position by position."""
    same = F.zip_with("gold", "pred", lambda a, b: F.coalesce(a == b, F.lit(False)))
    return _sequences(t).select("l_orderkey", F.size(F.filter(same, lambda x: x)).cast("long").alias("matches"), F.size("gold").cast("long").alias("n"))


@query(f"WITH {_SEQ} SELECT l_orderkey, list_min(list_filter(range(1, len(gold) + 1), lambda i: gold[i] <> pred[i])) AS first_diff, coalesce(list_min(list_filter(range(1, len(gold) + 1), lambda i: gold[i] <> pred[i])) - 1, len(gold)) AS common_prefix FROM s")
def first_divergence(t: Tables) -> DataFrame:
    """Where two sequences first differ, from 1, and their common beginning."""
    at = F.nullif(F.array_position(F.zip_with("gold", "pred", lambda a, b: a.eqNullSafe(b)), F.lit(False)), F.lit(0))
    return _sequences(t).select("l_orderkey", at.alias("first_diff"), F.coalesce(at - 1, F.size("gold").cast("long")).alias("common_prefix"))


@query("""WITH RECURSIVE c AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS pos, l_partkey % 5 AS back FROM lineitem),
d AS (SELECT l_orderkey, pos, 1 AS depth FROM c UNION SELECT c.l_orderkey, c.pos, d.depth + 1 FROM d JOIN c ON c.l_orderkey = d.l_orderkey AND c.back > 0 AND c.pos - c.back = d.pos)
SELECT l_orderkey, CAST(max(depth) AS INTEGER) AS depth FROM d GROUP BY 1""")
def dependency_depth(t: Tables) -> DataFrame:
    """Longest chain of calls; each refers to the one some places back."""
    calls = F.array_sort(F.collect_list(F.struct(*LINE_ORDER, "l_quantity")))
    refs = F.transform(F.col("calls"), lambda x, i: F.when(x["l_partkey"] % 5 > 0, F.array((i + 1 - x["l_partkey"] % 5).cast("int"))).otherwise(F.array().cast("array<int>")))
    return t.lineitem.groupBy("l_orderkey").agg(calls.alias("calls")).select("l_orderkey", scoring.chain_depth(refs).alias("depth"))


@query(r"SELECT page_id, nullif(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '') AS title, len(regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1)) AS paragraphs FROM pages")
def tag_extract(t: Tables) -> DataFrame:
    """First title and number of paragraphs."""
    every = F.regexp_extract_all("html", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1)
    return t.pages.select("page_id", F.nullif(text.tag_first(F.col("html"), "title"), F.lit("")).alias("title"), F.size(every).cast("long").alias("paragraphs"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE event_id % 3 WHEN 0 THEN 'it''s None of them' WHEN 1 THEN 'True' END AS note FROM events WHERE event_id % 5 <> 0
UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_id % 5 = 0""")
def relaxed_json(t: Tables) -> DataFrame:
    """Values of JSON that is fenced and written as Python would: apostrophes and Python's words inside strings, and rows that are neither."""
    note = F.when(F.col("event_id") % 3 == 0, "\"it's None of them\"").when(F.col("event_id") % 3 == 1, "'True'").otherwise("None")
    odd = F.concat(F.lit("```json\n"), F.regexp_replace(F.translate("props", '"', "'"), r"\}$", ", 'note': "), note, F.when(F.col("event_id") % 5 == 0, "").otherwise("}"), F.lit("\n```"))
    rows = t.events.select("event_id", calls.relaxed_json(odd).alias("v"))
    return rows.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.try_variant_get("v", "$.note", "string").alias("note"))


def _written(t: Tables) -> DataFrame:
    """Events as calls in eight shapes, two of which are none."""
    k, n = F.col("event_id") % 8, F.get_json_object("props", "$.k")
    name = F.concat(F.lit("f"), (F.col("event_id") % 4).cast("string"))
    args = F.concat(F.lit('{"k": '), n, F.lit(', "xs": [{"a": 1}]}'))
    shapes = [
        F.concat(F.lit('Think [1] first. <tool_call>[{"name": "'), name, F.lit('", "arguments": '), args, F.lit("}]</tool_call> done")),
        F.concat(F.lit('<tool_call>[{"tool_name": "'), name, F.lit('", "parameters": '), args, F.lit("}")),
        F.concat(F.lit('So:\n```json\n[{"function": {"name": "'), name, F.lit('", "arguments": "'), F.regexp_replace(args, '"', '\\\\"'), F.lit('"}}]\n```')),
        F.concat(F.lit('I call [{"name":"'), name, F.lit('","arguments":'), args, F.lit("}] now")),
        F.concat(F.lit("{'Action': '"), name, F.lit("', 'Action_Input': "), args, F.lit("}")),
        F.concat(F.lit('{"tool": "'), name, F.lit('", "id": 7, "k": '), n, F.lit(', "xs": [{"a": 1}]}')),
        F.concat(F.lit("no call for "), name), F.concat(F.lit('{"k": '), n, F.lit("}")),
    ]
    text = F.get(F.array(*shapes), k.cast("int"))
    return t.events.select("event_id", text.alias("text"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'tag_closed' WHEN 1 THEN 'tag_unclosed' WHEN 2 THEN 'fenced_json' WHEN 3 THEN 'json_in_text' WHEN 4 THEN 'json_in_text' WHEN 5 THEN 'json_in_text' ELSE 'unparseable' END AS method,
  CASE WHEN event_id % 8 < 6 THEN 'f' || (event_id % 4) END AS name, CASE WHEN event_id % 8 < 6 THEN '{"k":' || json_extract_string(props, '$.k') || ',"xs":[{"a":1}]}' END AS arguments FROM events""")
def parse_calls(t: Tables) -> DataFrame:
    """Calls found in model output, in whatever shape."""
    rows = _written(t).select("event_id", calls.parse_calls(F.col("text")).alias("p"))
    return rows.select("event_id", "p.method", F.get("p.calls", F.lit(0))["name"].alias("name"), F.get("p.calls", F.lit(0))["arguments"].alias("arguments"))


@query("""SELECT event_id, event_id % 8 = 7 OR event_id % 8 = 5 AS strict, event_id % 8 IN (4, 5, 7) AS lenient, CASE event_id % 8 WHEN 7 THEN 0.6 WHEN 6 THEN 0.3 WHEN 4 THEN 1.0 WHEN 5 THEN 1.0 ELSE 0.3 END AS reward FROM events""")
def dual_parse(t: Tables) -> DataFrame:
    """Whether a whole answer reads strictly and leniently, and its format reward inside a tag."""
    tagged = F.concat(F.lit("<tool_call_answer>"), "text", F.lit("</tool_call_answer>"))
    return _written(t).select(
        "event_id", F.try_parse_json("text").isNotNull().alias("strict"), calls.relaxed_json(F.col("text")).isNotNull().alias("lenient"), F.round(calls.format_reward(tagged), 6).alias("reward")
    )


@query(r"""SELECT template, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(regexp_replace(props, '\[[^\]]*\]', '<LIST>', 'g'), '"[^"]*"|''[^'']*''', '<STR>', 'g'), '-?\b[0-9]+(?:\.[0-9]+)?\b', '<NUM>', 'g') AS template FROM events) GROUP BY 1""")
def template_normalize(t: Tables) -> DataFrame:
    """Texts by their templates."""
    return t.events.groupBy(text.template(F.col("props")).alias("template")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, coalesce(value <> floor(value) AND abs(round(value, 3) - value) < 1e-9, false) AS strict9, coalesce(abs(round(value, 3) - value) < 1e-6, false) AS loose6, coalesce(abs(round(value, 3) - value) < 1e-3, false) AS abs3,
  coalesce(abs(round(value, 3) - value) <= 1e-6 * greatest(abs(value), abs(round(value, 3)), 1.0), false) AS rel6,
  coalesce(abs(round(value, 3) - value) < power(10.0, -CASE WHEN value = floor(value) THEN 0 ELSE length(regexp_extract(CAST(value AS VARCHAR), '[.]([0-9]+)$', 1)) END) / 2, false) AS places FROM events""")
def value_match(t: Tables) -> DataFrame:
    """Each equality policy on every value and its rounded form: whole numbers are written without a point, where ``strict9`` goes by the text, and nulls never match."""
    value = F.col("value")
    written = F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    rows = t.events.select("event_id", F.round("value", 3).cast("string").alias("a"), written.alias("b"))
    return rows.select("event_id", *[scoring.value_match(F.col("a"), F.col("b"), p).alias(p) for p in ("strict9", "loose6", "abs3", "rel6", "places")])


@query("""WITH p AS (SELECT user_id, count_if(event_type <> 'error') * 1.0 / count(*) AS p FROM events GROUP BY 1)
SELECT user_id, round(CASE WHEN p < 1.0 / 8 THEN 0.0 ELSE exp(-power(greatest(0.25 - p, p - 0.75, 0.0), 2) / (2 * 0.12 * 0.12)) END, 8) AS reward FROM p""")
def bandpass_difficulty(t: Tables) -> DataFrame:
    """Flat top between a quarter and three quarters."""
    p = F.count_if(F.col("event_type") != "error") / F.count("*")
    return t.events.groupBy("user_id").agg(p.alias("p")).select("user_id", F.round(scoring.bandpass(F.col("p"), 8), 8).alias("reward"))


@query()
def call_accuracy(t: Tables) -> DataFrame:
    """Greedy call matching with name, keys and values; tests hold it against a loop."""
    call = F.struct(F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("value"))
    whole = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(*LINE_ORDER, call.alias("call")))), lambda x: x["call"]).alias("calls"))
    half = F.ceil(F.size("calls") / 2).cast("int")
    pairs = whole.select("l_orderkey", F.slice("calls", 1, half).alias("gold"), F.slice("calls", half + 1, F.size("calls")).alias("pred"))

    def score(g: Column, p: Column) -> Column:
        return scoring.call_score(g["name"] == p["name"], F.lit(1), F.lit(1), F.lit(1), (g["value"] == p["value"]).cast("int"))

    return pairs.select("l_orderkey", F.round(scoring.greedy_assignment(F.col("gold"), F.col("pred"), score), 9).alias("accuracy"))


@query("""WITH c AS (SELECT l_orderkey, bool_or(l_returnflag = 'A') AS final, count_if(l_discount < 0.09) * 1.0 / count(*) AS executable, count_if(l_linestatus = 'O') * 1.0 / count(*) AS complete,
  count_if(l_tax < 0.08) * 1.0 / count(*) AS refs, count_if(l_returnflag <> 'R') * 1.0 / count(*) AS gold, greatest(count(*) - 4, 0) AS extra, greatest(3 - count(*), 0) AS missing FROM lineitem GROUP BY 1),
s AS (SELECT *, greatest(0, least(1, 0.35 * CAST(final AS INTEGER) + 0.15 * executable + 0.20 * complete + 0.10 * refs + 0.20 * gold)) - CASE WHEN final THEN least(0.10, 0.02 * extra) ELSE 0 END - least(0.40, 0.10 * missing) AS x FROM c),
k AS (SELECT *, least(x, CASE WHEN refs < 1 THEN 0.30 ELSE 9 END, CASE WHEN executable < 1 THEN 0.25 ELSE 9 END, CASE WHEN missing > 0 AND NOT final THEN 0.25 ELSE 9 END, CASE WHEN NOT final THEN 0.35 ELSE 9 END, CASE WHEN final AND gold < 0.5 THEN 0.55 ELSE 9 END) AS y FROM s)
SELECT l_orderkey, round(greatest(CASE WHEN executable = 1 AND final AND gold >= 0.75 THEN greatest(y, 0.70) ELSE y END, 0), 6) AS reward FROM k""")
def cap_ladder(t: Tables) -> DataFrame:
    """Execution-aware reward with penalties, soft caps and a floor."""
    n, share = F.count("*"), lambda c: F.count_if(c) / F.count("*")
    c = t.lineitem.groupBy("l_orderkey").agg(
        F.bool_or(F.col("l_returnflag") == "A").alias("final"), share(F.col("l_discount") < 0.09).alias("executable"), share(F.col("l_linestatus") == "O").alias("complete"),
        share(F.col("l_tax") < 0.08).alias("refs"), share(F.col("l_returnflag") != "R").alias("gold"), F.greatest(n - 4, F.lit(0)).alias("extra"), F.greatest(3 - n, F.lit(0)).alias("missing"),
    )
    reward = scoring.execution_reward(*[F.col(x) for x in ("final", "executable", "complete", "refs", "gold")], F.lit(False), F.col("extra"), F.col("missing"))
    return c.select("l_orderkey", F.round(reward, 6).alias("reward"))


@query("""SELECT n, count(*) AS tasks, CAST(sum(prompt) AS BIGINT) AS prompt FROM (SELECT l_orderkey, count(*) AS n, CAST(floor((sum(length(l_returnflag || l_linestatus)) * 10 + 30) / 3) AS BIGINT) AS prompt FROM lineitem GROUP BY 1) GROUP BY 1""")
def token_budget(t: Tables) -> DataFrame:
    """Estimated prompt tokens by number of calls."""
    by = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), text.token_estimate(F.sum(F.length(F.concat("l_returnflag", "l_linestatus"))) * 10, 30).alias("prompt"))
    return by.groupBy("n").agg(F.count("*").alias("tasks"), F.sum("prompt").alias("prompt"))
