"""The official score of predicted traces: F1 of names and of slots, accuracy of aligned steps, wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CALLS = "array<struct<name:string,args:array<struct<k:string,v:string>>>>"


def closed_reference(value: Column) -> Column:
    """A value that begins like a reference and was cut off ends like one."""
    return F.when(value.startswith("$") & ~value.endswith("$"), F.concat(value, F.lit("$"))).otherwise(value)


def slot_labels(calls: Column, closed: bool) -> Column:
    """For each call ``k = v`` of each argument; null values as None."""
    value = lambda e: F.coalesce(closed_reference(e["v"]) if closed else e["v"], F.lit("None"))
    return F.transform(calls["args"], lambda args: F.transform(args, lambda e: F.concat(e["k"], F.lit(" = "), value(e))))


def step_texts(names: Column, labels: Column) -> Column:
    """For each call ``name(k = v, ...)`` with arguments in order of their text."""
    return F.zip_with(names, labels, lambda name, slots: F.concat(name, F.lit("("), F.array_join(F.sort_array(slots), ", "), F.lit(")")))


def aligned_steps(gold_names: Column, gold_steps: Column, pred_names: Column, pred_steps: Column) -> Column:
    """Share of equal steps of two lists of calls, each with all its arguments.

    Lists of equal length are compared place by place.  Else they are aligned by name: the longest beginning of the predicted
    names that is found in order within the gold ones stands against those, every other step against nothing.
    Two empty lists score 0.
    """
    n, m = F.size(gold_names), F.size(pred_names)
    by_place = F.size(F.filter(F.zip_with(gold_steps, pred_steps, lambda a, b: a == b), lambda x: x))
    zero = F.lit(0)
    start = F.struct(zero.alias("at"), zero.alias("found"), zero.alias("same"), F.lit(True).alias("on"))

    def step(s: Column, call: Column) -> Column:
        ahead = F.when(s["on"], F.array_position(F.slice(gold_names, s["at"] + 1, n), call["name"])).otherwise(0).cast("int")

        def moved(by: Column) -> Column:
            hit, equal = by > 0, (by > 0) & (F.get(gold_steps, s["at"] + by - 1) == call["step"])
            return F.struct(F.when(hit, s["at"] + by).otherwise(s["at"]).alias("at"), (s["found"] + hit.cast("int")).alias("found"), (s["same"] + F.coalesce(equal, F.lit(False)).cast("int")).alias("same"), hit.alias("on"))

        return F.get(F.transform(F.array(ahead), moved), F.lit(0))  # the search is made once

    calls = F.arrays_zip(pred_names.alias("name"), pred_steps.alias("step"))
    aligned = F.aggregate(calls, start, step, lambda s: s["same"] / (n + m - s["found"]))
    return F.when(n + m == 0, 0.0).when(n == m, by_place / n).otherwise(aligned)


def marks(rows: DataFrame) -> DataFrame:
    """(what, label, in_g, in_p, a, won): one of each row itself (``row``), of each name on either side (``name``) and of each argument label of that (``slot``); of several calls of a function the last counts.

    ``rows`` has (name_g, name_p, labels_g, labels_p, a, won), the names and labels of the calls of both sides.
    """
    back = [F.reverse(c).alias(c) for c in ("name_g", "name_p", "labels_g", "labels_p")]
    with_none = lambda labels: F.concat(F.array(F.lit(None).cast("string")), labels)
    named = rows.select("a", "won", *back).select("*", F.posexplode(with_none(F.array_union("name_g", "name_p"))).alias("i", "name"))
    empty = F.array().cast("array<string>")

    def last(side: str) -> Column:
        at = F.array_position(f"name_{side}", F.col("name"))
        return F.when(at > 0, F.get(f"labels_{side}", at - 1)).otherwise(empty)

    has = lambda side: F.array_contains(f"name_{side}", F.col("name"))
    slots = named.select("a", "won", "i", "name", has("g").alias("name_in_g"), has("p").alias("name_in_p"), last("g").alias("g"), last("p").alias("p"))
    each = slots.select("*", F.posexplode(with_none(F.coalesce(F.array_union("g", "p"), empty))).alias("j", "slot"))
    what = F.when(F.col("i") == 0, "row").when(F.col("j") == 0, "name").otherwise("slot")
    pick = lambda name, slot: F.when(F.col("j") == 0, name).otherwise(slot)
    held = lambda side: pick(F.col(f"name_in_{side}"), F.array_contains(side, F.col("slot")))
    return each.select(what.alias("what"), pick(F.col("name"), F.col("slot")).alias("label"), held("g").alias("in_g"), held("p").alias("in_p"), "a", "won")


def official_score(df: DataFrame, gold: str, pred: str, won: Column) -> DataFrame:
    """One row: n, f1_name, f1_slot with their precisions and recalls, partial (mean share of equal steps), full (share of rows with all), win_rate.

    Precision, recall and F1 are means over the labels that occur in ``gold``; a label without predictions has precision 0.
    Calls are struct(name, args of (k, v)), references already by the name of what made the value; null arrays are empty,
    a null ``won`` is none.  Without rows everything but n is null.  ``df`` is read once.
    """
    some = lambda c: F.coalesce(F.col(c).cast(_CALLS), F.array().cast(_CALLS))
    calls = df.select(some(gold).alias("g"), some(pred).alias("p"), F.coalesce(won, F.lit(False)).cast("double").alias("won"))
    # What is used more than once is a column, so that it is worked out once a row.
    calls = calls.select("won", F.col("g.name").alias("name_g"), slot_labels(F.col("g"), False).alias("labels_g"), F.col("p.name").alias("name_p"), slot_labels(F.col("p"), True).alias("labels_p"))
    steps = calls.select("*", step_texts(F.col("name_g"), F.col("labels_g")).alias("step_g"), step_texts(F.col("name_p"), F.col("labels_p")).alias("step_p"))
    rows = steps.withColumn("a", aligned_steps(*[F.col(c) for c in ("name_g", "step_g", "name_p", "step_p")]))
    by = marks(rows).groupBy("what", "label").agg(
        F.count("*").alias("n"), F.count("a").alias("walked"), F.sum("a").alias("a"), F.count_if(F.col("a") == 1).alias("full"), F.sum("won").alias("won"),
        F.count_if(F.col("in_g") & F.col("in_p")).alias("tp"), F.count_if("in_g").alias("ng"), F.count_if("in_p").alias("np"),
    )
    total = lambda c: F.sum(F.when(F.col("what") == "row", F.col(c)))
    mean = lambda what, c: F.avg(F.when((F.col("what") == what) & (F.col("ng") > 0), c))
    tp, ng, np = F.col("tp"), F.col("ng"), F.col("np")
    parts = {"precision": F.when(np > 0, tp / np).otherwise(0.0), "recall": tp / ng, "f1": 2.0 * tp / (ng + np)}
    return by.agg(
        F.coalesce(total("n"), F.lit(0)).alias("n"), (total("a") / total("walked")).alias("partial"), (total("full") / total("walked")).alias("full"), (total("won") / total("n")).alias("win_rate"),
        *[mean(what, c).alias(f"{part}_{what}") for what in ("name", "slot") for part, c in parts.items()],
    )


def references_in(arguments: Column) -> Column:
    """(call, field) of every reference in arguments, JSON text, at any depth of its lists and objects; a reference is a whole string value, keys are none.

    A reference is ``$var1$``, ``$var_1.field$`` and the like; the field is null if it names none.
    """
    found = F.regexp_extract_all(arguments, F.lit(r'(?<!\\)"\s*(\$var_?\d+(?:\.\w+)?\$)\s*"(?!\s*:)'))
    part = lambda r, i: F.nullif(F.regexp_extract(r, r"^\$var_?(\d+)(?:\.(\w+))?\$$", i), F.lit(""))
    return F.transform(found, lambda r: F.struct(part(r, 1).cast("int").alias("call"), part(r, 2).alias("field")))
