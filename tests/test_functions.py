"""Expressions and operators on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from tracelake.functions import calls, scoring, text
from tracelake.operators import aggregates, curation, windows
from tracelake.operators.components import connected_components


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tags(spark):
    s = F.lit("a <t>1</t> <T x='y'>2\n3</T> <t>")
    assert one(spark, text.tag_last(s, "t")) == "2\n3"
    assert one(spark, text.tag_first(s, "t")) == "1"
    assert one(spark, text.tag_first(F.lit("none"), "t")) is None
    assert one(spark, text.tag_or_rest(F.lit("x <t>[1, 2"), "t")) == "[1, 2"


def test_relaxed_json(spark):
    get = lambda s: one(spark, F.try_variant_get(calls.relaxed_json(F.lit(s)), "$.a", "string"))
    assert get('{"a": 1}') == "1"
    assert get("```json\n{'a': None, 'b': True}\n```") is None
    assert get("{'a': True}") == "true"
    assert get('{"a": "..."}') is None
    assert one(spark, text.close_json(F.lit('[{"a": 1'))) == '[{"a": 1}]'


def test_templates(spark):
    assert one(spark, text.template(F.lit("add [1, 2] to 'x' and 3.5"))) == "add <LIST> to <STR> and <NUM>"
    assert one(spark, text.mask_digits(F.lit(" Room  101 "))) == "room 000"
    assert one(spark, text.references(F.lit('{"a": "$var1.result$", "b": "see $var2.x$"}'))) == [1]


@pytest.mark.parametrize(
    ("policy", "a", "b", "same"),
    [
        ("strict9", "5", "5.0", False), ("strict9", "5.00", "5.0", True), ("strict9", "a b", "ab", True), ("loose6", "5", "5.0000001", True),
        ("loose6", "Paris.", "paris", True), ("abs3", "1.0004", "1", True), ("rel6", "1000000.5", "1000000", True), ("places", "3.14159", "3.14", True), ("places", "3.2", "3.14", False),
    ],
)
def test_value_policies(spark, policy, a, b, same):
    assert one(spark, scoring.value_match(F.lit(a), F.lit(b), policy)) is same


def test_returns_and_depth(spark):
    g = one(spark, scoring.suffix_returns(F.array(F.lit(1.0), F.lit(2.0)), 0.5, F.lit(4.0), 0.5))
    assert g == [1 + 0.5 * (2 + 0.5 * 2.0), 2 + 0.5 * 2.0]
    refs = F.array(F.array().cast("array<int>"), F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)), F.array(F.lit(9)))
    assert one(spark, scoring.chain_depth(refs)) == 3


def test_bandpass(spark):
    assert one(spark, scoring.bandpass(F.lit(0.5), 8)) == 1.0
    assert one(spark, scoring.bandpass(F.lit(0.1), 8)) == 0.0
    assert math.isclose(one(spark, scoring.bandpass(F.lit(0.87), 8)), math.exp(-0.5), rel_tol=1e-9)


def test_execution_reward(spark):
    reward = lambda **k: one(spark, scoring.execution_reward(*[F.lit(k.get(n, d)) for n, d in (("final", True), ("ex", 1.0), ("co", 1.0), ("re", 1.0), ("go", 1.0), ("failed", False), ("extra", 0), ("missing", 0))]))
    assert math.isclose(reward(), 1.0)
    assert reward(failed=True) == 0.0
    assert math.isclose(reward(extra=9), 0.9)
    assert math.isclose(reward(final=False), 0.35)
    assert math.isclose(reward(go=0.2), 0.55)


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 3), (10, 11), (11, 12), (12, 10), (7, None)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {5: 3, 4: 3, 3: 3, 10: 10, 11: 10, 12: 10} | {100 + i: 100 for i in range(41)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_mode_ties_take_the_first_seen(spark):
    df = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "a", 3), ("k", "b", 4), ("k", None, 0)], "k string, v string, o int")
    assert [tuple(r) for r in aggregates.mode(df, ["k"], "v", ["o"], "m").collect()] == [("k", "b")]


def test_advantage_needs_spread(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 1.0), (2, 3.0), (3, 5.0)], "g int, v double")
    got = sorted((r.g, round(r.advantage, 4)) for r in windows.position_advantage(df, ["g"], "v").collect())
    assert got == [(1, 0.0), (1, 0.0), (2, -1.0), (2, 1.0), (3, 0.0)]


def test_kappa_and_erfc(spark):
    df = spark.createDataFrame([(1, 1), (0, 0), (1, 0), (0, 0)], "a int, b int")
    r = aggregates.cohen_kappa(df, "a", "b").first()
    assert (r.n, r.agreement) == (4, 0.75)
    assert math.isclose(r.kappa, 0.5)
    assert math.isclose(one(spark, aggregates.erfc_p_value(F.lit(3.841458820694124))), 0.05, rel_tol=1e-6)


def test_largest_remainder(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "stratum string, n long")
    got = {r.stratum: r.alloc for r in curation.largest_remainder(df, 7).collect()}
    assert sum(got.values()) == 7
    assert got == {"a": 4, "b": 2, "c": 1}
