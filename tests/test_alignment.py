"""Questions and traces by hand."""

from pyspark.sql import functions as F

from tracelake.functions import alignment


def errors(spark, question, tools, math_only=False, markers=None):
    df = spark.createDataFrame([(question, tools, math_only, markers)], "q string, t array<string>, m boolean, k array<array<string>>")
    return df.select(alignment.alignment_errors(*map(F.col, "qtmk")).alias("e")).first().e


def test_phrases_within_phrases(spark):
    text = "aggregate the records in the dataset; xtablex recordfield"
    df = spark.createDataFrame([(text,), ("none",), ("",)], "t string")
    got = [set(r.p) for r in df.select(alignment.phrases_in(F.col("t"), [*alignment.LOOKUP_PHRASES, *alignment.RECORD_PHRASES]).alias("p")).collect()]
    assert got == [{"aggregate", "records in the dataset", "record", "dataset", "table", "field"}, set(), set()]


def test_rules(spark):
    long = "Please give me the sum of four and five"
    assert errors(spark, long, ["add"], True, [["sum", "add"]]) == []
    assert errors(spark, long, ["add"], True, [["multiply"], ["sum"], ["by 3"]]) == ["insufficient_operation_coverage:2"]
    assert errors(spark, None, None) == ["step_count_mismatch:empty", "incomplete_or_short_question"]
    assert errors(spark, "Then add B and look up nothing", ["add"]) == ["unresolved_placeholder"]
    assert errors(spark, "It is None of those that you want here", ["add"]) == ["unresolved_placeholder"]
    assert errors(spark, "It is none of those that you want here", ["add"]) == []
    assert errors(spark, long + " (", ["add"]) == ["incomplete_or_short_question"]
    assert errors(spark, "Use step 1 and step 2 for the sum of both", ["add"]) == ["step_count_mismatch:stage1_too_many_steps"]
    assert errors(spark, long, ["add", "add"]) == ["step_count_mismatch:stage2"] and errors(spark, "First, " + long, ["add", "add"]) == []
    assert errors(spark, "In step 2 " + long, ["add"] * 3) == ["step_count_mismatch:stage3"] and errors(spark, "A three-step task: " + long, ["add"] * 3) == []
    assert errors(spark, long, ["add"] * 4) == ["step_count_mismatch:stage4_n4"] and errors(spark, "In 7-step order, " + long, ["add"] * 7) == []
    assert errors(spark, "In five steps, " + long, ["add"] * 5) == [] and errors(spark, "In five steps, " + long, ["add"] * 6) == ["step_count_mismatch:stage4_n6"]
    assert errors(spark, "Step 3, step 3 and step 3: " + long, ["add"] * 4) == []
    assert errors(spark, "Sort the list and lookup the record of it", ["sort_list"]) == ["lookup_keywords_without_lookup_tools", "record_field_object_keywords_without_object_or_lookup_tools"]
    assert errors(spark, "Sort the list and lookup the record of it", ["select_record"]) == ["list_keywords_without_list_tools"]
    assert errors(spark, "Check whether the uppercase text is so", ["add"], True) == ["string_keywords_without_string_tools", "boolean_keywords_without_boolean_tools", "math_trace_with_non_math_wording"]
    assert errors(spark, "Check whether the uppercase text is so", ["contains_substring"]) == []


def test_best_assignment_with_and_without_unlike_best_columns(spark):
    """Against all permutations: rows whose best columns clash, ties and nulls among them."""
    import itertools
    import random

    from tracelake.functions import assignment

    rng, rows = random.Random(8), []
    for i in range(200):
        m = rng.randrange(1, 6)
        rows.append((i, [[rng.choice([None, 0.0, 0.25, 0.5, 1.0]) if i % 4 == 0 else rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(m)] for _ in range(rng.randrange(1, m + 1))]))
    got = {r.id: r.best for r in spark.createDataFrame(rows, "id long, s array<array<double>>").select("id", assignment.best_assignment(F.col("s")).alias("best")).collect()}
    for i, s in rows:
        sums = [sum(r[j] for r, j in zip(s, p)) for p in itertools.permutations(range(len(s[0])), len(s)) if all(r[j] is not None for r, j in zip(s, p))]
        assert got[i] == (max(sums) if sums else None)
