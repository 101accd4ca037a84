"""Whether a question says what its trace does: phrase lists matched in one pass, then rules on sets."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrases of each kind of operation, the tools that may answer for them, and what a finished question does not hold.
LOOKUP_PHRASES = ("lookup", "table", "dataset", "aggregate", "records in the dataset")
RECORD_PHRASES = ("record", "field", "object")
LIST_PHRASES = ("filter the list", "sort the list", "take item", "list from step", "list produced")
STRING_PHRASES = ("join the strings", "uppercase", "lowercase", "characters in the result", "convert the result")
BOOLEAN_PHRASES = ("logical and", "logical or", "check whether")
OTHER_THAN_MATH = ("filter the list", "sort the list", "uppercase", "lowercase", "join the strings", "logical and", "logical or", "create an object", "read field")
LOOKUP_TOOLS = ("lookup_by_key", "select_record", "count_records", "aggregate_field")
OBJECT_TOOLS = ("make_object", "get_field", "merge_objects", "update_field", "nested_get", "select_record")
LIST_TOOLS = ("get_item", "list_length", "filter_greater_than", "filter_equals", "join_list", "sort_list", "count_items")
STRING_TOOLS = ("concat", "lowercase", "uppercase", "extract_prefix", "extract_suffix", "contains_substring", "string_length")
BOOLEAN_TOOLS = ("greater_than", "less_than", "equals", "contains", "contains_substring", "and_bool", "or_bool")
UNRESOLVED = r"(?i:\badd B\b|\bmultiply by B\b|[{}<>]|\bTODO\b|\bnull\b|\bprefix\b|cluster=|long_chain__|synthetic_gap)|\bNone\b"
UNFINISHED = r"(?i:[(,]$|^Separately compute\s*$|^Evaluate two small additions\s*$)"
SHORTEST = 25
TWO_STEPS = ("two steps", "2 steps", "first,", "first ", "next,", " then,", "finally,", "(1)", "(2)", "step 1:", "step 2:", "complete two steps", "step one", "step two", "two operations", "operations in order")
THREE_STEPS = ("three steps", "3 steps", "step 1:", "step 2:", "step 3:", "follow three steps", "three-step", "a three-step task")
MANY_STEPS = {4: ("four steps", "4 steps", "four step"), 5: ("five steps", "5 steps", "five step"), 6: ("six steps", "6 steps", "six step")}


def phrases_in(text: Column, phrases: Sequence[str]) -> Column:
    """Those of ``phrases`` that stand in ``text``, whatever is around them, in one pass over it; text and phrases are in lower case.

    The longest phrase that begins at a place is found there; the ones that it begins with go with it.
    """
    known = sorted(set(phrases), key=len, reverse=True)
    longest = F.regexp_extract_all(text, F.lit("(?=(" + "|".join(map(re.escape, known)) + "))"))
    begins = {p: [q for q in known if p.startswith(q)] for p in known}
    if all(len(own) == 1 for own in begins.values()):
        return F.array_distinct(longest)
    table = F.create_map(*[x for p, own in begins.items() for x in (F.lit(p), F.array(*map(F.lit, own)))])
    return F.array_distinct(F.flatten(F.transform(longest, lambda p: F.element_at(table, p))))


def _any_of(found: Column, phrases: Sequence[str]) -> Column:
    return F.arrays_overlap(found, F.array(*map(F.lit, phrases)))


def _step_error(asked: Column, found: Column, n: Column) -> Column:
    named = F.regexp_extract_all(asked, F.lit(r"step (\d+)"))
    explicit, spoken = F.size(F.array_distinct(named)), F.size(F.split(asked, "step ")) - 1
    many = F.lit(False)
    for count, words in MANY_STEPS.items():
        many = many | ((n == count) & _any_of(found, words))
    enough = (explicit >= n - 1) | many | F.contains(asked, F.concat(n.cast("string"), F.lit("-step"))) | (spoken >= n - 1)
    return (
        F.when(n <= 0, "step_count_mismatch:empty").when((n == 1) & (explicit > 1), "step_count_mismatch:stage1_too_many_steps")
        .when((n == 2) & (explicit < 1) & ~_any_of(found, TWO_STEPS), "step_count_mismatch:stage2")
        .when((n == 3) & (explicit < 2) & ~_any_of(found, THREE_STEPS), "step_count_mismatch:stage3")
        .when((n >= 4) & ~enough, F.concat(F.lit("step_count_mismatch:stage4_n"), n.cast("string")))
    )


def alignment_errors(question: Column, tools: Column, math_only: Column, markers: Column) -> Column:
    """All that a question gets wrong about its trace, an array in order, empty if nothing.

    ``tools`` are the names of the trace's calls in order, ``math_only`` says whether all of them are of the math family,
    and ``markers`` has, for each call, phrases in lower case of which the question must have one.  Null questions are empty
    ones, null arrays too.  Whether constants and references in arguments are worded rightly is not looked at.
    """
    text, names = F.coalesce(question, F.lit("")), F.coalesce(tools, F.array().cast("array<string>"))
    asked = F.lower(text)
    every = [*LOOKUP_PHRASES, *RECORD_PHRASES, *LIST_PHRASES, *STRING_PHRASES, *BOOLEAN_PHRASES, *OTHER_THAN_MATH, *TWO_STEPS, *THREE_STEPS, *(w for ws in MANY_STEPS.values() for w in ws)]
    bare = F.trim(text)

    def reasons(found: Column) -> Column:
        lacks = lambda some: ~F.arrays_overlap(names, F.array(*map(F.lit, some)))
        wants = lambda words, some, reason: F.when(_any_of(found, words) & lacks(some), reason)
        covered = lambda words: F.exists(words, lambda w: (w != "") & F.contains(asked, w))
        missing = F.size(F.filter(F.coalesce(markers, F.array().cast("array<array<string>>")), lambda words: ~F.coalesce(covered(words), F.lit(False))))
        checks = [
            F.when(text.rlike(UNRESOLVED), "unresolved_placeholder"), _step_error(asked, found, F.size(names)),
            F.when(missing > 0, F.concat(F.lit("insufficient_operation_coverage:"), missing.cast("string"))),
            F.when((F.length(bare) < SHORTEST) | bare.rlike(UNFINISHED), "incomplete_or_short_question"),
            wants(LOOKUP_PHRASES, LOOKUP_TOOLS, "lookup_keywords_without_lookup_tools"), wants(RECORD_PHRASES, [*OBJECT_TOOLS, *LOOKUP_TOOLS], "record_field_object_keywords_without_object_or_lookup_tools"),
            wants(LIST_PHRASES, LIST_TOOLS, "list_keywords_without_list_tools"), wants(STRING_PHRASES, STRING_TOOLS, "string_keywords_without_string_tools"),
            wants(BOOLEAN_PHRASES, BOOLEAN_TOOLS, "boolean_keywords_without_boolean_tools"),
            F.when(math_only & _any_of(found, [*LOOKUP_PHRASES, *OTHER_THAN_MATH]), "math_trace_with_non_math_wording"),
        ]
        return F.filter(F.array(*checks), lambda x: x.isNotNull())

    return F.get(F.transform(F.array(phrases_in(asked, every)), reasons), F.lit(0))
