"""Parsing and normalization as column expressions: all inside code generation, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_last(text: Column, tag: str) -> Column:
    """Content of the last ``<tag>..</tag>``, any case, across lines; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), 1), F.lit(-1))


def tag_first(text: Column, tag: str) -> Column:
    """Content of the first such tag; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), 1), F.lit(1))


def tag_or_rest(text: Column, tag: str, needs: str = "[") -> Column:
    """Content of the last tag; without a closing one, what follows the last opening one if it holds ``needs``."""
    rest = F.substring_index(text, f"<{tag}>", -1)
    opened = F.instr(text, f"<{tag}>") > 0
    return F.coalesce(tag_last(text, tag), F.when(opened & (F.instr(rest, needs) > 0), rest))


def mask_digits(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), "[0-9]", "0")


def template(text: Column) -> Column:
    """Lists, strings and numbers by their kinds, in that order."""
    out = F.regexp_replace(text, r"\[[^\]]*\]", "<LIST>")
    out = F.regexp_replace(out, "\"[^\"]*\"|'[^']*'", "<STR>")
    return F.regexp_replace(out, r"-?\b[0-9]+(?:\.[0-9]+)?\b", "<NUM>")


def squash(text: Column) -> Column:
    """Lower case, marks gone, white space single."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def fingerprint(*parts: Column) -> Column:
    """sha1 of parts joined by a bar; null counts as empty."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def close_json(text: Column) -> Column:
    """Truncated JSON with the missing braces and then brackets appended."""
    missing = lambda a, b: F.greatest(F.regexp_count(text, F.lit(a)) - F.regexp_count(text, F.lit(b)), F.lit(0))
    return F.concat(text, F.repeat(F.lit("}"), missing(r"\{", r"\}")), F.repeat(F.lit("]"), missing(r"\[", r"\]")))


def references(text: Column) -> Column:
    """Positions n of values that are wholly ``$varN.field$`` or ``$var_N.field$``, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(r"\"\$var_?([0-9]+)\.[A-Za-z0-9_]+\$\""), 1)
    return F.transform(found, lambda x: x.cast("int"))


def word_ngrams(words: Column, n: int) -> Column:
    """Neighbouring ``n`` elements of an array, joined by '>'; none if it is shorter."""
    at = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, n), ">"))).otherwise(F.array().cast("array<string>"))


def token_estimate(chars: Column, overhead: int = 0) -> Column:
    return F.floor((chars + overhead) / 3).cast("long")
