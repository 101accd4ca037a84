"""Column expressions that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else.

    Where the text is plain ASCII the built-in does that; other texts go through ``translate``.
    """
    plain = F.octet_length(c) == F.length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` lacks, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
