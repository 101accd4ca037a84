"""Column names that cannot clash."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` lacks, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
