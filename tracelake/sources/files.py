"""Files of tasks, rollouts and reports, read and written as the data plane needs them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, strict: bool = True) -> DataFrame:
    """One object per line, empty lines skipped.  Strict: a bad line fails the read; else it is left out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def bad_lines(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """The lines that a tolerant read leaves out, as ``line`` beside what of the schema could be read.

    Spark refuses to answer from the corrupt column alone: keep another column with it, or write first.
    """
    wide = T.StructType([*schema.fields, T.StructField("line", T.StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "line").json(path)
    return rows.where("line is not null")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """A file that is one array; rows without a required field are placeholders and left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).dropna(subset=list(required) or None, how="any" if required else "all")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; quoted values may hold commas, quotes and line feeds."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def with_origin(df: DataFrame, pattern: str | None = None, names: Sequence[str] = ()) -> DataFrame:
    """``_file``, the file of each row, and a column for each group of ``pattern`` in its path."""
    out = df.withColumn("_file", F.input_file_name())
    return out.withColumns({n: F.nullif(F.regexp_extract("_file", pattern, i + 1), F.lit("")) for i, n in enumerate(names)}) if pattern else out


def resolve(df: DataFrame, roles: dict[str, Sequence[str]], required: Sequence[str] = ()) -> DataFrame:
    """A column per role: the first that is not null of those aliases that exist; raises if a required role has none."""
    have = set(df.columns)
    found = {role: [F.col(f"`{a}`") for a in aliases if a in have] for role, aliases in roles.items()}
    if lacking := [r for r in required if not found.get(r)]:
        raise ValueError(f"no column for {', '.join(lacking)} among {', '.join(df.columns)}")
    return df.select(*[(F.coalesce(*cols) if cols else F.lit(None)).alias(role) for role, cols in found.items()])


def _flat(field: T.StructField) -> Column:
    nested = isinstance(field.dataType, T.StructType | T.ArrayType | T.MapType)
    return (F.to_json(F.col(f"`{field.name}`")) if nested else F.col(f"`{field.name}`")).alias(field.name.strip().replace("\n", " ").replace(",", "_"))


def write_csv(df: DataFrame, path: str) -> None:
    """Everything quoted, nested values as JSON, names without commas and line feeds: any reader gets back what went in."""
    df.select(*[_flat(f) for f in df.schema.fields]).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line; Spark's commit makes it whole or absent."""
    df.write.json(path)


def manifest(df: DataFrame, key: str) -> DataFrame:
    """(rows, digest): a digest of the content that does not depend on how rows are dealt out."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])), 256)
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(F.col(key), part.alias("part")).agg(F.count("*").alias("rows"), F.sum("part").cast("string").alias("digest"))


def from_cache(df: DataFrame, cache: DataFrame, key: str, order: str) -> DataFrame:
    """``df`` with the last cached row of each key; what is not cached has nulls."""
    last = cache.groupBy(key).agg(F.max_by(F.struct(*[c for c in cache.columns if c != key]), order).alias("cached"))
    return df.join(last, key, "left")
