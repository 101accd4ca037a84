"""Ordered operators.  Every order ends in a unique column, so that results do not depend on tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key; Spark prunes rows before the shuffle."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rank") <= k).drop("__rank")


def one_per_key(df: DataFrame, key: str, policy: str, score: str, passed: str, idx: str) -> DataFrame:
    """One row per key: ``best_score``, ``rollout_idx_0``, ``pass_first`` or ``mean_over_rollouts`` (key and mean only)."""
    if policy == "mean_over_rollouts":
        return df.groupBy(key).agg(F.avg(score).alias(score))
    orders = {
        "best_score": [F.col(score).desc_nulls_last(), F.col(idx)],
        "rollout_idx_0": [F.col(idx)],
        "pass_first": [F.col(passed).desc_nulls_last(), F.col(score).desc_nulls_last(), F.col(idx)],
    }
    return top_k(df, [key], orders[policy])


def position_advantage(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``mean``, ``std`` and ``advantage`` within ``keys``: 0 under two rows or without spread."""
    own = Window.partitionBy(*keys)
    out = df.withColumns({"mean": F.avg(value).over(own), "std": F.stddev_pop(value).over(own), "__n": F.count("*").over(own)})
    alive = (F.col("__n") >= 2) & (F.col("std") > 1e-9)
    return out.withColumn("advantage", F.when(alive, (F.col(value) - F.col("mean")) / (F.col("std") + 1e-8)).otherwise(0.0)).drop("__n")


def gains(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Difference to the row before, null for the first."""
    return df.withColumn("gain", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def plateau(df: DataFrame, keys: list[str], order: str, value: str, patience: int) -> DataFrame:
    """``best_before`` of the last ``patience`` rows and whether the value does not exceed it."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(-patience, -1)
    out = df.withColumn("best_before", F.max(value).over(before))
    return out.withColumn("plateau", F.coalesce(F.col(value) <= F.col("best_before"), F.lit(False)))


def count_buckets(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """``bucket`` of ``size`` rows each, in order within ``keys``."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("bucket", F.floor(at / size).cast("long"))


def renumber(df: DataFrame, keys: list[str], order: list[str], prefix: str, width: int = 6) -> DataFrame:
    """``new_id``: prefix and running number within ``keys``."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("new_id", F.concat(F.lit(prefix), F.lpad((at - 1).cast("string"), width, "0")))
