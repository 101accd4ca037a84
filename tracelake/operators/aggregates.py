"""Aggregations: rollups, modes, distributions and their distances, agreement and paired tests.

Everything is partial-then-final aggregation; windows run over aggregated rows only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.names import unused


def counts_by_first_seen(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, value, n, rank): values by count, ties by which was seen first in ``order``."""
    first = F.min(F.struct(*order)).alias("first_at")
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), first)
    by = Window.partitionBy(*keys).orderBy(F.desc("n"), "first_at")
    return counted.withColumn("rank", F.row_number().over(by)).drop("first_at")


def mode(df: DataFrame, keys: list[str], value: str, order: list[str], alias: str) -> DataFrame:
    """(keys, alias): the commonest value, the first seen of several."""
    top = counts_by_first_seen(df, keys, value, order).where(F.col("rank") == 1)
    return top.select(*keys, F.col(value).alias(alias))


def with_share(df: DataFrame, n: str, alias: str = "share") -> DataFrame:
    """``df``, of aggregated rows, with each row's part of the total of ``n``."""
    return df.withColumn(alias, F.col(n) / F.sum(n).over(Window.partitionBy()))


def entropy(df: DataFrame, keys: list[str], value: str, alias: str = "entropy") -> DataFrame:
    """Shannon entropy in bits of ``value`` within ``keys``."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return counted.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias(alias))


def histogram(df: DataFrame, value: Column, bins: int = 10) -> DataFrame:
    """(bin, n) of values in [0, 1], the last bin closed."""
    at = F.least(F.floor(value * bins), F.lit(bins - 1)).cast("int")
    return df.where(value.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def two_distributions(df: DataFrame, arm: Column, value: str) -> DataFrame:
    """(value, a, b, p, q): counts of the value where ``arm`` is true and where not, and their shares, in one pass."""
    both = df.groupBy(value).agg(F.count_if(arm).alias("a"), F.count_if(~arm).alias("b"))
    total = Window.partitionBy()
    return both.withColumns({"p": F.col("a") / F.sum("a").over(total), "q": F.col("b") / F.sum("b").over(total)})


def distances(pairs: DataFrame, eps: float = 1e-9) -> DataFrame:
    """One row: l1 (on shares), tv (half of it), kl (both sides at least ``eps``), multiset_jaccard (on counts)."""
    p, q = F.greatest("p", F.lit(eps)), F.greatest("q", F.lit(eps))
    l1 = F.sum(F.abs(F.col("p") - F.col("q")))
    return pairs.agg(
        l1.alias("l1"), (l1 / 2).alias("tv"), F.sum(F.when(F.col("p") > 0, p * F.log(p / q)).otherwise(0.0)).alias("kl"),
        (F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b"))).alias("multiset_jaccard"),
    )


def pearson(df: DataFrame, keys: list[str], x: str, y: str, alias: str = "r") -> DataFrame:
    """Null under three pairs or without variance."""
    ok = (F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) >= 3) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return df.groupBy(*keys).agg(F.when(ok, F.corr(x, y)).alias(alias))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, alias: str = "rho") -> DataFrame:
    """Pearson of average ranks."""

    def ranked(c: str) -> Column:
        own = Window.partitionBy(*keys)
        return F.rank().over(own.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2.0

    ranks = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"__x": ranked(x), "__y": ranked(y)})
    return pearson(ranks, keys, "__x", "__y", alias)


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agreement, kappa); kappa is 1 if chance agreement is complete and so is agreement, else null there."""
    cells = df.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    agree = F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)
    sides = cells.select(F.col("x").alias("k"), F.col("n").alias("r"), F.lit(0).alias("c"), agree.alias("d")).unionByName(
        cells.select(F.col("y").alias("k"), F.lit(0).alias("r"), F.col("n").alias("c"), F.lit(0).alias("d"))
    )
    by = sides.groupBy("k").agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.sum("d").alias("d"))
    one = by.agg(F.sum("r").alias("n"), (F.sum("d") / F.sum("r")).alias("agreement"), (F.sum(F.col("r") * F.col("c")) / (F.sum("r") * F.sum("r"))).alias("chance"))
    kappa = F.when(F.col("chance") < 1, (F.col("agreement") - F.col("chance")) / (1 - F.col("chance"))).when(F.col("agreement") == 1, 1.0)
    return one.select("n", "agreement", kappa.alias("kappa"))


def overlap(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """2 x 2 outcome counts of two arms, and McNemar's corrected statistic (null without discordant pairs)."""
    gained, lost = F.count_if(b & ~a), F.count_if(a & ~b)
    chi2 = F.pow(F.greatest(F.abs(gained - lost) - 1, F.lit(0)).cast("double"), F.lit(2)) / (gained + lost)
    return df.agg(
        F.count("*").alias("n"), F.count_if(a & b).alias("both_win"), lost.alias("a_win_b_fail"), gained.alias("a_fail_b_win"),
        F.count_if(~a & ~b).alias("both_fail"), F.when(gained + lost > 0, chi2).alias("chi2"),
    )


def binomial_ci(successes: Column, n: Column) -> Column:
    """Normal interval at 95 %, clamped to [0, 1], as (low, high)."""
    p = successes / n
    half = 1.96 * F.sqrt(p * (1 - p) / n)
    return F.struct(F.greatest(F.lit(0.0), p - half).alias("low"), F.least(F.lit(1.0), p + half).alias("high"))


def macro_f1(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """Macro F1 of label arrays over the gold vocabulary; a label without true positives counts 0."""
    labelled = rows.select(F.array_distinct(gold).alias("g"), F.array_distinct(pred).alias("p"))
    label = F.explode(F.array_union("g", "p")).alias("label")
    flat = labelled.select(label, "g", "p").select("label", F.array_contains("g", F.col("label")).alias("in_g"), F.array_contains("p", F.col("label")).alias("in_p"))
    by = flat.groupBy("label").agg(F.count_if(F.col("in_g") & F.col("in_p")).alias("tp"), F.count_if("in_g").alias("ng"), F.count_if("in_p").alias("np"))
    known = by.where(F.col("ng") > 0)
    return known.agg(F.count("*").alias("labels"), F.avg(2.0 * F.col("tp") / (F.col("ng") + F.col("np"))).alias("macro_f1"))


def duplicate_stats(df: DataFrame, key: str) -> DataFrame:
    """(rows, distinct_keys, extra, largest): how many rows repeat a key."""
    by = df.groupBy(key).agg(F.count("*").alias("c"))
    extra = F.sum(F.when(F.col("c") > 1, F.col("c") - 1).otherwise(0))
    return by.agg(F.sum("c").alias("rows"), F.count("*").alias("distinct_keys"), extra.alias("extra"), F.max("c").alias("largest"))


def centroids(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """(keys, at, mean) per dimension: long form, so that any number of dimensions is one aggregation."""
    return df.select(*keys, F.posexplode(vec).alias("at", "x")).groupBy(*keys, "at").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def erfc_p_value(chi2: Column) -> Column:
    """Two-sided p of a chi-square statistic with one degree of freedom; Spark has no erfc."""
    @F.pandas_udf("double")
    def p_value(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or v != v else math.erfc(math.sqrt(v / 2)))

    return p_value(chi2)


def bootstrap_delta(df: DataFrame, a: str, b: str, resamples: int = 2000, seed: int = 7) -> DataFrame:
    """(mean, low, high) of the mean of b - a over resamples of the pairs; ``a`` and ``b`` are booleans.

    A pair's difference is -1, 0 or 1, so the three counts are all that a resample needs: they are
    aggregated, and each resample is a multinomial draw from them.  Nulls in either arm leave a pair out.
    """
    delta = F.col(b).cast("int") - F.col(a).cast("int")
    counts = df.agg(*[F.count_if(delta == d).alias(n) for d, n in ((-1, "lost"), (0, "same"), (1, "gained"))])

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lost, same, gained in frame.itertuples(index=False):
                n = lost + same + gained
                if n:
                    rows = np.random.default_rng(seed).multinomial(n, [lost / n, same / n, gained / n], size=resamples)
                    means = (rows[:, 2] - rows[:, 0]) / n
                    yield pd.DataFrame({"mean": [means.mean()], "low": [np.percentile(means, 2.5)], "high": [np.percentile(means, 97.5)]})

    return counts.mapInPandas(draw, "mean double, low double, high double")


def bootstrap_rate(df: DataFrame, keys: list[str], passed: Column, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Per key: n, rate, and mean, std, low and high of the rate over resamples, in percent with two places."""
    wins = unused(df, "wins")
    counts = df.groupBy(*keys).agg(F.count(passed).alias("n"), F.count_if(passed).alias(wins))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for n, k in zip(frame["n"], frame[wins], strict=True):
                # A resample of n outcomes of which k passed passes as often as a binomial draw.
                rates = np.random.default_rng(seed).binomial(n, k / n, size=resamples) / n if n else np.zeros(1)
                rows.append([k / n if n else None, *(round(100 * float(v), 2) for v in (rates.mean(), rates.std(), *np.percentile(rates, (2.5, 97.5))))])
            yield pd.concat([frame[keys + ["n"]].reset_index(drop=True), pd.DataFrame(rows, columns=["rate", "mean", "std", "low", "high"], dtype=float)], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema if f.name in keys)
    return counts.mapInPandas(draw, f"{kinds}, n long, rate double, mean double, std double, low double, high double")


def mean_in_order(value: Column, *order: Column) -> Column:
    """Mean of the values that are not null, added one by one in ``order``, so that it does not depend on tasks; null without any.

    A group's values are collected, so groups are to be small.
    """
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], value.cast("double").alias("v")))))
    return F.when(F.count(value) > 0, F.aggregate(rows, F.lit(0.0), lambda total, x: total + x["v"]) / F.nullif(F.count(value), F.lit(0)))
