"""Resampling, replay, balanced picks and exact percentiles for groups of any size."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.names import unused
from tracelake.storage import materialize

# Poisson bootstrap

_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Chances that a Poisson variable of mean one is at most 0, 1, 2 and so on, beyond which a double sees nothing.
_AT_MOST = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def poisson_weights(clusters: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Weights of mean one, a row for each cluster and a column for each resample; they depend on these and the seed alone."""
    steps = np.arange(1, resamples + 1, dtype=np.uint64) * _GOLDEN
    z = (clusters.astype(np.int64).view(np.uint64) ^ np.uint64(seed))[:, None] * _MIX2 + steps[None, :]
    z ^= z >> np.uint64(30)
    z *= _MIX1
    z ^= z >> np.uint64(27)
    z *= _MIX2
    z ^= z >> np.uint64(31)
    return np.searchsorted(_AT_MOST, (z >> np.uint64(11)) * 2.0**-53, side="right").astype(np.float64)


def poisson_bootstrap(df: DataFrame, keys: Sequence[str], value: str, cluster: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Per key: n, mean, and std, low and high (2.5 and 97.5 %) of the mean over resamples of whole clusters.

    A resample weighs every cluster by a Poisson number of its own, which comes from a hash of the cluster, so
    all rows of a task are taken together, as often as each other, wherever they lie.  Rows become one sum and count a
    cluster, clusters a vector of ``resamples`` sums a task; no row is repeated.  Null values count for nothing, and null
    clusters are one.  A resample that takes nothing is left out.  Keys without values have n 0 and nulls.
    """
    of, total, n = (unused(df, c) for c in ("cluster_of", "total_of", "n_of"))
    small = df.groupBy(*keys, F.xxhash64(cluster).alias(of)).agg(F.sum(F.col(value).cast("double")).alias(total), F.count(value).alias(n))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.select(*keys).schema)

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, own in frame.groupby(list(keys), dropna=False, sort=False) if keys else [((), frame)]:
                sums, counts = np.zeros(resamples), np.zeros(resamples)
                for at in range(0, len(own), 512):
                    some = own.iloc[at : at + 512]
                    w = poisson_weights(some[of].to_numpy(), resamples, seed)
                    sums += some[total].fillna(0.0).to_numpy() @ w
                    counts += some[n].to_numpy(dtype=np.float64) @ w
                rows.append([*(None if k != k else k for k in key), float(own[total].sum()), int(own[n].sum()), sums, counts])
            yield pd.DataFrame(rows, columns=[*keys, "total", "n", "sums", "counts"])

    parts = materialize(small.mapInPandas(weigh, f"{kinds}{', ' if keys else ''}total double, n long, sums array<double>, counts array<double>"), "poisson_parts")
    plain = parts.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("total") / F.when(F.sum("n") > 0, F.sum("n"))).alias("mean"))
    at = parts.select(*keys, F.posexplode(F.arrays_zip("sums", "counts")).alias("b", "x")).groupBy(*keys, "b").agg(F.sum("x.sums").alias("s"), F.sum("x.counts").alias("c"))
    means = at.where("c > 0").select(*keys, (F.col("s") / F.col("c")).alias("m"))
    spread = means.groupBy(*keys).agg(F.stddev_pop("m").alias("std"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    if not keys:
        return plain.join(spread, F.lit(True), "left")  # one row each
    named = {k: unused(plain, f"{k}_again") for k in keys}
    met = F.lit(True)
    for k, name in named.items():
        met = met & F.col(k).eqNullSafe(F.col(name))
    return plain.join(spread.withColumnsRenamed(named), met, "left").select(*keys, "n", "mean", "std", "low", "high")


# Places in hash order, and draws onto them


def with_place(df: DataFrame, key: Column, by: str | None, name: str) -> DataFrame:
    """``df`` with ``name``, the place (from 0) of each row in the order of the MD5 of ``key`` within ``by``, and ``name_of``, how many rows there are.

    Places are prefix sums in two levels: 4,096 ranges of hashes are counted, the counts are summed up, and only rows of
    one range are numbered together, so no group is in one task.  Equal keys follow each other in any order; a null
    key comes first, a null ``by`` is a group.
    """
    hashed, group, size, start = (unused(df, c) for c in (f"{name}_hash", f"{name}_range", f"{name}_size", f"{name}_start"))
    h = F.coalesce(F.md5(key.cast("string")), F.lit("000"))
    own = F.col(by) if by else F.lit(0)
    rows = df.withColumns({hashed: h, group: F.substring(h, 1, 3), f"{name}_by": own})
    counts = rows.groupBy(f"{name}_by", group).agg(F.count("*").alias(size))
    before = Window.partitionBy(f"{name}_by").orderBy(group)
    ranges = counts.select(  # at most 4,096 rows for each value of ``by``
        F.col(f"{name}_by").alias("of_by"), F.col(group).alias("of_range"), (F.sum(size).over(before) - F.col(size)).alias(start), F.sum(size).over(Window.partitionBy(f"{name}_by")).alias(f"{name}_of")
    )
    met = rows.join(ranges, F.col(f"{name}_by").eqNullSafe(F.col("of_by")) & (F.col(group) == F.col("of_range")))
    nth = F.row_number().over(Window.partitionBy(f"{name}_by", group).orderBy(hashed))
    return met.withColumn(name, F.col(start) + nth - 1).drop("of_by", "of_range", start, group, hashed, f"{name}_by")


def draw_places(df: DataFrame, n: Column, size: Column, seed: int) -> DataFrame:
    """A row for each place that ``n`` draws with replacement from ``size`` places hit, with ``times``; ``df`` has the groups, and keeps its columns."""
    draws = df.select("*", size.alias("draw_size"), F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))).alias("draw"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in df.columns[:1]], F.col("draw").cast("string"))), 1, 12), 16, 10).cast("decimal(20,0)")
    place = F.call_function("div", u * F.col("draw_size").cast("decimal(17,0)"), F.lit(1 << 48).cast("decimal(16,0)"))
    return draws.withColumn("place", place).groupBy(*df.columns, "place").agg(F.count("*").alias("times"))


def replay(pool: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """(key, times): ``n`` draws with replacement from ``pool``, every row as likely; rows that no draw hits are left out.

    An empty pool gives nothing.  Repeated keys are rows of their own.
    """
    placed = with_place(pool.select(key), F.col(key), None, "at")
    one = placed.agg(F.count("*").alias("size")).select(F.lit("all").alias("of"), "size")
    hits = draw_places(one, F.when(F.col("size") > 0, F.lit(n)).otherwise(0).cast("long"), F.col("size"), seed).select("place", "times")
    return placed.join(hits, F.col("at") == F.col("place")).select(key, "times")


def replay_size(dataset: int, fraction: float) -> int:
    """Rows to replay beside ``dataset`` rows: a whole number, one at least."""
    return max(1, int(dataset * fraction))


def replay_weights(stages: Sequence[str], ratio: float) -> dict[str, float]:
    """The last stage has 1 - ``ratio``, the ones before share it alike; a single stage has all."""
    if len(stages) == 1:
        return {stages[0]: 1.0}
    return {s: ratio / (len(stages) - 1) for s in stages[:-1]} | {stages[-1]: 1.0 - ratio}


def mixed_pool(df: DataFrame, stage: str, key: str, weights: dict[str, float], seed: int = 42, tolerance: float = 0.01) -> DataFrame:
    """(stage, key, times): about as many rows as there are, mixed over stages by ``weights``.

    A stage gives round(weight * all rows) of its own, each once and in hash order if it has so many, else drawn with
    replacement.  Stages that ``weights`` does not name give nothing.  Raises if the mix that comes out is off by more than
    ``tolerance`` for a stage, as when one is empty.
    """
    total_weight = sum(weights.values())
    sizes = {r["s"]: r["n"] for r in df.where(F.col(stage).isin(*weights)).groupBy(F.col(stage).alias("s")).agg(F.count("*").alias("n")).collect()}  # a row per named stage
    everything = sum(sizes.values())
    wanted = {s: round(w / total_weight * everything) if sizes.get(s) else 0 for s, w in weights.items()}
    made = sum(wanted.values())
    off = [s for s, w in weights.items() if made and abs(wanted[s] / made - w / total_weight) > tolerance]
    if off or (everything and not made):
        raise ValueError(f"the mix is off for {', '.join(map(str, off)) or 'all stages'}")
    plan = df.sparkSession.createDataFrame([(s, n, sizes.get(s, 0)) for s, n in wanted.items()], "of string, wanted long, size long")
    placed = with_place(df.where(F.col(stage).isin(*weights)).select(stage, key), F.col(key), stage, "at").drop("at_of").join(F.broadcast(plan), F.col(stage) == F.col("of"))
    whole = placed.where((F.col("wanted") <= F.col("size")) & (F.col("at") < F.col("wanted"))).select(stage, key, F.lit(1).cast("long").alias("times"))
    hits = draw_places(plan.where("wanted > size").select("of", "wanted", "size"), F.col("wanted"), F.col("size"), seed).select(F.col("of").alias("hit_of"), "place", "times")
    drawn = placed.where("wanted > size").join(hits, (F.col("of") == F.col("hit_of")) & (F.col("at") == F.col("place"))).select(stage, key, "times")
    return whole.unionByName(drawn)


# Picks whose weights follow what was picked


def balanced_pick(df: DataFrame, group: str, key: str, n: int, share: float) -> DataFrame:
    """``n`` rows as drawn one by one, a group with c picks having the weight 1 / (1 + c); no group gives more than ``share`` of ``n`` (one at least).

    Draws by weight are a race: a group waits for its next pick an exponential time with its weight as rate, so
    its k-th one comes after the sum of k waits, E_1 + 2 E_2 + ... + k E_k, whatever the others do, and the n
    earliest arrivals of all groups are the n draws.  The rows of a group are taken in the order of their MD5,
    from which E = -ln(u) comes too; ``key`` is unique.  Null groups are one.
    """
    cap = max(1, int(n * share))
    hashed, nth, arrival = (unused(df, c) for c in ("race_hash", "race_nth", "race_arrival"))
    rows = df.withColumn(hashed, F.md5(F.col(key).cast("string")))
    own = Window.partitionBy(group).orderBy(hashed, key)
    rows = rows.withColumn(nth, F.row_number().over(own)).where(F.col(nth) <= cap)
    u = (F.conv(F.substring(hashed, 9, 8), 16, 10).cast("long") + 1) / 4294967297.0
    waited = F.sum(F.col(nth) * -F.log(u)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(arrival, waited).orderBy(arrival, key).limit(n).drop(hashed, nth, arrival)


# Exact percentiles


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], k: int = 400) -> DataFrame:
    """Per key: n and the interpolated percentile for each name in ``shares``, exact, without sorting a group whole.

    A KLL sketch of each group, merged map-side, brackets every wanted rank by values some ranks off; a second pass counts what lies
    below a bracket and ranks only what is inside.  Where a bracket misses its rank, which the sketch's error
    makes rare, it is opened to all values.  Null and NaN values do not count; groups without
    values have n 0 and nulls; null keys are a group.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("x"))
    known = rows.where("x is not null and not isnan(x)")
    n_of = rows.groupBy(*keys).agg(F.count_if(F.col("x").isNotNull() & ~F.isnan("x")).alias("n"))
    sketch = known.groupBy(*keys).agg(F.kll_sketch_agg_double("x", F.lit(k)).alias("sketch"))
    off = 4.0 / k  # some times the error of a rank
    quantile = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, q))))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q"), quantile(q - off).alias("low"), quantile(q + off).alias("high")) for name, q in shares.items()])

    def same(left: DataFrame, right: DataFrame, how: str = "inner", more: Column | None = None) -> DataFrame:
        named = {c: f"{c}__of" for c in keys}
        met = F.lit(True) if more is None else more
        for c, name in named.items():
            met = met & F.col(c).eqNullSafe(F.col(name))
        return left.join(right.withColumnsRenamed(named), met, how).drop(*named.values())

    brackets = materialize(same(sketch, n_of).select(*keys, "n", F.explode(wanted).alias("w")).select(*keys, "n", "w.*"), "percentile_brackets")

    def ranked(bounds: DataFrame) -> tuple[DataFrame, DataFrame]:
        """How often each value inside a bracket occurs, and how many values lie below it."""
        ends = bounds.groupBy(*keys).agg(F.collect_list(F.struct("name", "low", "high", "lower", "upper")).alias("ends"))  # one for each share
        side = same(known, ends).select(*keys, "x", F.explode("ends").alias("e")).select(*keys, "e.name", "e.lower", "e.upper", "x", (F.col("x") < F.col("e.low")).alias("under"), (F.col("x") > F.col("e.high")).alias("over"))
        below = side.where("under").groupBy(*keys, "name").agg(F.count("*").alias("below"))
        # Equal values are one row.
        inside = side.where("not under and not over").groupBy(*keys, "name", "lower", "upper", "x").agg(F.count("*").alias("times"))
        return inside, below

    at = brackets.withColumn("rank", (F.col("n") - 1) * F.col("q")).withColumns({"lower": F.floor("rank"), "upper": F.ceil("rank")})

    def settled(bounds: DataFrame) -> DataFrame:
        inside, below = ranked(bounds)
        tag = F.col("name") == F.col("name__b")
        met = same(inside, below.withColumnRenamed("name", "name__b"), "left", tag).drop("name__b").withColumn("below", F.coalesce("below", F.lit(0)))
        upto = F.sum("times").over(Window.partitionBy(*keys, "name").orderBy("x")) + F.col("below")
        hit = lambda r: F.max(F.when((F.col("upto") > F.col(r)) & (F.col("upto") - F.col("times") <= F.col(r)), F.col("x")))
        return met.withColumn("upto", upto).groupBy(*keys, "name").agg(hit("lower").alias("a"), hit("upper").alias("b"))

    found = materialize(settled(at), "percentile_found")
    done = same(at, found.withColumnRenamed("name", "name__f"), "left", F.col("name") == F.col("name__f")).drop("name__f")
    done = materialize(done, "percentile_done")
    missed = done.where("a is null or b is null").drop("a", "b")
    if not missed.isEmpty():
        wide = missed.withColumns({"low": F.lit(float("-inf")), "high": F.lit(float("inf"))})
        again = settled(wide).withColumnRenamed("name", "name__f")
        whole = same(missed, again, "left", F.col("name") == F.col("name__f")).drop("name__f")
        done = done.where("a is not null and b is not null").unionByName(whole)
    between = F.when(F.col("lower") == F.col("upper"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.col("lower")))
    each = done.select(*keys, "name", between.alias("p"))
    wide = each.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("p"))).alias(name) for name in shares])
    return same(n_of, wide, "left").select(*keys, "n", *shares)
