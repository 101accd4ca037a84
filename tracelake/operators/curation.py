"""Selecting rows: decontamination, near duplicates, quotas, strata and splits."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.names import unused
from tracelake.operators.resampling import with_place
from tracelake.storage import materialize


def without_overlap(df: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    """Rows that share none of several keys with ``others``: one anti-join each, not one on a disjunction."""
    for key in keys:
        df = df.join(others.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return df


#: Tokens up to which sets are looked up by combinations, and combinations of a set for one size of partner.
_SMALL, _COMBINATIONS = 32, 16


def _combinations(threshold: float) -> list[tuple[int, int, list[list[int]]]]:
    """(n, m, places) for sizes of small sets that can reach the threshold: of which tokens of the set of n its keys for sets of m are made.

    Two such sets have o tokens in common, so at least k of their first n - o + k and m - o + k, whatever k is; all
    combinations of k of these are keys.  The larger k, the fewer sets share a key and the more keys there are.
    """
    out = []
    for n in range(1, _SMALL + 1):
        for m in range(1, _SMALL + 1):
            # A little less than the bound, so that rounding never loses a pair.
            o = max(1, math.ceil((n + m) * threshold / (1 + threshold) - 1e-6))
            if o <= min(n, m):
                k = max((k for k in range(1, o + 1) if math.comb(max(n, m) - o + k, k) <= _COMBINATIONS), default=1)
                out.append((n, m, [list(c) for c in itertools.combinations(range(n - o + k), k)]))
    return out


def _class_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(x, y, jaccard) with x < y of different sets (class, tokens) with token Jaccard of ``threshold`` or more."""
    flat = sets.select("class", F.explode("tokens").alias("t"))
    df = flat.groupBy("t").agg(F.count("*").alias("df"))
    order = F.array_sort(F.collect_list(F.struct("df", "t")))
    sorted_sets = flat.join(df, "t").groupBy("class").agg(F.transform(order, lambda x: x["t"]).alias("tokens"))
    sorted_sets = materialize(sorted_sets.withColumn("n", F.size("tokens")), "token_sets")  # read five times
    n, small = F.col("n"), F.col("n") <= _SMALL
    plan = sets.sparkSession.createDataFrame(_combinations(threshold), "n int, m int, places array<array<int>>")  # of fixed size
    chosen = sorted_sets.where(small).join(F.broadcast(plan), "n").select("class", "n", "m", "tokens", F.explode("places").alias("at"))
    keyed = chosen.select("class", "n", "m", F.xxhash64(F.least("n", "m"), F.greatest("n", "m"), F.transform("at", lambda i: F.get("tokens", i))).alias("k"))
    keyed = materialize(keyed, "token_keys")
    # A set looks for partners of its own size and for smaller ones.
    one, other = keyed.where("n >= m").select(F.col("class").alias("a"), "n", "m", "k"), keyed.where("m >= n").select(F.col("class").alias("b"), F.col("n").alias("m"), F.col("m").alias("n"), "k")
    met = one.join(other, ["k", "n", "m"]).where((F.col("n") > F.col("m")) | (F.col("a") < F.col("b"))).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    # Pairs with a larger set share one of their first n - ceil(t n) + 1 tokens.
    heads = sorted_sets.where(n >= _SMALL * threshold).select("class", "n", F.explode(F.slice("tokens", 1, (n - F.ceil(n * threshold - 1e-6) + 1).cast("int"))).alias("t"))
    left, right = (heads.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), "t") for c in ("x", "y"))
    # Sets of too unlike sizes cannot reach the threshold.
    sized = (F.col("nx") >= threshold * F.col("ny") - 1e-9) & (F.col("ny") >= threshold * F.col("nx") - 1e-9)
    large = left.join(right, "t").where((F.col("x") < F.col("y")) & sized & (F.greatest("nx", "ny") > _SMALL)).select("x", "y")
    pairs = met.unionByName(large).distinct()
    tx, ty = (sorted_sets.select(F.col("class").alias(c), F.col("tokens").alias(f"t{c}")) for c in ("x", "y"))
    common = F.size(F.array_intersect("tx", "ty"))
    scored = pairs.join(tx, "x").join(ty, "y").withColumn("jaccard", common / (F.size("tx") + F.size("ty") - common))
    return scored.where(F.col("jaccard") >= threshold).select("x", "y", "jaccard")


def token_pairs(a: DataFrame, b: DataFrame, threshold: float, ordered: bool = False) -> DataFrame:
    """(a_id, b_id, jaccard) of pairs (id, tokens) with token Jaccard of ``threshold`` or more, exactly.

    Equal sets are one class before anything is compared.  Prefix filter: with tokens sorted from rare to common,
    two sets that reach the threshold share some of their first tokens, so only combinations of these are
    joined on.  Pairs of classes become pairs of ids at the end.  ``ordered`` keeps pairs with a_id < b_id, for a self-join.
    """
    side = lambda df, k: df.select("id", "tokens", F.lit(k).alias("side"))
    both = side(a, 0) if ordered else side(a, 0).unionByName(side(b, 1))
    sets = both.select("side", "id", F.array_sort(F.array_distinct(F.filter("tokens", lambda x: x.isNotNull()))).alias("tokens")).where(F.size("tokens") > 0)
    named = F.sha2(F.to_json(F.struct(F.transform("tokens", lambda x: x.cast("string")).alias("t"))), 256)
    members = materialize(sets.withColumn("class", named), "token_members")
    near = _class_pairs(members.groupBy("class").agg(F.first("tokens").alias("tokens")), threshold)
    ours = members.where(F.col("side") == 0).select(F.col("class").alias("x"), F.col("id").alias("a_id"))
    theirs = members.where(F.col("side") == (0 if ordered else 1)).select(F.col("class").alias("y"), F.col("id").alias("b_id"))
    kept = F.col("a_id") < F.col("b_id") if ordered else F.lit(True)
    equal = ours.join(theirs, F.col("x") == F.col("y")).where(kept & F.lit(threshold <= 1)).select("a_id", "b_id", F.lit(1.0).alias("jaccard"))
    links = materialize(near, "token_links")
    links = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"), "jaccard"))
    return equal.unionByName(links.join(ours, "x").join(theirs, "y").where(kept).select("a_id", "b_id", "jaccard"))


def seed_pairs(docs: DataFrame, seeds: DataFrame, threshold: float, small: int = 1_000_000) -> DataFrame:
    """(a_id, b_id, jaccard) of pairs (id, tokens) of a document and a seed with token Jaccard of ``threshold`` or more, exactly.

    For seeds that are shorter than most documents.  A pair that reaches the threshold t has
    t / (1 + t) of both sizes in common, so one of the seed's first n - that + 1 tokens, from rare to
    common; the longer the document, the fewer these are.  Seeds of ``small`` tokens or fewer in all
    are broadcast.
    """
    sets = lambda df, id_, ts: df.select(F.col("id").alias(id_), F.array_distinct("tokens").alias(ts)).where(F.size(ts) > 0)
    a, b = sets(docs, "a_id", "ta"), materialize(sets(seeds, "b_id", "tb"), "seed_sets")
    words = a.select("a_id", F.size("ta").alias("na"), F.explode("ta").alias("t"))
    vocabulary = b.select(F.explode("tb").alias("t"))
    held = F.broadcast if vocabulary.count() <= small else (lambda df: df)
    df = words.join(held(vocabulary.distinct()), "t", "left_semi").groupBy("t").agg(F.count("*").alias("df"))
    own = b.select("b_id", F.size("tb").alias("nb"), F.explode("tb").alias("t")).join(df, "t")  # a token of no document is in no common part
    order = F.row_number().over(Window.partitionBy("b_id").orderBy("df", "t"))
    ranked = materialize(own.withColumn("at", order), "seed_tokens")
    # A little less than the bound, so that rounding never loses a pair.
    least = F.ceil((F.col("na") + F.col("nb")) * F.lit(threshold / (1 + threshold)) - 1e-6)
    met = words.join(held(ranked), "t").where(F.col("at") <= F.col("nb") - least + 1)
    pairs = materialize(met.select("a_id", "b_id").distinct(), "seed_pairs")
    common = F.size(F.array_intersect("ta", "tb"))
    scored = pairs.join(held(b), "b_id").join(a, "a_id").withColumn("jaccard", common / (F.size("ta") + F.size("tb") - common))
    return scored.where(F.col("jaccard") >= threshold).select("a_id", "b_id", "jaccard")


def largest_remainder(strata: DataFrame, total: int, n: str = "n", key: str = "stratum") -> DataFrame:
    """``alloc`` of ``total`` over strata in proportion to ``n``: floors, then one each by remainder, ties by key.

    Runs over a row per stratum.  No stratum gets more than it has.
    """
    whole, share, least = Window.partitionBy(), unused(strata, "share_of"), unused(strata, "floor_of")
    quota = F.col(n) * F.lit(total) / F.sum(n).over(whole)
    out = strata.withColumn(share, quota).withColumn(least, F.least(F.floor(share), F.col(n)))
    left = F.lit(total) - F.sum(least).over(whole)
    by = Window.partitionBy().orderBy(F.desc(F.col(share) - F.col(least)), F.col(key).cast("string"))
    got = F.col(least) + F.when((F.row_number().over(by) <= left) & (F.col(least) < F.col(n)), 1).otherwise(0)
    return out.withColumn("alloc", got.cast("long")).drop(share, least)


#: Strata up to which their table is broadcast.
_FEW = 200_000


def take_per_stratum(df: DataFrame, strata: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first ``alloc`` rows of each stratum."""
    at, most = unused(df, "rank_at"), unused(df, "alloc_of")
    ranked = df.withColumn(at, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    wanted = strata.select(key, F.col("alloc").alias(most))
    return ranked.join(F.broadcast(wanted) if wanted.count() <= _FEW else wanted, key).where(F.col(at) <= F.col(most)).drop(at, most)


def round_robin(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """One row of each stratum in turn until there are ``n``: rank within the stratum, then the stratum."""
    at = unused(df, "rank_at")
    # No stratum gives more than ``n``.
    ranked = df.withColumn(at, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(at) <= n)
    return ranked.orderBy(at, key).limit(n).drop(at)


def hash_split(df: DataFrame, stratum: str, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """``split`` 'val' for max(1, round(n * fraction)) rows of each stratum in hash order, else 'train'; places come from prefix sums, so no stratum is one task."""
    at = unused(df, "split_at")
    placed = with_place(df, F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), stratum, at)
    size = F.greatest(F.lit(1), F.round(F.col(f"{at}_of") * F.lit(fraction)).cast("long"))
    return placed.withColumn("split", F.when(F.col(at) < size, "val").otherwise("train")).drop(at, f"{at}_of")


def tier_merge(df: DataFrame, tier: str, priority: dict[str, int], caps: dict[str, int], order: list[Column]) -> DataFrame:
    """``place`` of every row: tiers by priority with their caps first, then what the caps held back."""
    rank = F.row_number().over(Window.partitionBy(tier).orderBy(*order))
    level = F.coalesce(*[F.when(F.col(tier) == t, F.lit(p)) for t, p in priority.items()], F.lit(len(priority)))
    over = F.coalesce(*[F.when(F.col(tier) == t, rank > c) for t, c in caps.items()], F.lit(False))
    return df.withColumns({"held_back": over, "level": level})


def first_seen_by_either(rows: DataFrame, order: str, key_a: str, key_b: str) -> DataFrame:
    """Rows kept by the sequential rule 'drop a row if either key was seen on a kept row before'.

    Whether a row stays depends on which earlier rows did, so rounds decide rows whose earlier rivals
    are all decided: in each, a row without undecided or kept earlier rivals is kept, and rows with a
    kept earlier rival go.  Chains of rivals are short, and rounds shrink the open set.
    """
    todo = materialize(rows.select(order, key_a, key_b), "seen_open")
    kept = None
    while not todo.isEmpty():
        a, b = Window.partitionBy(key_a), Window.partitionBy(key_b)
        first = (F.col(order) == F.min(order).over(a)) & (F.col(order) == F.min(order).over(b))
        is_first = unused(todo, "is_first")
        now = materialize(todo.withColumn(is_first, first), "seen_round")
        won = now.where(is_first).select(order, key_a, key_b)
        kept = won if kept is None else kept.unionByName(won)
        rest = now.where(~F.col(is_first)).drop(is_first)
        todo = materialize(without_overlap(rest, won, key_a, key_b), "seen_open").select(order, key_a, key_b)
    return kept if kept is not None else rows.select(order, key_a, key_b)
