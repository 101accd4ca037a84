"""Selecting rows under quotas and caps, and what batches of candidates tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.names import unused
from tracelake.storage import materialize


def _ranked(df: DataFrame, keys: list[str], order: list[Column], most: int) -> tuple[DataFrame, str]:
    """``df`` with the rank within ``keys`` up to ``most``, which Spark prunes before the shuffle; and that column's name."""
    at = unused(df, "rank_at")
    return df.withColumn(at, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(at) <= most), at


def quota_with_backfill(df: DataFrame, quotas: dict[str, int], domain: str, level: str, mix: dict[str, float], key: str, order: list[Column]) -> DataFrame:
    """``df`` with ``pass`` of the rows chosen: 1 by domain and level, 2 by domain alone, 3 from any domain.

    A domain's quota is dealt to levels by ``mix``, whose last level takes what rounding leaves; rows of
    other levels count as the second.  What a level lacks is filled from the domain, what a domain lacks
    from all rows.  ``key`` is unique and not null; ``order`` ends in it.  No more than the sum of the
    quotas is ever ranked, in any pass.
    """
    total, levels = sum(quotas.values()), list(mix)
    wanted, weight = [], sum(mix.values())
    for name, quota in quotas.items():
        left = quota
        for lv in levels:
            need = left if lv == levels[-1] else min(left, round(quota * mix[lv] / weight))
            left -= need
            wanted.append((name, lv, quota, need))
    quota, own, need = (unused(df, c) for c in ("quota_of", "own_level", "need_of"))
    plan = df.sparkSession.createDataFrame(wanted, f"`{domain}` string, {own} string, {quota} int, {need} int")
    known = F.when(F.col(level).isin(levels), F.col(level)).otherwise(levels[1 if len(levels) > 1 else 0])
    first, at = _ranked(df.withColumn(own, known), [domain, own], order, total)
    one = materialize(first.join(F.broadcast(plan), [domain, own]).where(F.col(at) <= F.col(need)).select(key, domain), "quota_one")

    # At most ``total`` rows are chosen in a pass, and ``total`` is a parameter.
    short = plan.select(domain, quota).distinct().join(one.groupBy(domain).agg(F.count("*").alias(need)), domain, "left")
    short = short.select(domain, (F.col(quota) - F.coalesce(need, F.lit(0))).alias(need)).where(F.col(need) > 0)
    rest, at = _ranked(df.join(F.broadcast(one.select(key)), key, "left_anti").join(F.broadcast(short), domain), [domain], order, total)
    two = materialize(rest.where(F.col(at) <= F.col(need)).select(key, domain), "quota_two")
    both = one.select(key, F.lit(1).alias("pass")).unionByName(two.select(key, F.lit(2).alias("pass")))
    missing = total - both.count()
    three = df.join(F.broadcast(both.select(key)), key, "left_anti").orderBy(*order).limit(missing).select(key, F.lit(3).alias("pass"))
    return df.join(F.broadcast(both.unionByName(three)), key)


def share_capped_pick(df: DataFrame, group: str, weight: Column, key: Column, n: int, share: float) -> DataFrame:
    """``n`` rows, likelier with ``weight``, of which no group has more than ``share`` (one at least).

    The order is the smallest -ln(u) / weight with u in (0, 1] from the MD5 of ``key``, which is unique.
    """
    u = (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") + 1) / 4294967297.0
    draw = unused(df, "draw")
    rows, at = _ranked(df.withColumn(draw, -F.log(u) / weight), [group], [F.col(draw), key], max(1, int(n * share)))
    return rows.orderBy(draw, key).limit(n).drop(draw, at)


def nested_caps(df: DataFrame, outer: str, inner: str, inner_cap: int, outer_cap: int, order: list[Column]) -> DataFrame:
    """Rows that a walk in ``order`` accepts when no (outer, inner) passes its cap and no outer its own.

    Caps nest, so two rankings give what the walk gives: what the inner cap refuses uses up nothing of
    the outer, and once the outer is full nothing of it is accepted any more.
    """
    some, at = _ranked(df, [outer, inner], order, inner_cap)
    out, last = _ranked(some.drop(at), [outer], order, outer_cap)
    return out.drop(last)


def capped_walk(rows: DataFrame, order: str, caps: dict[str, int]) -> DataFrame:
    """Rows (order and the keys of ``caps``) that a walk in ``order`` accepts when no value of a key is accepted more often than its cap.

    ``order`` is unique and not null; null keys are not limited.  Rounds give what the walk gives: a row is
    accepted once it would fit even if every open row before it were, and refused once the accepted
    ones before it fill a cap.  The first open row is always decided, and refused ones leave, so few rounds
    are needed unless the keys chain rows one by one.
    """
    keys = list(caps)
    state = unused(rows, "walk_accepted")
    held, waiting = ([unused(rows, f"walk_{c}_{i}") for i in range(len(keys))] for c in ("held", "open"))
    now = materialize(rows.select(order, *keys, F.lit(False).alias(state)), "walk")
    while not now.where(~F.col(state)).isEmpty():
        seen = now
        for key, h, w in zip(keys, held, waiting, strict=True):
            # Rows without a key are each on their own.
            before = Window.partitionBy(key, F.when(F.col(key).isNull(), F.col(order))).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
            count = lambda c, b=before: F.coalesce(F.sum(c.cast("int")).over(b), F.lit(0))
            seen = seen.withColumns({h: count(F.col(state)), w: count(~F.col(state))})
        fits, full = F.lit(True), F.lit(False)
        for key, h, w in zip(keys, held, waiting, strict=True):
            fits, full = fits & (F.col(h) + F.col(w) < caps[key]), full | (F.col(h) >= caps[key])
        left = seen.where(F.col(state) | ~full)
        now = materialize(left.select(order, *keys, (F.col(state) | fits).alias(state)), "walk")
    return now.select(order, *keys)


def accept_rate_stop(batches: DataFrame, run: str, batch: str, n: str, accepted: str, warmup: int, least: float) -> DataFrame:
    """Batches with ``rate``, the share accepted so far in the run, and ``ran``: no earlier one, from the ``warmup``-th on, ended below ``least``.

    ``batches`` has one row a batch; an empty run so far has rate 0.
    """
    so_far = Window.partitionBy(run).orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(run).orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.sum(n).over(so_far)
    rated = batches.withColumn("rate", F.when(seen > 0, F.sum(accepted).over(so_far) / seen).otherwise(0.0))
    stops = unused(rated, "stops")
    rated = rated.withColumn(stops, (F.count("*").over(so_far) >= warmup) & (F.col("rate") < least))
    return rated.withColumn("ran", ~F.coalesce(F.bool_or(stops).over(before), F.lit(False))).drop(stops)


def rejection_feedback(rejected: DataFrame, run: str, batch: str, reason: str, top: int = 3, remembered: int = 8) -> DataFrame:
    """(run, batch, top, learnings) for each batch with rejections; null reasons are none.

    ``top`` are the commonest reasons, ties by name; ``learnings`` those of this batch and the ones
    before, newest first, up to ``remembered``.  Every batch here adds one at least, so no more
    than ``remembered`` batches are looked back on.
    """
    counts = rejected.where(F.col(reason).isNotNull()).groupBy(run, batch, reason).agg(F.count("*").alias("times"))
    best, _ = _ranked(counts, [run, batch], [F.desc("times"), F.col(reason)], top)
    tops = best.groupBy(run, batch).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("times")).alias("m"), F.col(reason).alias("r")))), lambda x: x["r"]).alias("top"))
    back = F.collect_list("top").over(Window.partitionBy(run).orderBy(batch).rowsBetween(1 - remembered, 0))
    return tops.withColumn("learnings", F.slice(F.flatten(F.reverse(back)), 1, remembered))


def trimmed_menu(used: Column, catalog: Column, key: Column, least: int, most: int) -> Column:
    """The names used that the catalogue has, sorted, then others in hash order of ``key`` until there are ``least``, ``most`` at all.

    Null arrays are empty.
    """
    names = F.coalesce(catalog, F.array().cast("array<string>"))
    kept = F.array_sort(F.array_intersect(F.coalesce(used, F.array().cast("array<string>")), names))
    others = F.array_sort(F.transform(F.array_except(names, kept), lambda c: F.struct(F.md5(F.concat_ws(":", key.cast("string"), c)).alias("h"), c.alias("c"))))
    extra = F.slice(F.transform(others, lambda x: x["c"]), 1, F.greatest(F.lit(least) - F.size(kept), F.lit(0)))
    return F.slice(F.concat(kept, extra), 1, most)
