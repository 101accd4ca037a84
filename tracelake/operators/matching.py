"""Joins and picks that the comparison of runs needs, beyond plain equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.components import connected_components
from tracelake.operators.curation import token_pairs
from tracelake.operators.names import unused
from tracelake.operators.selection import capped_walk


def with_fallback(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of ``first``, and of ``second`` the rows whose key ``first`` lacks; null keys are lacking."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def nearest(rows: DataFrame, pool: DataFrame, blocks: Sequence[str], score: Column, row_id: str, pool_id: str) -> DataFrame:
    """For each row the most similar row of ``pool`` among those of the same ``blocks``; ties go to the smallest id.

    Without a common block a row has none.  Candidates are reduced to one per row while they are made.
    """
    pairs = rows.join(pool, list(blocks))
    best = F.max_by(F.struct(F.col(pool_id), score.alias("score")), F.struct(score, -F.col(pool_id)))
    return pairs.groupBy(row_id).agg(best.alias("best")).select(row_id, F.col(f"best.{pool_id}").alias(pool_id), "best.score")


def nearest_number(rows: DataFrame, pool: DataFrame, block: str, row_value: str, pool_value: str, row_id: str, pool_id: str) -> DataFrame:
    """(row_id, pool_id, score): for each row the row of ``pool`` in its block whose number is nearest, ties to the smallest id; score is minus the distance.

    Both tables are sorted by their numbers, and only the pool's last number below a row and the first above it are looked
    at.  Null and NaN numbers have and are no neighbours; a row without a common block is left out.
    """
    real = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    least = pool.where(real(pool_value)).groupBy(F.col(block).alias("b"), F.col(pool_value).cast("double").alias("x")).agg(F.min(pool_id).alias("p"))
    asked = rows.where(real(row_value)).select(F.col(block).alias("b"), F.col(row_value).cast("double").alias("x"), F.col(row_id).alias("r"), F.lit(True).alias("asks"))
    both = asked.unionByName(least.select("b", "x", "p", F.lit(False).alias("asks")), allowMissingColumns=True)
    own = F.when(~F.col("asks"), F.struct("x", "p"))
    order = Window.partitionBy("b").orderBy("x", "asks")  # of equal numbers the pool's comes first
    below = F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # In falling order, since a frame that ends at the last row is built anew for each row.
    above = F.last(own, ignorenulls=True).over(Window.partitionBy("b").orderBy(F.desc("x"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0))
    met = both.select("b", "r", "x", "asks", below.alias("below"), above.alias("above")).where("asks and b is not null")
    one = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col("x") - F.col(side)["x"]).alias("d"), F.col(side)["p"].alias("p")))
    best = met.select("r", F.least(one("below"), one("above")).alias("best")).where("best is not null")
    return best.select(F.col("r").alias(row_id), F.col("best.p").alias(pool_id), (-F.col("best.d")).alias("score"))


def greedy_take(rows: DataFrame, order: Sequence[Column], unique: Sequence[str], pattern: str, cap: int) -> DataFrame:
    """Rows that a walk in rising ``order`` takes: none whose value of a ``unique`` column was taken before, and at most ``cap`` of a pattern.

    ``order`` is unique and not null as a whole; null values are not limited.  A row that is refused uses nothing up.
    """
    at = unused(rows, "walk_at")
    placed = rows.withColumn(at, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    taken = capped_walk(placed, at, {c: 1 for c in unique} | {pattern: cap}).select(at)
    return placed.join(taken, at, "left_semi").drop(at)


def quotas(available: dict[str, int], weights: dict[str, float], n: int) -> dict[str, int]:
    """How many of each domain to take: by weight, never more than there are, the rest dealt one by one to the heavier with room.

    Domains without a weight get none before others are full.  A row per domain, so this runs on the driver.
    """
    known = {d: max(0.0, weights.get(d, 0.0)) for d in available}
    total = sum(known.values())
    share = {d: w / total if total else 1 / len(known) for d, w in known.items()}
    order, out, left = sorted(share, key=lambda d: -share[d]), {}, n
    for d in order:
        out[d] = max(0, min(round(n * share[d]), available[d], left))
        left -= out[d]
    room = sorted((d for d in order if out[d] < available[d]), key=lambda d: (-share[d], -(available[d] - out[d])))
    while left > 0 and room:
        for d in list(room):
            if left > 0:
                out[d] += 1
                left -= 1
            if out[d] == available[d]:
                room.remove(d)
    return {d: k for d, k in out.items() if k > 0}


def difficulty_targets(n: Column, easy: float, medium: float) -> Column:
    """Easy and medium rounded to even halves, hard what is left."""
    e = F.least(n, F.greatest(F.lit(0), F.bround(n * easy).cast("long")))
    m = F.least(n - e, F.greatest(F.lit(0), F.bround(n * medium).cast("long")))
    return F.struct(e.alias("easy"), m.alias("medium"), (n - e - m).alias("hard"))


def latest(rows: DataFrame, run: str) -> DataFrame:
    """The rows of the last run; null runs are none."""
    last, name = rows.agg(F.max(run).alias("last")), unused(rows, "last")
    return rows.join(F.broadcast(last.withColumnRenamed("last", name)), F.col(run) == F.col(name), "left_semi")  # one row


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter text is one."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, n)))


def ngram_clusters(rows: DataFrame, id_col: str, text_col: str, similarity: float, n: int = 3) -> DataFrame:
    """(id, cluster, size): texts whose character n-gram sets have a Jaccard similarity of ``similarity`` or more, and what that reaches.

    Pairs come from ``token_pairs``, which looks texts up by their rarest n-grams only.
    """
    classes = rows.groupBy(F.col(text_col).alias("text")).agg(F.min(id_col).alias("rep"), F.count("*").alias("n"))
    sets = classes.select(F.col("rep").alias("id"), char_ngrams(F.col("text"), n).alias("tokens"))
    links = token_pairs(sets, sets, similarity, ordered=True)
    parts = connected_components(links, "a_id", "b_id").withColumnsRenamed({"node": "rep"})
    named = classes.join(parts, "rep", "left").select("text", "n", F.coalesce("component", "rep").alias("cluster"))
    sizes = named.groupBy("cluster").agg(F.sum("n").alias("size"))
    return rows.select(id_col, F.col(text_col).alias("text")).join(named.join(sizes, "cluster").select("text", "cluster", "size"), "text").select(id_col, "cluster", "size")
