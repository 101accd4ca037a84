"""Removal of boilerplate lines by how many distinct sites they occur on.

Each line's key carries a HyperLogLog sketch of the sites it was seen on; sketches merge map-side and
across the shuffle, so a line on a third of all pages costs one small row per task.  Lines whose
estimate is clearly above the threshold are boilerplate, clearly below it are not; those within the
sketch's error band get an exact distinct count over their occurrences alone.  Native functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.text import unused
from tracelake.storage import materialize

#: Rows of two longs and a document id; a table up to this many is small enough to broadcast (32 MB).
_BROADCAST_ROWS = 1_000_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _content(line: Column) -> Column:
    """What of a line counts: without white space around it."""
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def _eligible(line: Column, min_words: int) -> Column:
    """At least ``min_words`` words: shorter lines recur by chance."""
    return line.rlike(rf"^(?:\S+\s+){{{min_words - 1}}}\S") if min_words > 1 else line != ""


def _key(line: Column) -> Column:
    """128 bits of a line's content."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _few(table: DataFrame) -> DataFrame:
    """``table`` marked for broadcasting if it was counted and is small; else for a shuffled join."""
    return F.broadcast(table) if table.count() <= _BROADCAST_ROWS else table


def line_occurrences(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_words: int) -> DataFrame:
    """(key, site, id) of every eligible line; null texts have no lines, null sites are one site of their own."""
    lines = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(site_col).cast("string"), F.lit("\u0000")).alias("site"),
        F.explode(_lines(F.col(text_col))).alias("line"),
    ).select("id", "site", _content(F.col("line")).alias("line"))
    return lines.where(_eligible(F.col("line"), min_words)).select(_key(F.col("line")).alias("key"), "site", "id")


def boilerplate_lines(
    docs: DataFrame, min_sites: int = 10, min_words: int = 3, lg_k: int = 12, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source"
) -> DataFrame:
    """(key, first_id) of the lines on ``min_sites`` distinct sites or more; first_id is the smallest id with the line.

    The relative standard error of a sketch is 1.04 / sqrt(2 ** lg_k); five of them either side of the
    threshold are the band that is counted exactly.
    """
    seen = line_occurrences(docs, id_col, text_col, site_col, min_words)
    margin = 5 * 1.04 / 2 ** (lg_k / 2)
    sketched = materialize(
        seen.groupBy("key").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min("id").alias("first_id"))
        .select("key", "first_id", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= F.lit(min_sites * (1 - margin) - 1)),
        "line_spread",
    )
    sure = sketched.where(F.col("sites") > min_sites * (1 + margin) + 1).select("key", "first_id")
    near = sketched.where(F.col("sites") <= min_sites * (1 + margin) + 1).select("key", "first_id")
    counted = (
        seen.select("key", "site").join(_few(near.select("key")), "key", "left_semi").distinct()
        .groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    )
    return materialize(sure.unionByName(near.join(counted.select("key"), "key", "left_semi")), "line_boilerplate")


def remove_boilerplate(
    docs: DataFrame,
    min_sites: int = 10,
    min_words: int = 3,
    keep_first: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
) -> DataFrame:
    """``docs`` with boilerplate lines gone from ``text_col``, and ``n_lines`` and ``n_removed`` added or replaced.

    A line is what stands between line feeds; it is boilerplate if its content, without white space
    around it, has ``min_words`` words or more and occurs on ``min_sites`` distinct values of
    ``site_col`` or more (null being one).  With ``keep_first`` it stays in the documents with the
    smallest id that have it (a null id is never the smallest unless there is no other), so the corpus
    loses no content, and repeated rows are treated alike.  Other lines, and their order, do not
    change.  Null and empty texts come back as they are, with 0 and 1 lines; a text that loses all
    lines becomes empty.  An empty table gives an empty one.
    """
    boilerplate = boilerplate_lines(docs, min_sites, min_words, id_col=id_col, text_col=text_col, site_col=site_col)
    seen = line_occurrences(docs, id_col, text_col, site_col, min_words).select("key", "id").join(_few(boilerplate), "key")
    if keep_first:
        seen = seen.where(~F.col("id").eqNullSafe(F.col("first_id")))
    # Whether a line goes depends on its content and the id alone, so a set of keys by id is enough.
    own, drop = unused(docs, "drop_id"), unused(docs, "drop_keys")
    drops = materialize(seen.groupBy(F.col("id").alias(own)).agg(F.collect_set("key").alias(drop)), "line_drops")
    # Merged at every size: the set grows with the corpus, and a plan that broadcasts it while it is small
    # says nothing of how the join behaves later.
    joined = docs.join(drops.hint("merge"), docs[id_col].eqNullSafe(F.col(own)), "left")
    lines = _lines(F.col(text_col))
    gone = lambda x: _eligible(_content(x), min_words) & F.array_contains(F.col(drop), _key(_content(x)))
    kept = F.when(F.col(drop).isNull(), lines).otherwise(F.filter(lines, lambda x: ~gone(x)))
    text = F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_kept = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(kept)).cast("long")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    return joined.select(*others, text.alias(text_col), n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_removed"))
