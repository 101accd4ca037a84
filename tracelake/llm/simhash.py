"""SimHash fingerprints and near-duplicate classes by multi-index hashing.

A 64-bit fingerprint is cut into two 32-bit segments.  Two fingerprints at distance 3 or less agree in
one of the segments up to one bit, so the radius-1 ball of every segment is enumerated and looked up
in the table of that segment, and what is found is checked on all 64 bits.  Of two values that differ
in one bit, only the one with the 0 needs to enumerate, which halves the ball.

Everything after the fingerprints works on distinct fingerprints, so copies of a document cost one
row however many there are.  A bucket of a segment table with more than ``hot_bucket`` fingerprints
is compared in blocks of that size spread over tasks; a task returns only a spanning forest of the
links in its block pair, so that a large group of near copies leaves no quadratic output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.operators.components import connected_components
from tracelake.storage import materialize

SEED = 42
_SLICE = 1 << 15


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text; 0 if it has no words."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles: list[bytes] = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False)))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), _SLICE):
        h = np.array([digest(s, SEED) for s in shingles[at : at + _SLICE]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view("<u8")[0])


def fingerprint_udf(shingle_words: int = 3):
    """Column function: the fingerprint as a signed long with the same bits."""

    @F.pandas_udf(T.LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        bits = np.array([fingerprint(t, shingle_words) for t in texts], dtype=np.uint64)
        return pd.Series(bits.view(np.int64))

    return simhash


def hex16(c: Column) -> Column:
    """16 lower-case hex digits of a long's bits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def _segments(fp: Column) -> Column:
    return F.array(F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF)))


def _forest(members: np.ndarray, probes: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest between two sets of fingerprints, compared in slices."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    out = []
    for at in range(0, len(probes), 256):
        some = probes[at : at + 256]
        near = np.bitwise_count(some[:, None] ^ members[None, :]) <= max_bits
        for i, j in zip(*np.nonzero(near), strict=True):
            a, b = int(some[i]), int(members[j])
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[ra] = rb
                out.append((a, b))
    return out


def similar_fingerprints(fps: DataFrame, max_bits: int = 3, hot_bucket: int = 2048) -> DataFrame:
    """Links (a, b) whose closure is that of all pairs of distinct ``fp`` at ``max_bits`` or less.

    ``fps`` has one row per distinct fingerprint.  Pairs from buckets of ordinary size are all there,
    pairs inside oversized buckets as spanning forests.  The two segments with radius 1 are exact for
    ``max_bits`` up to 3.
    """
    if max_bits > 3:
        raise ValueError("two segments with radius 1 are exact up to 3 bits")
    fps = fps.select("fp")
    table = fps.select("fp", F.posexplode(_segments(F.col("fp"))).alias("seg", "val"))
    flips = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.col("val").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    ball = F.array_union(F.array("val"), flips)
    probes = table.select(F.col("fp").alias("probe"), "seg", F.col("val").alias("own"), F.explode(ball).alias("val"))
    sizes = table.groupBy("seg", "val").agg(F.count("*").alias("n"))
    # A bucket value is probed at most by its own members and those one bit below, so only values that
    # occur in the table matter; the join drops the rest of the ball.
    hot = materialize(sizes.where(F.col("n") > hot_bucket), "simhash_hot")
    n_hot = hot.count()
    near = (F.bit_count(F.col("probe").bitwiseXOR(F.col("fp"))) <= max_bits) & (
        (F.col("own") != F.col("val")) | (F.col("probe") < F.col("fp"))
    )
    if not n_hot:
        return probes.join(table, ["seg", "val"]).where(near).select(F.col("probe").alias("a"), F.col("fp").alias("b"))
    cold = (
        probes.join(hot.select("seg", "val"), ["seg", "val"], "left_anti")
        .join(table, ["seg", "val"])
        .where(near)
        .select(F.col("probe").alias("a"), F.col("fp").alias("b"))
    )
    return cold.unionByName(_hot_links(table, probes, hot, max_bits, hot_bucket))


def _hot_links(table: DataFrame, probes: DataFrame, hot: DataFrame, max_bits: int, block: int) -> DataFrame:
    hot_probes = materialize(probes.join(hot, ["seg", "val"]).select("seg", "val", "n", "probe"), "simhash_hot_probes")
    counted = materialize(hot_probes.groupBy("seg", "val").agg(F.count("*").alias("np")), "simhash_hot_counts")
    chunks = lambda n: F.ceil(F.col(n) / block).cast("int")
    mine = lambda c, n: F.pmod(F.xxhash64(c), chunks(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), chunks(n) - 1))
    left = (
        table.join(hot, ["seg", "val"]).join(counted, ["seg", "val"])
        .select("seg", "val", mine("fp", "n").alias("i"), others("np").alias("j"), "fp", F.lit(True).alias("member"))
    )
    right = (
        hot_probes.join(counted, ["seg", "val"])
        .select("seg", "val", others("n").alias("i"), mine("probe", "np").alias("j"), F.col("probe").alias("fp"), F.lit(False).alias("member"))
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        bits = group["fp"].to_numpy().view(np.uint64)
        member = group["member"].to_numpy()
        links = _forest(bits[member], bits[~member], max_bits)
        return pd.DataFrame(np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    return left.unionByName(right).groupBy("seg", "val", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicate_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    max_bits: int = 3,
    hot_bucket: int = 2048,
) -> DataFrame:
    """One row per input row: ``id_col``, ``fp`` (long) and ``component_id``.

    component_id is the smallest id reachable over links of ``max_bits`` or fewer differing bits, the
    row's own included.

    Null and empty texts and texts without words have fingerprint 0 and link like any other.  Repeated
    rows give repeated rows.  A null id takes part in linking but never names a component unless no
    other id is reachable.  An empty table gives an empty table; other columns are ignored.
    """
    fps = materialize(
        docs.select(F.col(id_col).alias("id"), fingerprint_udf(shingle_words)(F.col(text_col)).alias("fp")), "simhash_fp"
    )
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("rep")), "simhash_classes")
    links = similar_fingerprints(classes, max_bits, hot_bucket)
    parts = connected_components(links, "a", "b").withColumnsRenamed({"node": "fp", "component": "part"})
    linked = materialize(classes.join(parts, "fp"), "simhash_linked")
    least = linked.groupBy("part").agg(F.min("rep").alias("component_id"))
    # One row per fingerprint, linked or not.
    named = materialize(
        linked.join(least, "part").select("fp", "component_id")
        .unionByName(classes.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("rep").alias("component_id"))),
        "simhash_named",
    )
    return fps.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
