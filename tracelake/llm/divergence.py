"""How far the sources of a language differ in their words, term by term and pair by pair.

A source's price of a term is a share smoothed by two: ``1 + floor(10^9 (count + 2) / (N + 2 V))``.  Two
sources differ in a term by ``f(p, q) = floor((p - q)^2 / (p + q))`` of their prices, and in all by the sum over
the V kept terms.  Most of these counts are zero on one side or both, so the sum is taken by inclusion and
exclusion over the terms that occur, with f00 = f(price of 0, price of 0):

    V f00  +  sum over g's terms of (f(p, q0) - f00)  +  the same for h
           +  sum over the terms of both of (f(p, q) - f(p, q0) - f(p0, q) + f00)

The middle sums depend on counts alone and come from a histogram of each source's counts; the last one is a
join of postings on the term.  No row stands for a term that a source lacks.  All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.storage import materialize

#: Bytes as they stand in terms: A-Z lower-cased, what is neither a letter nor beyond ASCII as a blank.
_AS_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Terms that a task holds before it gives them away, and terms of one batch.
_HELD, _EMITTED = 1_500_000, 50_000
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])
#: What a price of one is counted in, and what smooths a count.
_SCALE, _SMOOTH = 1_000_000_000, 2
#: Groups (some tens of bytes each) up to which their table is broadcast.
_FEW_GROUPS = 200_000


def _known(name: str) -> Column:
    """A column as text, null as the empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the terms of each (lang, source), over as many documents as ``_HELD`` entries allow for."""
    # Documents with a term, and its occurrences beyond one in each of them, which few terms have.
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def emptied() -> Iterator[pa.RecordBatch]:
        for (lang, source), (docs, more) in held.items():
            terms = iter(docs)
            while some := list(islice(terms, _EMITTED)):
                n = np.fromiter(map(docs.__getitem__, some), np.int64, len(some))
                n_more = np.fromiter(map(more.__getitem__, some), np.int64, len(some))
                of = [pa.array([x]).take(pa.array(np.zeros(len(some), np.int32))) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*of, pa.array(some, pa.binary()).cast(pa.string()), pa.array(n + n_more), pa.array(n)], schema=_COUNTS)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = Counter(text.translate(_AS_TERMS).split())
            docs, more = held.setdefault((lang, source), (Counter(), Counter()))
            docs.update(own.keys())
            for term, n in own.items():
                if n > 1:
                    more[term] += n - 1
        if sum(len(docs) for docs, _ in held.values()) > _HELD:
            yield from emptied()
    yield from emptied()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, count, docs): occurrences of each term in a source, and its documents with it.

    A task adds up what it reads, so what is dealt out is dealt by language and term, as all that follows needs it.
    """
    rows = docs.select(_known(lang_col), _known(source_col), _known(text_col).cast("binary"))
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, count long, docs long")
    return counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def price(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)); null where there are no terms."""
    raised, wide = count + _SMOOTH, lambda c: c.cast("decimal(19,0)")
    # Longs hold the product for counts of some billions; decimals do beyond.
    short = F.call_function("div", raised * _SCALE, total + _SMOOTH * terms)
    long = F.call_function("div", wide(raised) * F.lit(_SCALE).cast("decimal(10,0)"), wide(total + _SMOOTH * terms))
    return F.when(terms > 0, F.when(raised < (1 << 63) // _SCALE, short).otherwise(long) + 1)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two prices."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _few(groups: DataFrame) -> DataFrame:
    """``groups`` marked for broadcasting if it was counted and is small; else for a shuffled join."""
    return F.broadcast(groups) if groups.count() <= _FEW_GROUPS else groups


class Priced:
    """What the two parts of the audit are made of, written to the shared folder.

    groups: (lang, source, terms, lang_total, p0), one row for each group that occurs; postings: (lang, source,
    term, count, p, q), a row for each kept term that occurs in a group, q being the language's own price.
    """

    def __init__(self, docs: DataFrame, min_docs: int, lang_col: str, source_col: str, text_col: str):
        of_term = Window.partitionBy("lang", "term")
        counts = term_counts(docs, lang_col, source_col, text_col)
        counts = counts.withColumn("lang_count", F.sum("count").over(of_term)).withColumn("of_lang", F.sum("docs").over(of_term)).withColumn("first", F.min("source").over(of_term))
        kept = counts.where(F.col("of_lang") >= min_docs).select("lang", "source", "term", "count", "lang_count", (F.col("first") == F.col("source")).cast("long").alias("first"))
        found = materialize(kept, "divergence_found")
        totals = materialize(found.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.sum("first").alias("firsts")), "divergence_totals")
        langs = totals.groupBy("lang").agg(F.sum("firsts").alias("terms"), F.sum("total").alias("lang_total"))
        totals = totals.drop("firsts")
        groups = docs.select(_known(lang_col).alias("lang"), _known(source_col).alias("source")).distinct()
        groups = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "lang_total", "total"])
        self.groups = materialize(groups.withColumn("p0", price(F.lit(0), F.col("total"), F.col("terms"))), "divergence_groups")
        sized = found.join(_few(self.groups), ["lang", "source"])
        own, lang_own = price(F.col("count"), F.col("total"), F.col("terms")), price(F.col("lang_count"), F.col("lang_total"), F.col("terms"))
        self.postings = materialize(sized.select("lang", "source", "term", "count", "p0", own.alias("p"), lang_own.alias("q")), "divergence_postings")


def pair_sums(priced: Priced) -> DataFrame:
    """(lang, a, b, value) for each two sources of a language, a < b."""
    groups, postings = priced.groups, priced.postings
    one = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "terms")
    two = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    # Pairs are the result itself; each is here once.
    constants = one.join(_few(two), "lang").where(F.col("a") < F.col("b")).select("lang", "a", "b", F.coalesce(F.col("terms") * apart(F.col("a0"), F.col("b0")), F.lit(0)).alias("value"))
    histogram = postings.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("n"))
    sided = histogram.join(_few(two), "lang").where(F.col("source") != F.col("b"))
    worth = F.col("n") * (apart(F.col("p"), F.col("b0")) - apart(F.col("p0"), F.col("b0")))
    sided = sided.select("lang", F.least("source", "b").alias("a"), F.greatest("source", "b").alias("b"), worth.alias("value"))
    left = postings.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("ap"), F.col("p0").alias("a0"))
    right = postings.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("bp"), F.col("p0").alias("b0"))
    both = left.join(right, ["lang", "term"]).where(F.col("a") < F.col("b"))
    c = F.col
    worth = apart(c("ap"), c("bp")) - apart(c("ap"), c("b0")) - apart(c("a0"), c("bp")) + apart(c("a0"), c("b0"))
    both = both.select("lang", "a", "b", worth.alias("value"))
    return constants.unionByName(sided).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def source_divergence(docs: DataFrame, min_docs: int = 10, top_terms: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from the others of its language.

    Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased; a language keeps those in
    ``min_docs`` of its documents or more.  Part ``pair`` has a row for every other source of the language,
    its value summed over all kept terms (0 where none is kept); part ``term`` the ``top_terms`` terms that the
    source has a larger share of than its language, by how far the two are apart.  Ranks fall with the
    value and rise with the item.  Null text, language and source are empty ones; a source without terms
    is compared like any other, repeated rows count as often as they occur, other columns are ignored, and an
    empty table gives an empty one.

    There are as many pairs as the contract has rows; beyond those, work grows with the postings and with the
    square of the number of sources that share a term.
    """
    priced = Priced(docs, min_docs, lang_col, source_col, text_col)
    sums = pair_sums(priced)
    pairs = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("of"), "value")
    pairs = _ranked(pairs.select("lang", "of.source", F.lit("pair").alias("part"), "of.item", "value"))
    above = priced.postings.where(F.col("p") > F.col("q"))
    terms = _ranked(above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value")))
    return pairs.unionByName(terms.where(F.col("rank") <= top_terms))
