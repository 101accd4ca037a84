"""Benchmark decontamination over a distributed positional inverted index.

Postings (document, position) of training tokens are stored for the terms the test items need.  A
window of an item can only occur where its two rarest terms do, at the same offset from each other:
their posting lists are shifted by the terms' places in the item and intersected, which leaves a
(document, item, diagonal) row for each alignment.  What is left is compared word by word.  How rare a
term is comes from counting it in the whole corpus.  Native functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm import membership
from tracelake.llm.text import ascii_lower, unused
from tracelake.storage import materialize

WINDOW = 10
#: What stands between words, upper-case letters still being there.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows and array elements (tens of bytes each) up to which a table made of the benchmark alone is broadcast.
_SMALL = 1_000_000


def _raw_words(text: Column) -> Column:
    """Words as they are written, with an empty one first or last where the text has marks there."""
    return F.split(text, _BETWEEN, -1)


def _n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_BETWEEN.replace("[", "[^", 1))), F.lit(0)).cast("long")


def _few(table: DataFrame, array: str | None = None) -> DataFrame:
    """``table`` marked for broadcasting if its rows, and the elements of ``array``, were counted and are few; else for a shuffled join."""
    n = F.count("*") + (F.coalesce(F.sum(F.size(array)), F.lit(0)) if array else F.lit(0))
    return F.broadcast(table) if table.agg(n.alias("n")).first()["n"] <= _SMALL else table


def _tokens(docs: DataFrame) -> DataFrame:
    """(id, th, pos, term) of all words; pos counts from the raw split, so offsets between words hold."""
    raw = docs.where(F.col("text").isNotNull()).select("id", "th", F.posexplode(_raw_words(F.col("text"))).alias("pos", "raw"))
    return raw.where(F.col("raw") != "").select("id", "th", "pos", ascii_lower(F.col("raw")).alias("term"))


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, ik, words) of items with words, repeated rows once."""
    words = F.filter(F.transform(_raw_words(F.col("text")), ascii_lower), lambda w: w != "")
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    rows = rows.dropDuplicates(["item", "text"]).select("item", F.xxhash64("item", "text").alias("ik"), words.alias("words"))
    return rows.where(F.size("words") > 0)


def plan_items(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """Items with the windows that can occur at all: ``wins`` of (s, p1, p2), start and two rarest places.

    A window with a term that no document has is left out, and so are items without windows.
    """
    placed = items.select("ik", F.posexplode("words").alias("p", "term"))
    vocabulary = materialize(placed.select("term").distinct(), "decon_terms")
    counts = _tokens(docs).select("term").join(_few(vocabulary), "term").groupBy("term").agg(F.count("*").alias("cf"))
    known = placed.join(_few(materialize(counts, "decon_counts")), "term", "left")
    cfs = known.groupBy("ik").agg(F.array_sort(F.collect_list(F.struct(F.col("p"), F.coalesce("cf", F.lit(0)).alias("cf")))).alias("cfs"))
    length = F.least(F.size("cfs"), F.lit(window))

    def rarest(s: Column) -> Column:
        inside = F.transform(F.slice("cfs", s + 1, length), lambda x: F.struct(x["cf"].alias("cf"), x["p"].alias("p")))
        order = F.array_sort(inside)
        return F.struct(s.alias("s"), order[0]["p"].alias("p1"), F.get(order, F.least(length, F.lit(2)) - 1)["p"].alias("p2"), order[0]["cf"].alias("cf"))

    wins = F.filter(F.transform(F.sequence(F.lit(0), F.size("cfs") - length), rarest), lambda w: w["cf"] > 0)
    planned = cfs.select("ik", length.alias("len"), F.transform(wins, lambda w: F.struct(w["s"].alias("s"), w["p1"].alias("p1"), w["p2"].alias("p2"))).alias("wins"))
    return materialize(items.join(planned.where(F.size("wins") > 0), "ik"), "decon_items")


def postings(docs: DataFrame, planned: DataFrame) -> DataFrame:
    """The stored index: (id, th, pos, ik, p) for every training token that is a rarest term of a window."""
    anchors = planned.select("ik", "words", F.explode("wins").alias("w"))
    anchors = anchors.select("ik", "words", F.explode(F.array("w.p1", "w.p2")).alias("p")).select("ik", "p", F.get("words", F.col("p")).alias("term"))
    places = materialize(anchors.distinct().groupBy("term").agg(F.collect_list(F.struct("ik", "p")).alias("places")), "decon_anchors")
    # One row per token, whatever number of places it has.
    return materialize(_tokens(docs).join(_few(places, "places"), "term").select("id", "th", "pos", "places"), "decon_postings")


def alignments(index: DataFrame, planned: DataFrame, slop: int = 0) -> DataFrame:
    """(id, th, ik, diag, wins): windows both of whose rarest terms are posted on one diagonal.

    With a ``slop``, the second term may be up to so many words off the diagonal, which is a proximity match.
    """
    shifted = index.select("id", "th", "pos", F.explode("places").alias("at")).select(
        "id", "th", F.col("at.ik").alias("ik"), F.col("at.p").alias("p"), (F.col("pos") - F.col("at.p")).alias("diag")
    )
    if slop:
        near = F.sequence(F.lit(-slop), F.lit(slop))
        shifted = shifted.select("id", "th", "ik", "p", F.explode(near).alias("off"), "diag").select(
            "id", "th", "ik", F.when(F.col("off") == 0, F.col("p")).alias("p"), F.col("p").alias("loose"), (F.col("diag") + F.col("off")).alias("diag")
        )
    else:
        shifted = shifted.withColumn("loose", F.col("p"))
    met = shifted.groupBy("id", "th", "ik", "diag").agg(F.collect_set("p").alias("ps"), F.collect_set("loose").alias("loose"))
    both = F.filter("wins", lambda w: F.array_contains("ps", w["p1"]) & F.array_contains("loose", w["p2"]))
    rows = met.join(_few(planned.select("ik", "wins"), "wins"), "ik").select("id", "th", "ik", "diag", both.alias("wins"))
    return materialize(rows.where(F.size("wins") > 0), "decon_aligned")


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, th, item, starts, len): where windows of an item occur in a document, word by word; th is the text's hash."""
    rows = _prepared(docs, id_col, text_col)
    planned = plan_items(rows, _items(benchmark, item_col, text_col), window)
    aligned = alignments(postings(rows, planned), planned).withColumnsRenamed({"id": "aid", "th": "ath"})
    # What aligns grows with the corpus, so it is shuffled, to the texts that may align; the others stay where they are.
    may = membership.with_membership(rows, F.col("th"), membership.bitmaps(F.col("ath"), aligned), "maybe").where("maybe").drop("maybe")
    found = may.join(aligned.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("aid")) & (F.col("th") == F.col("ath")))
    found = found.select("id", "th", _raw_words(F.col("text")).alias("raw"), "ik", "diag", "wins")
    found = found.join(_few(planned.select("ik", "item", "words", "len"), "words"), "ik")
    same = lambda w: (F.col("diag") + w["s"] >= 0) & (
        F.transform(F.slice("raw", F.greatest(F.col("diag") + w["s"] + 1, F.lit(1)), F.col("len")), ascii_lower) == F.slice("words", w["s"] + 1, F.col("len"))
    )
    starts = F.transform(F.filter("wins", same), lambda w: F.col("diag") + w["s"])
    return found.select("id", "th", "item", starts.alias("starts"), "len").where(F.size("starts") > 0)


def proximity_matches(
    docs: DataFrame, benchmark: DataFrame, slop: int = 3, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """(id, item, windows): how many of an item's windows have their two rarest terms in a document, the
    second at most ``slop`` words from where the item has it relative to the first.  Phrase matches are
    among them, except windows that hold a term no document has, which are not looked for."""
    rows = _prepared(docs, id_col, text_col)
    planned = plan_items(rows, _items(benchmark, item_col, text_col), window)
    near = alignments(postings(rows, planned), planned, slop).join(_few(planned.select("ik", "item")), "ik")
    met = near.select("id", "item", F.explode("wins").alias("w")).groupBy("id", "item").agg(F.countDistinct("w.s").alias("windows"))
    return met.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "windows")


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """One row per document: id, ``th`` (hash of its text), n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased.  An item's
    windows are its runs of ``window`` words, or all its words if it has fewer; an item without words has
    none.  n_hit counts document words inside any occurrence, n_items the items with one.  Null and empty
    texts have no words and no hits.  Repeated rows give repeated rows; repeated items count once; items
    with a null id match but are not counted as items.  Empty tables on either side give no hits.
    """
    matches = phrase_matches(docs, benchmark, window, id_col, text_col, item_col)
    spans = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("len") - 1)))
    per_row = matches.select("id", "th", "item", spans.alias("hit"))
    hits = per_row.groupBy("id", "th").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items")
    )
    hits = materialize(hits.withColumnsRenamed({"id": "hid", "th": "hth"}), "decon_hits")
    rows = _prepared(docs, id_col, text_col).select("id", "th", _n_words(F.col("text")).alias("n_words"))
    joined = rows.join(hits.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth")), "left")
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        F.col("id").alias(id_col), "th", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs; columns unchanged."""
    matches = phrase_matches(docs, benchmark, window, id_col, text_col, item_col)
    bad_id, bad_text = unused(docs, "bad_id"), unused(docs, "bad_text")
    bad = materialize(matches.select(F.col("id").alias(bad_id), F.col("th").alias(bad_text)).distinct(), "decon_bad")
    hash_of, may = F.xxhash64(F.col(f"`{text_col}`")), unused(docs, "bad_may")
    hit = F.col(f"`{id_col}`").eqNullSafe(F.col(bad_id)) & (hash_of == F.col(bad_text))
    marked = membership.with_membership(docs, hash_of, membership.bitmaps(F.col(bad_text), bad), may)
    return marked.where(~F.col(may)).unionByName(marked.where(may).join(bad.hint("shuffle_hash"), hit, "left_anti")).drop(may)
