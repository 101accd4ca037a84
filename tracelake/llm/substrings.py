"""Removal of passages that the corpus has had before, through compressed FM-indexes.

A window is ``window`` consecutive words.  Consecutive windows whose least word-gram hash (minimizer) is the
same make a segment; equal windows have equal minimizers, so they meet in the same shard, however the
documents were dealt out.  Segments whose minimizer has one place in the corpus cannot repeat: a bitmap of
the others, of fixed size, keeps them from being shuffled.  Equal segments are one, named by the earliest.

A shard is an FM-index over the words of its segments, in the order of the corpus.  The segments are streamed
against it: backward search over wavelet matrices gives their matching statistics, and where those reach
the window the index knows the first place of it.  If that is before the window's own, the window's words go.

A minimizer with very many unlike segments would be one large shard; its windows are dealt out one by one, by
their own words, and are segments of one window each.  Copies of whole texts are told by their hashes first, and only
texts that may have a copy, or lose words, are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import membership
from tracelake.llm.fm_index import FMIndex
from tracelake.storage import materialize

WINDOW = 20
#: Words of the grams that minimizers are taken from, at most; windows that one segment holds, at most.
_GRAM, _RUN = 8, 64
#: Words of one shard's index, and unlike segments from which a minimizer's windows are dealt out one by one.
SHARD_WORDS, HOT_SEGMENTS = 400_000, 5_000
#: Segments whose words a task does not send again, while it remembers them.
_REMEMBERED = 200_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return (text or b"").split()


def _over(least, values: np.ndarray, wide: int) -> np.ndarray:
    """``least`` (a minimum or maximum) of every ``wide`` neighbours, by spans of doubling length."""
    span = 1
    while 2 * span <= wide:
        values, span = least(values[:-span], values[span:]), 2 * span
    return least(values[: len(values) - (wide - span)], values[wide - span :]) if span < wide else values


def _grams(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of a text's word grams, the least of each window, and how many a window has."""
    size = min(_GRAM, window)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    grams = h[:n].copy()
    for k in range(1, size):
        grams *= _M1
        grams += h[k : k + n]
    grams ^= grams >> np.uint64(33)
    grams *= _M2
    grams ^= grams >> np.uint64(33)
    wide = window - size + 1
    return grams, _over(np.minimum, grams, wide), wide


def minimizers(words: list[bytes], window: int) -> np.ndarray:
    """The minimizer of every place of a text that is the least of a window around it."""
    if len(words) < window:
        return np.zeros(0, np.uint64)
    grams, least, wide = _grams(words, window)
    edge = np.zeros(wide - 1, np.uint64)
    return grams[grams == _over(np.maximum, np.concatenate([edge, least, edge]), wide)]


def segments(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows) of each segment of a text; none if it is shorter than a window."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, least, _ = _grams(words, window)
    edge = np.nonzero(np.concatenate([[True], least[1:] != least[:-1]]))[0]
    sizes = np.diff(np.append(edge, len(least)))
    if sizes.max() > _RUN:
        edge = np.concatenate([np.arange(b, b + s, _RUN) for b, s in zip(edge, sizes, strict=True)])
        sizes = np.diff(np.append(edge, len(least)))
    return least[edge], edge, sizes


def _minimizers(window: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [minimizers(words_of(t), window) for t in batch.column(0).to_pylist()]
            values, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *some]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["m", "n"])

    return count


_PLACED = "m long, s long, start long, windows long, words binary"


def _occurrences(window: int, may_repeat):
    """Segments whose minimizer may repeat; the words of each are sent once by a task, as far as it remembers."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            refs, out = [], ([], [], [], [], [])
            for row, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text)
                m, first, sizes = segments(words, window)
                for k in np.nonzero(membership.among(may_repeat.value, m))[0]:
                    at, n = int(first[k]), int(sizes[k])
                    body = b" ".join(words[at : at + n + window - 1])
                    key = (int(m[k]), xxhash.xxh3_64_intdigest(body))
                    new = key not in sent
                    if new:
                        if len(sent) >= _REMEMBERED:
                            sent.clear()
                        sent.add(key)
                    for column, value in zip(out, (*key, at, n, body if new else None), strict=True):
                        column.append(value)
                    refs.append(row)
            own = batch.select(["named", "id", "h", "g"]).take(pa.array(refs, pa.int64()))
            signed = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in out[:2]]
            found = [*own.columns, *signed, pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())]
            yield pa.RecordBatch.from_arrays(found, ["named", "id", "h", "g", "m", "s", "start", "windows", "words"])

    return find


_OF = ["named", "id", "h", "g"]


def _earliest(found: DataFrame) -> DataFrame:
    """(m, s, first, windows, words): each segment once, with the first row and place that has it."""
    return found.groupBy("m", "s").agg(F.min(F.struct(*_OF, "start")).alias("first"), F.first("windows").alias("windows"), F.max("words").alias("words"))


def _later(found: DataFrame, firsts: DataFrame, window: int) -> DataFrame:
    """Spans of the segments that occur earlier as a whole."""
    met = found.drop("words", "windows").join(firsts.select("m", "s", "first", "windows"), ["m", "s"])
    return met.where(F.struct(*_OF, "start") != F.col("first")).select(*_OF, "start", (F.col("windows") + window - 1).alias("n"))


def _as_windows(window: int):
    """Segments taken apart into their windows."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            refs, hashes, starts, bodies = [], [], [], []
            for row, (start, n, body) in enumerate(zip(frame["start"], frame["windows"], frame["words"], strict=True)):
                words = body.split(b" ")
                for k in range(n):
                    bodies.append(b" ".join(words[k : k + window]))
                    hashes.append((xxhash.xxh3_64_intdigest(bodies[-1], 1), xxhash.xxh3_64_intdigest(bodies[-1], 2)))
                    refs.append(row)
                    starts.append(start + k)
            own = frame[_OF].iloc[refs].reset_index(drop=True)
            m, s = np.array(hashes, np.uint64).reshape(-1, 2).view(np.int64).T
            yield own.assign(m=m, s=s, start=np.array(starts, np.int64), windows=1, words=bodies)

    return split


def _search(window: int, part_words: int = 1 << 16):
    """Spans of a shard's windows that begin earlier in it: builds the index, then streams the segments against it."""

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values([*_OF, "start"], ignore_index=True)
        ids: dict[bytes, int] = {}
        texts = [[ids.setdefault(w, len(ids) + 1) for w in body.split(b" ")] for body in shard["words"]]
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + 1)
        words = np.zeros(ends[-1], np.int64)
        inner = np.ones(len(words), bool)
        inner[ends - 1] = False
        words[inner] = np.concatenate([np.array(t, np.int64) for t in texts])
        index = FMIndex(words, window)
        text_at, refs, starts, lengths = ends - sizes - 1, [], [], []
        # So many segments at a time as have some tens of thousands of words.
        edges = np.unique(np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + part_words, part_words)))
        for a, b in zip(edges, np.append(edges[1:], len(texts)), strict=True):
            if a == b:
                continue
            patterns = words[inner][sizes[:a].sum() : sizes[:b].sum()]
            found, first = index.matching_statistics(patterns, np.cumsum(sizes[a:b]))
            own = np.repeat(text_at[a:b], sizes[a:b]) + np.arange(len(patterns)) - np.repeat(np.cumsum(sizes[a:b]) - sizes[a:b], sizes[a:b])
            again = (found == window) & (first < own)
            of = np.repeat(np.arange(a, b), sizes[a:b])
            hit = np.nonzero(again)[0]
            if not len(hit):
                continue
            # Windows side by side in one segment are one interval.
            edge = np.nonzero(np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(of[hit]) > 0)]))[0]
            run = np.diff(np.append(edge, len(hit)))
            of_run = of[hit[edge]]
            refs.append(of_run)
            starts.append(shard["start"].to_numpy()[of_run] + own[hit[edge]] - text_at[of_run])
            lengths.append(run + window - 1)
        none = np.zeros(0, np.int64)
        refs, starts, lengths = (np.concatenate([none, *x]).astype(np.int64) for x in (refs, starts, lengths))
        return shard[_OF].iloc[refs].reset_index(drop=True).assign(start=starts, n=lengths)

    return search


def _flat(firsts: DataFrame) -> DataFrame:
    return firsts.select("m", "s", "first.*", "windows", "words")


def repeated_spans(texts: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, hot_segments: int = HOT_SEGMENTS, bits: int = membership.BITS) -> DataFrame:
    """(named, id, h, g, start, n): runs of words, possibly overlapping, that are covered by windows which begin earlier.

    ``texts`` has (named, id, h, g, text as binary), one row for each distinct text; (named, id, h, g) is its order.
    """
    spark = texts.sparkSession
    counted = texts.select("text").mapInArrow(_minimizers(window), "m long, n long")
    # A task adds up what it reads, batch by batch; the rest is dealt by minimizer at once.
    repeated = materialize(counted.repartition("m").groupBy("m").agg(F.sum("n").alias("n")).where("n > 1").select("m"), "substring_repeated")
    filter_bits = spark.sparkContext.broadcast(membership.as_bits(membership.bitmaps(F.col("m"), repeated, bits), bits))
    id_type = texts.schema["id"].dataType.simpleString()
    of = f"named boolean, id {id_type}, h long, g long"
    found = materialize(texts.select(*_OF, "text").mapInArrow(_occurrences(window, filter_bits), f"{of}, {_PLACED}"), "substring_found")
    firsts = materialize(_earliest(found), "substring_firsts")
    spans = [_later(found, firsts, window)]
    hot = materialize(firsts.groupBy("m").agg(F.count("*").alias("unlike")).where(F.col("unlike") > hot_segments).select("m"), "substring_hot")
    indexed = _flat(firsts)
    if not hot.isEmpty():
        placed = f"{of}, {_PLACED}"
        single = materialize(_flat(firsts.join(hot, "m", "left_semi")).mapInPandas(_as_windows(window), placed), "substring_windows")
        alone = materialize(_earliest(single), "substring_alone")
        spans.append(_later(single, alone, window))
        indexed = _flat(firsts.join(hot, "m", "left_anti")).unionByName(_flat(alone))
    total = indexed.agg(F.sum(F.col("windows") + window - 1).alias("n")).first()["n"] or 0
    shards = int(total // shard_words) + 1
    dealt = indexed.withColumn("shard", F.pmod(F.xxhash64("m"), F.lit(shards)))
    spans.append(dealt.groupBy("shard").applyInPandas(_search(window), f"{of}, start long, n long"))
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def _left(window: int):
    """Counts of words and removed ones, and what is left of each text; ``copy`` texts lose every window."""

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, copy, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "copy", "spans")), strict=True):
                words = words_of(text)
                if copy and len(words) >= window:
                    left = []
                elif spans:
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, [s["start"] for s in spans], 1)
                    np.add.at(depth, [s["start"] + s["n"] for s in spans], -1)
                    left = [words[i] for i in np.nonzero(np.cumsum(depth[:-1]) == 0)[0]]
                else:
                    left = words
                counts.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            new = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *new], ["id", "n_words", "n_removed", "kept"])

    return leave


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, and ``kept``, the words left, joined by one blank.

    A word goes if a window that covers it has the same words as one that begins earlier: in a text of a smaller id, or
    earlier in the same text.  Windows are judged on the input.  A null id is smaller than any other;
    of unlike texts with one id that of the smaller hash is earlier, and rows that are equal in both are one text, with
    equal results.  Null texts have no words; texts shorter than a window lose none.  An empty table gives an
    empty one; other columns are ignored.
    """
    text = F.col(text_col)
    key = F.col(id_col)
    zero = F.lit("0").cast(docs.schema[id_col].dataType)
    rows = docs.select(
        key.isNotNull().alias("named"), F.coalesce(key, zero).alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"), text.cast("binary").alias("text")
    )
    groups = rows.select("named", "id", "h", "g").groupBy("h", "g").agg(F.min(F.struct("named", "id")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copied = materialize(groups, "substring_copied")
    bits = options.get("bits", membership.BITS)
    marked = membership.with_membership(rows, F.col("h"), membership.bitmaps(F.col("h"), copied, bits), "maybe", bits)
    single = marked.where(~F.col("maybe")).drop("maybe").withColumn("copy", F.lit(False))
    several = marked.where("maybe").drop("maybe").join(copied, ["h", "g"], "left")
    several = materialize(several.withColumn("copy", F.coalesce(F.struct("named", "id") != F.col("first"), F.lit(False))).drop("first"), "substring_several")
    originals = several.where(~F.col("copy")).dropDuplicates(["h", "g"]).drop("copy")
    spans = repeated_spans(single.drop("copy").unionByName(originals), window, **options)
    of_text = spans.groupBy("h", "g").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    lists = materialize(of_text, "substring_spans")
    every = single.unionByName(several.select(*single.columns))
    every = membership.with_membership(every, F.col("h"), membership.bitmaps(F.col("h"), lists, bits), "maybe", bits)
    plain = every.where(~F.col("maybe")).withColumn("spans", F.lit(None).cast(lists.schema["spans"].dataType))
    met = every.where("maybe").join(lists, ["h", "g"], "left")
    whole = plain.unionByName(met).select(F.when(F.col("named"), F.col("id")).alias("id"), "text", "copy", "spans")
    id_type = docs.schema[id_col].dataType.simpleString()
    out = whole.mapInArrow(_left(window), f"id {id_type}, n_words long, n_removed long, kept binary")
    return out.withColumnRenamed("id", id_col)
