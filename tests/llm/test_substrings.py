"""The FM-index against plain search, and repeated passages against every window of every text."""

import random

import numpy as np
import pytest

from tracelake.llm import membership, substrings
from tracelake.llm.fm_index import FMIndex, WaveletMatrix

SCHEMA = "doc_id long, text string, m long, s string, first string, words string, spans string"


def test_wavelet_rank():
    rng = np.random.default_rng(1)
    for size, n in ((1, 5), (2, 64), (7, 200), (300, 1000)):
        values = rng.integers(0, size, n)
        matrix = WaveletMatrix(values, size)
        for v in range(size):
            upto = rng.integers(0, n + 1, 20)
            begin = matrix.rank(np.full(1, v), np.zeros(1, np.int64))
            assert (matrix.rank(np.full(20, v), upto) - begin == [(values[:u] == v).sum() for u in upto]).all()


@pytest.mark.parametrize("depth", [1, 2, 5, 20])
def test_matching_statistics(depth):
    rng = random.Random(depth)
    for size in (1, 2, 6):
        texts = [[rng.randint(1, size) for _ in range(rng.randint(1, 60))] for _ in range(8)]
        words = np.array([w for t in texts for w in [*t, 0]])
        index = FMIndex(words, depth)
        patterns = [*texts, *([rng.randint(-1, size + 1) for _ in range(rng.randint(1, 60))] for _ in range(8))]
        lengths, places = index.matching_statistics(np.array([w for p in patterns for w in p]), np.cumsum([len(p) for p in patterns]))
        plain = " " + " ".join(map(str, words)) + " "
        at = 0
        for p in patterns:
            for i in range(len(p)):
                found = next(k for k in range(min(depth, len(p) - i), -1, -1) if k == 0 or min(p[i : i + k]) > 0 and " " + " ".join(map(str, p[i : i + k])) + " " in plain)
                assert lengths[at] == found
                if found == depth:
                    assert list(words[places[at] : places[at] + depth]) == p[i : i + depth]
                    assert plain[: plain.index(" " + " ".join(map(str, p[i : i + depth])) + " ")].count(" ") == places[at]
                else:
                    assert places[at] == -1
                at += 1


def test_equal_windows_have_equal_minimizers():
    rng = random.Random(3)
    words = [rng.choice([b"a", b"b", b"c%d" % rng.randint(0, 9)]) for _ in range(3000)] + [b"same"] * 500
    seen = {}
    m, first, sizes = substrings.segments(words, 20)
    assert sizes.sum() == len(words) - 19 and sizes.max() <= 64 and (first == np.cumsum(sizes) - sizes).all()
    for value, at, n in zip(m, first, sizes, strict=True):
        for k in range(at, at + n):
            assert seen.setdefault(tuple(words[k : k + 20]), value) == value
    assert not len(substrings.segments(words[:19], 20)[0]) and len(substrings.segments(words[:20], 20)[0]) == 1
    assert len(substrings.segments(words[:5], 3)[0])


def slow_left(rows, window):
    """(n_words, left) of each row by every window of every text, in the order of id, nulls first, and hash."""
    texts = sorted({(i is not None, i or 0, h, t) for i, h, t in rows})
    seen, out = set(), {}
    for named, i, _, text in texts:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out[i if named else None, text] = (len(words), b" ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize(("hot", "shard", "bits"), [(5000, 400_000, 1 << 20), (2, 300, 1 << 15), (0, 50, 1 << 18)])
def test_against_every_window(spark, hot, shard, bits):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.5 else f"w{rng.randint(0, 400)}"
    passage = [[word() for _ in range(n)] for n in (6, 7, 12, 40, 150)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(passage) if rng.random() < 0.5 else [word() for _ in range(rng.randint(0, 30))]
        texts.append(rng.choice([" ", "\n", "\t \x0b"]).join(parts))
    texts += ["same " * 400, "same " * 30, "a b " * 90, None, "", " \n", "x", "ünï cödé " * 12, texts[3], texts[3], texts[5] + " more words here"]
    rows = list(enumerate(texts)) + [(3, texts[9]), (None, texts[4]), (None, texts[7]), (7, texts[7]), (7, texts[7])]
    table = spark.createDataFrame([(*r, 1, "x", "y", "z", "w") for r in rows], SCHEMA)
    hashes = [(r.doc_id, (r.h, r.g), r.text) for r in table.select("doc_id", "text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")).collect()]
    want = slow_left(hashes, 6)
    out = substrings.without_repeats(table, window=6, shard_words=shard, hot_segments=hot, bits=bits).collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, bytes(r.kept)) for r in out)
    assert got == sorted((i is not None, i or 0, want[i, t][0], want[i, t][0] - len(want[i, t][1].split()), want[i, t][1]) for i, t in rows)
    assert substrings.without_repeats(table.limit(0)).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(200_000)]
    words[150_000:150_100] = words[10:110]
    table = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    row = substrings.without_repeats(table).first()
    assert (row.n_words, row.n_removed) == (200_000, 100) and bytes(row.kept).split() == [w.encode() for w in words[:150_000] + words[150_100:]]


def test_membership_loses_nothing(spark):
    from pyspark.sql import functions as F

    keys = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("k"))
    maps = membership.bitmaps(F.col("k"), keys, 1 << 16)
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("k"), F.lit("x").alias("of_bucket"))
    marked = membership.with_membership(rows, F.col("k"), maps, "maybe", 1 << 16).collect()
    whole = membership.as_bits(maps, 1 << 16)
    theirs = membership.among(whole, np.array([r.k for r in marked]).view(np.uint64))
    assert [r.maybe for r in marked] == list(theirs)
    assert all(r.maybe for r in marked if r.id % 3 == 0) and sum(r.maybe for r in marked) < 1100 and len(marked) == 3000
