"""Near copies by kind of edit: what reaches 0.8 is linked, whatever was changed."""

import random

import numpy as np
import pytest

from tracelake.llm import near_texts

SCHEMA = "doc_id long, text string, near_may string, f string"


def edited(rng, words, kind, share):
    n = max(1, round(share * len(words)))
    at = rng.randrange(len(words) - n + 1)
    new = [f"n{rng.randint(0, 10**6)}" for _ in range(n)]
    if kind == "deleted":
        return words[:at] + words[at + n :]
    if kind == "inserted":
        return words[:at] + new + words[at:]
    if kind == "replaced":
        return words[:at] + new + words[at + n :]
    out = list(words)
    for i in rng.sample(range(len(words)), max(1, n // 5)):
        out[i] = new[0]
    return out


def similarity(a, b):
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def pairs():
    rng = random.Random(8)
    weights = 1 / np.arange(1, 3001)
    out = []
    for length in (50, 200, 1000):
        for kind in ("deleted", "inserted", "replaced", "scattered"):
            for _ in range(25):
                words = [f"z{i}" for i in rng.choices(range(3000), weights, k=length)]
                out.append((kind, length, words, edited(rng, words, kind, rng.uniform(0.02, 0.19))))
    return out


@pytest.mark.parametrize(("hot", "block"), [(128, 1024), (0, 7)])
def test_every_kind_of_edit_is_found(spark, hot, block):
    made = pairs()
    rows = [(2 * i + k, " ".join(words), "x", "y") for i, (_, _, *both) in enumerate(made) for k, words in enumerate(both)]
    got = {r.id: r.kept.id for r in near_texts.near_text_groups(spark.createDataFrame(rows, SCHEMA), hot_bucket=hot, block=block).collect()}
    near = [similarity(a, b) >= 0.8 for _, _, a, b in made]
    assert sum(near) > 150
    missed = [(kind, length) for i, (kind, length, _, _) in enumerate(made) if near[i] and got[2 * i + 1] != got[2 * i]]
    wrong = [i for i in range(len(made)) if not near[i] and got[2 * i + 1] == got[2 * i]]
    assert not missed and not wrong
    assert all(got[2 * i] == 2 * i for i in range(len(made)))


def test_agreement_of_sketches(spark):
    rng = random.Random(1)
    words = [b"w%d" % i for i in range(300)]
    rows = []
    for k in range(0, 300, 20):
        other = words[k:] + [b"v%d" % rng.randint(0, 10**6) for _ in range(k)]
        (_, a), (_, b) = near_texts.minima(words, 5), near_texts.minima(other, 5)
        rows.append((a.tolist(), b.tolist(), int((a.view(np.uint8) == b.view(np.uint8)).sum())))
    table = spark.createDataFrame(rows, "a array<long>, b array<long>, n int")
    assert all(r.n == r.got for r in table.select("n", near_texts._agree(near_texts.F.col("a"), near_texts.F.col("b")).alias("got")).collect())
    assert len(near_texts.minima([], 5)[0]) == near_texts.BANDS and len(near_texts.minima([b"a"], 5)[1]) == 8


def test_fingerprints_of_a_crowded_segment(spark):
    """Fingerprints that share one segment and differ elsewhere are compared in tasks, to which no column may be sent."""
    rng = random.Random(4)
    far = [[rng.getrandbits(31) << 32 | 7] + [rng.getrandbits(63) for _ in range(3)] for _ in range(6)]
    near = [list(far[0]), list(far[1])]
    near[0][2] ^= 0b1011 << 40
    near[1][3] ^= 0b111 << 5
    classes = spark.createDataFrame(list(enumerate(far + near)), "node long, f array<long>")
    links = near_texts.candidate_links(classes, near_texts.by_bits(44), hot_bucket=1, block=3).collect()
    assert {tuple(sorted(r)) for r in links} == {(0, 6), (1, 7)}
