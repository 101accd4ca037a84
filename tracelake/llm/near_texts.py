"""Near-duplicate texts by word shingles, found through wide SimHash fingerprints and bands of minima.

A link is a Jaccard similarity of ``similarity`` or more of two texts' sets of ``shingle_words``-word
shingles.  Two ways find candidates, both by tables of segments.  A SimHash fingerprint of 256 bits over a text's
distinct words moves little under scattered edits: it is cut into eight 32-bit segments, the radius-1 ball of every
segment is enumerated and looked up in the table of that segment, and the complete distance of what is found
is checked.  A passage that one copy lacks moves it far, though.  So the least hashes of the shingles under 64
permutations make sixteen more segments of four each; whatever is edited, texts at 0.8 agree in one of them but for
(1 - 0.8^4)^16 < 0.0002 of them, and what is found is checked by how many of the 64 agree.  That leaves
candidate groups, inside which shingle sets alone decide.

Texts with the same words are one class, whatever their number.  Segment values and candidate groups with
many classes are compared in blocks dealt over tasks; a task returns a spanning forest of the links it
sees, so a large group leaves no quadratic output.  Rows are told apart by id and 128 bits of text, so
null and repeated ids need no care, and texts are shuffled only where they are compared or removed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm import membership
from tracelake.llm.text import unused
from tracelake.operators.components import connected_components
from tracelake.storage import materialize

#: 64-bit words of a fingerprint.
WIDTH = 4
#: Bits of the whole fingerprint in which texts may differ and be candidates.
MAX_BITS = 44
#: Bands of minima and minima of a band; of the 64 minima so many are to agree (0.8 of them do at similarity 0.8, give or take 0.05).
BANDS, BAND, AGREE = 16, 4, 38
_FACTORS = np.array([xxhash.xxh3_64_intdigest(b"factor %d" % i) | 1 for i in range(BANDS * BAND)], np.uint64)
_SHIFTS = np.array([xxhash.xxh3_64_intdigest(b"shift %d" % i) for i in range(BANDS * BAND)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Classes, and bytes of text, of one block.
BLOCK_CLASSES, BLOCK_BYTES = 1024, 32 << 20
#: Words whose bits a Python worker remembers (256 bytes each).
_REMEMBERED = 100_000


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles, of the whole sequence if it is shorter; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        joined = [b" ".join(words)]
    else:
        joined = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(s) for s in joined), np.uint64))


class _WordBits:
    """The 256 bits of each word, remembered up to a bound."""

    def __init__(self, bound: int = _REMEMBERED):
        self._at: dict[bytes, int] = {}
        self._bits = np.zeros((bound, 64 * WIDTH), np.uint8)

    def fingerprint(self, words: list[bytes]) -> np.ndarray:
        """Signed 64-bit words of the majority of the distinct words' bits; zero without words."""
        distinct = set(words)
        if not distinct:
            return np.zeros(WIDTH, np.int64)
        ones, bound = np.zeros(64 * WIDTH, np.int64), len(self._bits)
        rest = list(distinct)
        for begin in range(0, len(rest), bound // 2):
            some = rest[begin : begin + bound // 2]
            new = [w for w in some if w not in self._at]
            if len(self._at) + len(new) > bound:
                self._at.clear()
                new = some
            if new:
                digests = b"".join(xxhash.xxh3_128_digest(w, 1) + xxhash.xxh3_128_digest(w, 2) for w in new)
                first = len(self._at)
                self._bits[first : first + len(new)] = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8 * WIDTH), axis=1)
                self._at.update(zip(new, range(first, first + len(new)), strict=True))
            ones += self._bits[[self._at[w] for w in some]].sum(axis=0, dtype=np.int64)
        return np.packbits(ones * 2 > len(distinct)).view("<i8").astype(np.int64)


def minima(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bands of a text's least shingle hashes as one number each, and a byte of every minimum, eight to a number."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        grams = grams * _MIX + h[k : k + n]
    grams ^= grams >> np.uint64(29)
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max)
    for at in range(0, n, 4096):
        mixed = grams[at : at + 4096, None] * _FACTORS + _SHIFTS
        # The high half of a product depends on every bit; the low one does not.
        least = np.minimum(least, (mixed >> np.uint64(32)).min(axis=0))
    bands = [xxhash.xxh3_64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, BAND))]
    return np.array(bands, np.uint64).view(np.int64), (least * _MIX >> np.uint64(56)).astype(np.uint8).view(np.int64)


def _signature_udf(shingle_words: int):
    memory: list[_WordBits] = []

    @F.pandas_udf("key binary, f array<long>, bands array<long>, sketch array<long>, bytes long")
    def signature(texts: pd.Series) -> pd.DataFrame:
        if not memory:
            memory.append(_WordBits())
        rows = []
        for text in texts:  # the words of one text at a time
            words = words_of(text)
            # A word holds no white space, so the joined words are the sequence.
            joined = b" ".join(words)
            rows.append((xxhash.xxh3_128_digest(joined), memory[0].fingerprint(words), *minima(words, shingle_words), len(joined)))
        return pd.DataFrame(rows, columns=["key", "f", "bands", "sketch", "bytes"])

    return signature


def _near(a: Column, b: Column, max_bits: int) -> Column:
    apart = lambda i: F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return sum((apart(i) for i in range(1, WIDTH)), apart(0)) <= max_bits


#: The lowest bit of every byte.
_ONES = 0x0101010101010101


def _agree(a: Column, b: Column) -> Column:
    """Bytes that two sketches have in common."""

    def unlike(i: int) -> Column:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        # Folded three times, a byte's lowest bit is set if any of its bits was.
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(F.lit(_ONES)))

    n = BANDS * BAND // 8
    return F.lit(8 * n) - sum((unlike(i) for i in range(1, n)), unlike(0))


@dataclass(frozen=True)
class Way:
    """How candidates are found: what of a class is compared, its segment values, the values that it looks up for
    one of them, and the check of two classes, on columns and on rows of numbers."""

    column: str
    values: Callable[[], Column]
    ball: Callable[[Column], Column]
    near: Callable[[Column, Column], Column]
    near_rows: Callable[[np.ndarray, np.ndarray], np.ndarray]


def by_bits(max_bits: int) -> Way:
    """Fingerprints that agree in a 32-bit segment up to one bit, at ``max_bits`` or less."""
    low = F.lit(0xFFFFFFFF)
    # A value holds the segment's number above its 32 bits.
    halves = lambda: [h for i in range(WIDTH) for h in (F.shiftrightunsigned(F.get("f", F.lit(i)), 32), F.get("f", F.lit(i)).bitwiseAND(low))]
    flips = lambda val: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: val.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    return Way(
        "f", lambda: F.array(*[h + (k << 32) for k, h in enumerate(halves())]),
        # Of two values that differ in one bit, the one with the 0 there finds the other.
        lambda val: F.array_union(F.array(val), flips(val)), lambda a, b: _near(a, b, max_bits), lambda one, many: np.bitwise_count(one ^ many).sum(axis=1) <= max_bits,
    )


def by_minima(agree: int) -> Way:
    """Texts that agree in a band of minima, and in ``agree`` of all the minima."""
    count = lambda one, many: (one.view(np.uint8) == np.ascontiguousarray(many).view(np.uint8)).sum(axis=1)
    return Way("sketch", lambda: F.col("bands"), lambda val: F.array(val), lambda a, b: _agree(a, b) >= agree, lambda one, many: count(one, many) >= agree)


def _blocks(rows: DataFrame, sizes: DataFrame, group: str, node: str) -> DataFrame:
    """``rows`` with i, j and ``left`` for every pair of blocks, i <= j, that they take part in; ``sizes`` has (group, parts)."""
    sized = rows.join(sizes, group).withColumn("own", F.pmod(F.xxhash64(F.lit(3), node), F.col("parts")).cast("int")).withColumn("parts", F.col("parts").cast("int"))
    ahead = sized.withColumn("j", F.explode(F.sequence(F.col("own"), F.col("parts") - 1))).withColumnRenamed("own", "i").withColumn("left", F.lit(True))
    behind = sized.where(F.col("own") > 0).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own") - 1))).withColumnRenamed("own", "j").withColumn("left", F.lit(False))
    return ahead.unionByName(behind).drop("parts")


def _forest(group: pd.DataFrame, linked) -> list[tuple[int, int]]:
    """Places (a, b) of the links of a spanning forest of a block or between two; ``linked(a, bs)`` says which of bs link with a."""
    left = group["left"].to_numpy(dtype=bool)
    ours = np.nonzero(left)[0]
    within = group["i"].iloc[0] == group["j"].iloc[0]
    theirs = ours if within else np.nonzero(~left)[0]
    label, out = np.arange(len(group)), []
    for a in ours:
        other = theirs[label[theirs] != label[a]]
        if not len(other):
            continue
        for b in linked(a, other):
            if label[a] != label[b]:
                out.append((int(a), int(b)))
                label[label == label[b]] = label[a]
    return out


def _bits(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(f, dtype=np.int64) for f in column]).view(np.uint64)


def _checked(pairs: DataFrame, classes: DataFrame, way: Way) -> DataFrame:
    """The pairs (a, b) that are near enough."""
    left, right = (classes.select(F.col("node").alias(c), F.col(way.column).alias(f"f{c}")) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").where(way.near(F.col("fa"), F.col("fb"))).select("a", "b")


def candidate_links(classes: DataFrame, way: Way, hot_bucket: int = 128, block: int = BLOCK_CLASSES) -> DataFrame:
    """Links (a, b) whose closure is that of all pairs of nodes that meet in a segment and are near.

    ``classes`` has node and what ``way`` compares.  Nodes with an equal segment are first held against the smallest of them
    alone; what that joins is one part, and later only nodes of different parts meet, so a group of many
    near copies leaves no pairs.  Segment values with more than ``hot_bucket`` nodes of several parts are
    compared in blocks, which leave spanning forests.
    """
    values = classes.select("node", F.explode(way.values()).alias("val"))
    centres = values.groupBy("val").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("val", "a")
    spokes = values.join(centres, "val").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()
    star = materialize(_checked(spokes, classes, way), "near_star")
    joined = connected_components(star, "a", "b").withColumnRenamed("component", "part")
    parts = joined.withColumnsRenamed({"node": "of"})
    parted = materialize(classes.join(parts, F.col("node") == F.col("of"), "left").select(*classes.columns, F.coalesce("part", "node").alias("part")), "near_parted")

    table = parted.select("node", "part", F.explode(way.values()).alias("val"))
    probes = table.select(F.col("node").alias("probe"), F.col("part").alias("probe_part"), F.explode(way.ball(F.col("val"))).alias("val"))
    several = (F.count("*") > hot_bucket) & (F.min("part") != F.max("part"))
    hot = materialize(table.groupBy("val").agg(several.alias("hot")).where("hot").select("val"), "near_hot")
    n_hot = hot.count()
    met = probes.join(table, ["val"]).where(F.col("probe_part") != F.col("part"))
    if n_hot:
        met = met.join(hot, "val", "left_anti")
    pairs = materialize(met.select(F.least("probe", "node").alias("a"), F.greatest("probe", "node").alias("b")).distinct(), "near_met")
    found = star.unionByName(_checked(pairs, classes, way))
    if not n_hot:
        return found
    near = parted.select("node", "part", F.col(way.column).alias("f"))
    crowd = materialize(probes.join(hot, "val").select("val", F.col("probe").alias("node")).distinct().join(near, "node"), "near_crowd")
    sizes = crowd.groupBy("val").agg(F.ceil(F.count("*") / block).cast("long").alias("parts"))
    near_rows = way.near_rows  # ``way`` itself holds columns, which no task can be sent

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        bits, nodes, part = _bits(group["f"]), group["node"].to_numpy(), group["part"].to_numpy()

        def linked(a: int, bs: np.ndarray) -> np.ndarray:
            bs = bs[part[bs] != part[a]]
            return bs[near_rows(bits[a], bits[bs])]

        links = _forest(group, linked)
        return pd.DataFrame({"a": [nodes[a] for a, _ in links], "b": [nodes[b] for _, b in links]}, dtype=np.int64)

    dealt = _blocks(crowd, materialize(sizes, "near_crowd_parts"), "val", "node")
    return found.unionByName(dealt.groupBy("val", "i", "j").applyInPandas(compare, "a long, b long"))


def _shared_shingles(sets: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Postings: where each shingle's rows begin and the rows themselves, and each set as places in them."""
    sizes = np.array([len(s) for s in sets])
    every, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(inverse, kind="stable")
    starts = np.searchsorted(inverse[order], np.arange(len(every) + 1))
    places = np.split(inverse, np.cumsum(sizes)[:-1])
    return [rows[order], starts], places


def verified_links(members: DataFrame, similarity: float, shingle_words: int, block: int, block_bytes: int) -> DataFrame:
    """(a, b) keys of a spanning forest of the links inside each group; ``members`` has (group, key, bytes, text)."""
    parts = members.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("bytes") / block_bytes), F.lit(1)).cast("long").alias("parts"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        keys = group["key"].tolist()
        sets = [shingles(words_of(t), shingle_words) for t in group["text"]]
        sizes = np.array([len(s) for s in sets])
        (rows, starts), places = _shared_shingles(sets)

        def linked(a: int, others: np.ndarray) -> np.ndarray:
            if not len(others) or not sizes[a]:
                return others[:0]
            lists = [rows[starts[p] : starts[p + 1]] for p in places[a]]
            common = np.bincount(np.concatenate(lists), minlength=len(sets))[others]
            return others[common >= similarity * (sizes[a] + sizes[others] - common)]

        links = _forest(group, linked)
        return pd.DataFrame({"a": [keys[a] for a, _ in links], "b": [keys[b] for _, b in links]}, columns=["a", "b"])

    dealt = _blocks(members.select("group", "key", "text"), materialize(parts, "near_parts"), "group", "key")
    return dealt.groupBy("group", "i", "j").applyInPandas(compare, "a binary, b binary")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))


def near_text_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle_words: int = 5, max_bits: int = MAX_BITS, hot_bucket: int = 128,
    block: int = BLOCK_CLASSES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, h, g, kept) for every row of ``docs``: id, two hashes of the text, and (id, h, g) of the row that stands for its group.

    Groups are what links reach.  Texts with the same words are linked, those without words, null ones
    among them, with each other.  The row that stands for a group is that of the smallest id, then the
    smallest hashes; a null id stands only for rows that all have none.
    """
    rows = _rows(docs, id_col, text_col)
    signed = materialize(rows.select("id", "h", "g", _signature_udf(shingle_words)(F.col("text")).alias("s")).select("id", "h", "g", "s.*"), "near_rows")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "g")).alias("first")
    every = [F.first(c).alias(c) for c in ("f", "bands", "sketch", "bytes")]
    classes = materialize(signed.groupBy("key").agg(first, *every).withColumn("node", F.xxhash64("key")), "near_classes")
    worded = classes.where(F.col("bytes") > 0)
    found = [candidate_links(worded.select("node", *columns), way, hot_bucket, block) for way, columns in ((by_bits(max_bits), ["f"]), (by_minima(AGREE), ["bands", "sketch"]))]
    groups = connected_components(found[0].unionByName(found[1]), "a", "b").withColumnsRenamed({"component": "group"})
    wanted = worded.join(groups, "node").select("group", "key", "bytes", "first.id", "first.h", "first.g").withColumnsRenamed({"id": "wid", "h": "wh", "g": "wg"})
    wanted = materialize(wanted, "near_wanted")
    # Only texts that may be wanted are shuffled to be compared.
    may = membership.with_membership(rows, F.col("h"), membership.bitmaps(F.col("wh"), wanted), "maybe").where("maybe").drop("maybe")
    same = (F.col("h") == F.col("wh")) & (F.col("g") == F.col("wg")) & F.col("id").eqNullSafe(F.col("wid"))
    fetched = may.join(wanted.hint("shuffle_hash"), same).select("group", "key", "bytes", "text")
    # A row repeated many times is one text; it is reduced before it is dealt out.
    members = materialize(fetched.groupBy("group", "key").agg(F.first("bytes").alias("bytes"), F.first("text").alias("text")), "near_members")
    links = materialize(verified_links(members, similarity, shingle_words, block, block_bytes), "near_links")
    parts = connected_components(links, "a", "b").withColumnsRenamed({"node": "key", "component": "part"})
    labelled = materialize(classes.select("key", "first").join(parts, "key", "left").select("key", "first", F.coalesce("part", "key").alias("part")), "near_parts_of")
    least = labelled.groupBy("part").agg(F.min("first").alias("best"))
    named = materialize(labelled.join(least, "part").select("key", F.struct("best.id", "best.h", "best.g").alias("kept")), "near_named")
    return signed.select("id", "h", "g", "key").join(named, "key").select("id", "h", "g", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicate texts; columns unchanged.

    The row that stands for its group, as ``near_text_groups`` says, stays; of equal rows (id and text)
    of that kind one stays, that of the smallest hash of all columns.  Every other row goes.  An empty
    table gives an empty one.
    """
    chosen = materialize(near_text_groups(docs.select(id_col, text_col), id_col, text_col, **options), "near_chosen")
    own = F.struct("id", "h", "g")
    drops = chosen.where(~own.eqNullSafe(F.col("kept"))).select("id", "h", "g").distinct()
    again = materialize(chosen.where(own.eqNullSafe(F.col("kept"))).groupBy("id", "h", "g").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "near_again")
    text, names = F.col(f"`{text_col}`"), {c: unused(docs, f"near_{c}") for c in ("id", "h", "g")}
    key = [F.xxhash64(text), F.xxhash64(F.lit(1), text)]

    def same(table: DataFrame) -> tuple[DataFrame, Column]:
        named = table.withColumnsRenamed(names)
        return named, F.col(f"`{id_col}`").eqNullSafe(F.col(names["id"])) & (key[0] == F.col(names["h"])) & (key[1] == F.col(names["g"]))

    # Texts that may go are shuffled to what goes; the others stay where they are.
    may = unused(docs, "near_may")
    marked = membership.with_membership(docs, key[0], membership.bitmaps(F.col("h"), drops), may)
    gone, match = same(drops)
    kept = marked.where(~F.col(may)).unionByName(marked.where(may).join(gone.hint("shuffle_hash"), match, "left_anti")).drop(may)
    if again.isEmpty():
        return kept
    repeated, match = same(again)
    once = kept.join(repeated, match, "left_anti")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = docs.join(repeated, match, "left_semi").select(row.alias("row"), F.xxhash64(row).alias("at"), F.col(id_col).alias("id"), key[0].alias("h"), key[1].alias("g"))
    return once.unionByName(several.groupBy("id", "h", "g").agg(F.min_by("row", "at").alias("row")).select("row.*"))
