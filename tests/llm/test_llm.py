"""Corpus operators against brute force, round trips and held-out accuracy, and on odd rows."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from conftest import rows_of
from pyspark.sql import functions as F

from tracelake.llm import bpe, decontaminate, embedding_dedup, labelled, line_dedup, near_texts, pieces, quality, registry, simhash, token_files, toxicity, url_lists, warc
from tracelake.llm.cover_tree import CoverTree, distances, pairs_within
from tracelake.storage import materialize, new_path

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, drop_id string, fp string, kept_id string, rank string"


def docs_of(spark, rows):
    """Documents from (id, text[, source]), with columns whose names operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y", "z", "w") for r in rows]
    return spark.createDataFrame(full, DOCS)


def reach(n, links):
    """Smallest index reachable of each of n nodes."""
    comp = list(range(n))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        comp[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(name, spark, duck, sf):
    ours, theirs = rows_of(registry.queries()[name](spark, sf).toPandas()), rows_of(duck.execute(registry.oracle_sql()[name]).df())
    assert ours == theirs


# 1: line dedup


def test_lines_by_sites(spark):
    boiler, few = "shared line on every site", "line on two sites only"
    rows = [(i, f"own text number {i} here\n{boiler}\n{few if i < 2 else 'a b'}", f"s{i}") for i in range(6)]
    rows += [(6, boiler, "s1"), (7, None, "s2"), (8, "", "s3"), (9, "  " + boiler + "\t", None), (6, boiler, "s1"), (None, boiler, "s9")]
    out = line_dedup.remove_boilerplate(docs_of(spark, rows), min_sites=5)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.text, r.n_lines, r.n_removed) for r in out.collect())
    assert got[0] == (-1, "", 1, 1)
    assert got[1] == (0, rows[0][1], 3, 0)  # first seen: stays
    assert got[2] == (1, f"own text number 1 here\n{few}", 3, 1)
    assert got[7:9] == [(6, "", 1, 1), (6, "", 1, 1)]
    assert got[9] == (7, None, 0, 0)
    assert got[10] == (8, "", 1, 0)
    assert got[11] == (9, "", 1, 1)
    assert set(docs_of(spark, rows).columns) < set(out.columns)
    assert line_dedup.remove_boilerplate(docs_of(spark, []), min_sites=2).count() == 0


@pytest.mark.parametrize("sites", [59, 60, 61])
def test_exact_count_near_the_threshold(spark, sites):
    docs = docs_of(spark, [(i, "one line here", f"s{i}") for i in range(sites)])
    assert line_dedup.boilerplate_lines(docs, min_sites=60, lg_k=4).count() == (sites >= 60)


# 2: SimHash


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprint_is_the_definition():
    for t in [None, "", " \n", "One", "A b", "É é A b c\x1cd", "the Quick brown\nfox the quick brown fox " * 3]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


@pytest.mark.parametrize("hot", [2048, 4])
def test_near_duplicates_against_all_pairs(spark, hot):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(6):
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(150)] = rng.choice(words)
            rows.append(" ".join(copy))
    rows += [None, "", " ", "x", "x", "x"]
    ids = list(range(len(rows)))
    fp = [slow_fingerprint(t) for t in rows]
    links = [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    out = simhash.near_duplicate_classes(docs_of(spark, list(zip(ids, rows))), hot_bucket=hot).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == list(zip(ids, reach(len(rows), links)))


def test_simhash_on_odd_tables(spark):
    assert simhash.near_duplicate_classes(docs_of(spark, [])).count() == 0
    out = simhash.near_duplicate_classes(docs_of(spark, [(2, "a b c d"), (2, "a b c d"), (2, "e f g h"), (None, "q r s t"), (None, "a b c d")])).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in out if r.component_id) == [("2", 2), ("2", 2), ("2", 2), ("None", 2)]


def jaccard_groups(texts):
    """Smallest index reachable over five-word shingle similarities of 0.8 or more, by all pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    near = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    return reach(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if near(sets[a], sets[b])])


@pytest.mark.parametrize(("hot", "block"), [(128, 1024), (3, 5)])
def test_near_texts_against_all_pairs(spark, hot, block):
    rng = random.Random(3)
    words, rows = [f"w{i}" for i in range(400)], []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([40, 150]))]
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    rows += [None, "", " ", "x", "x", "X ", "a b c d e", "a b c d f", "\ud7ff é", "word " * 3000]
    got = near_texts.near_text_groups(docs_of(spark, list(enumerate(rows))), hot_bucket=hot, block=block).collect()
    assert sorted((r.id, r.kept.id) for r in got) == list(enumerate(jaccard_groups(rows)))


def test_near_texts_keep_one_row_a_group(spark):
    rows = [(None, "one two three"), (None, "four five six"), (2, "seven eight"), (2, "nine ten"), (5, "copy of it"), (5, "copy of it"), (7, "Copy  of it"), (None, "nine ten"), (9, None), (8, "")]
    docs = docs_of(spark, rows)
    out = near_texts.keep_one(docs)
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == [("2", "nine ten"), ("2", "seven eight"), ("5", "copy of it"), ("8", ""), ("None", "four five six"), ("None", "one two three")]
    assert out.columns == docs.columns
    assert near_texts.keep_one(docs.where("false")).count() == 0
    assert near_texts.keep_one(docs.where("doc_id is null")).count() == 3


def test_long_texts_share_fingerprint_memory():
    own, small = near_texts._WordBits(), near_texts._WordBits(bound=8)
    for text in ("a b c d e f", "f g h i j k l m n o p q r s t u v w x y z a b", "", "a"):
        words = near_texts.words_of(text)
        assert (own.fingerprint(words) == small.fingerprint(words)).all()


def test_ball_lookup_finds_every_pair(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 120:
        x = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    signed = [int(np.uint64(x).view(np.int64)) for x in sorted(fps)]
    got = {frozenset((r.a, r.b)) for r in simhash.similar_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert got == want


# 3: embeddings


def test_cover_tree_invariants():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    x = np.vstack([x, x[:40] + 0.01 * rng.normal(size=(40, 6))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = CoverTree(x)
    for node, kids in enumerate(tree.children):
        away = distances(x[tree.members[node]], x[[tree.centre[node]]])
        assert away.max() <= tree.reach[node] + 1e-7  # rounding of a distance near 0
        if len(kids):
            assert sorted(np.concatenate([tree.members[k] for k in kids])) == sorted(tree.members[node])
            assert tree.centre[node] in [tree.centre[k] for k in kids]
    found = np.zeros((len(x), len(x)), bool)
    for a, b, _ in pairs_within(tree, tree, 0.3):
        found[np.ix_(a, b)] = True
    assert (found | (distances(x, x) > 0.3)).all()


def test_embedding_links_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8))
    vecs = [b + 0.1 * rng.normal(size=8) for b in base for _ in range(5)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(vecs)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (402, None), (403, [0.0] * 8), (404, [float("nan")] + [1.0] * 7), (405, [None] + [1.0] * 7), (406, []), (407, [1.0, 2.0]), (408, [2.0, 4.0])]
    table = spark.createDataFrame([(i, v, 1, "n") for i, v in rows], "vec_id long, embedding array<float>, label int, node string")
    out = {r.vec_id: r for r in embedding_dedup.embedding_links(table, block_rows=40, max_pivots=4).collect()}
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(i, j) for i, a in ok for j, b in ok if i != j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95]
    comp = reach(409, links)
    for i, _ in rows:
        assert out[i].n_links == sum(a == i for a, _ in links)
        assert (out[i].component_id, out[i].kept) == (comp[i], comp[i] == i)
    assert embedding_dedup.embedding_links(table.where("false")).count() == 0


def test_pairs_of_blocks_carry_names_and_each_tree_is_written_once(spark, monkeypatch):
    """Spread vectors, so that all pairs of blocks are compared: what is written grows with the blocks, not with their pairs."""
    met, plans = {}, {}
    write = embedding_dedup.materialize

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return met.setdefault(name, write(df, name))

    monkeypatch.setattr(embedding_dedup, "materialize", kept)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=16).astype(np.float32)]) for i in range(400)]
    rows += [(400 + i, rows[i][1][:15] + [rows[i][1][15] + 0.1]) for i in range(0, 400, 40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {r.vec_id: r.n_links for r in embedding_dedup.embedding_links(table, block_rows=40, max_pivots=4).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert list(out[i] for i, _ in rows) == [int(n) - 1 for n in (x @ x.T >= 0.95).sum(axis=1)]
    n = met["emb_trees"].count()
    assert n >= 8 and met["emb_pairs"].count() > 2 * n
    assert not [f for f in met["emb_trees"].schema if f.dataType.typeName() == "binary"]
    assert "tree" not in plans["emb_links"].replace("emb_trees", "")


# 4: URL lists


def test_url_list_intervals(spark):
    entries = [
        ("l", "bad.com", "add", "2024-01-01"), ("l", "bad.com", "remove", "2024-02-01"), ("l", "bad.com", "add", "2024-03-01"), ("l", "bad.com", "add", "2024-04-01"),
        ("p", "ok.com/a", "add", "2024-01-01"), ("p", "ok.com/a", "add", "2024-01-01"), ("p", "x.com", "add", "2024-01-01"), ("p", "x.com", "remove", "2024-01-01"), ("p", None, "add", "2024-01-01"),
    ]
    table = spark.createDataFrame(entries, "list string, pattern string, action string, at string").withColumn("effective_at", F.to_timestamp("at"))
    urls = [
        (1, "http://www.BAD.com/x", "2024-01-15"), (2, "http://bad.com", "2024-02-01"), (3, "https://u@bad.com:80/", "2024-05-01"), (4, "http://ok.com/a/b?q", "2024-01-01"),
        (5, "http://ok.com/ab", "2024-01-02"), (6, "http://notbad.com/", "2024-01-15"), (7, None, "2024-01-15"), (8, "junk", "2024-01-15"), (9, "http://bad.com", None), (10, "http://x.com/", "2024-02-02"), (1, "http://www.BAD.com/x", "2024-01-15"),
    ]
    captures = spark.createDataFrame(urls, "id long, url string, at string").withColumn("fetched_at", F.to_timestamp("at"))
    out = url_lists.listed_captures(captures, table)
    assert sorted((r.id, r.lists) for r in out.collect() if r.blocked) == [(1, "l"), (1, "l"), (3, "l"), (4, "p")]
    assert out.count() == len(urls)
    assert url_lists.listed_captures(captures, table.where("false")).where("blocked").count() == 0


def test_url_lists_have_no_depth_limit(spark):
    host, path = ".".join("abcdefghijk") + ".com", "/".join("0123456789")
    patterns = [host, "k.com", "com", "ok.com/" + path, "ok.com/" + path + "/last", host.replace("a.", "z.", 1)]
    entries = spark.createDataFrame([("l", p, "add", "2024-01-01") for p in patterns], "list string, pattern string, action string, at string").withColumn("effective_at", F.to_timestamp("at"))
    urls = [(1, f"http://{host}/", 3), (2, f"http://x.{host}", 3), (3, f"http://ok.com/{path}", 2), (4, f"http://ok.com//{path}/last/more?q", 3), (5, f"http://ok.com/{path[:-2]}", 1)]
    captures = spark.createDataFrame([(i, u, "2024-02-01") for i, u, _ in urls], "id long, url string, at string").withColumn("fetched_at", F.to_timestamp("at"))
    out = url_lists.listed_captures(captures, entries)
    assert sorted((r.id, r.n_entries) for r in out.collect()) == [(i, n) for i, _, n in urls]


# 5: decontamination


def test_windows_against_a_scan(spark):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 10, 30])))) for i in range(12)] + [(50, None), (51, "..."), (3, "dup item text here for one"), (None, "null id item of ten words or so it may be")]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(80)]
        if i % 3 == 0:
            item = (items[i % 12][1] or "").split()
            text[20 : 20 + len(item)] = item
        rows.append((i, ", ".join(text).upper() + "."))
    rows += [(100, None), (101, ""), (102, "!!"), (5, rows[5][1]), (None, rows[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(docs_of(spark, rows), benchmark)
    split = lambda t: [w for w in "".join(c.lower() if c.isalnum() else " " for c in t or "").split()]
    want = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            v = split(text)
            n = min(10, len(v))
            grams = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if v else set()
            for s in range(len(w) - n + 1 if v else 0):
                if tuple(w[s : s + n]) in grams:
                    hit |= set(range(s, s + n))
                    found.add(item)
        ids = sorted(str(x) for x in found if x is not None)
        want.append((str(i), len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    got = [(str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()]
    assert sorted(got) == sorted(want)
    clean = decontaminate.drop_contaminated(docs_of(spark, rows), benchmark)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(w[0] for w in want if not w[-1])
    assert decontaminate.contamination(docs_of(spark, []), benchmark).count() == 0
    assert decontaminate.contamination(docs_of(spark, rows), benchmark.where("false")).where("contaminated").count() == 0


def test_proximity(spark):
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = docs_of(spark, [(1, "alpha beta gamma delta"), (2, "alpha x beta gamma delta"), (3, "alpha " + "x " * 30 + "beta gamma delta")])
    got = sorted(r.doc_id for r in decontaminate.proximity_matches(docs, benchmark, slop=2).collect())
    assert 1 in got and 2 in got and 3 not in got


# 6 and 10: tokens

ODD = ["", "  a", "a  b", "a\n b", "a \nb", " \n \ny", "a ", "it's 's  don't", "<|endoftext|> x", "a\x1c b", "日本語 テキスト 123  4", "é" * 50, "a" * 500, " " * 100, "🙂🙂 👍🏽"]


def odd_texts(n):
    rng = random.Random(1)
    return ODD + ["".join(rng.choice("ab \n\t'sé.!1日\x1c") for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def own():
    return bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def reference_encoding():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_tiktokens(own, reference_encoding):
    for t in odd_texts(3000):
        ids = own.encode(t)
        assert ids == reference_encoding.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_prefix_table_appends_and_edits(own):
    rng = random.Random(2)
    table = bpe.PrefixTable(own.ranks, b"")
    for _ in range(150):
        n = len(table.data)
        start = rng.randint(0, n)
        stop = min(n, start + rng.randint(0, 3))
        piece = bytes(rng.choice(b"aeinrst onth") for _ in range(rng.randint(0, 6)))
        table.append(piece) if rng.random() < 0.5 else table.replace(start, stop, piece)
        assert table.last == bpe.PrefixTable(own.ranks, table.data).last
    long = bpe.PrefixTable(own.ranks, b"the rain in spain " * 200)
    assert long.replace(100, 101, b"x") < 500


def test_forgetting_changes_nothing(own):
    small = pieces.PieceEncoder(own.matches, own._encode_matches, bound=2000)
    for t in odd_texts(100):
        assert small(t) == own.encode_packed(t)
        small.learn([t, "x" * 5000, "a " + "y" * 5000])
        assert small(t) == own.encode_packed(t)
        assert max(map(len, small._of_piece), default=0) <= pieces._LONGEST


def test_encode_documents(spark, own):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "x" * 30000), (1, "hello world"), (None, "é")]
    docs = docs_of(spark, rows)
    out = bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = sorted((str(r.doc_id), list(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(i), own.encode(t), len(own.encode(t)), sha(" ".join(map(str, own.encode(t))).encode()), sha((t or "").encode())) for i, t in rows)
    assert got == want
    back = bpe.decode_documents(out, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert sorted(bytes(r.data) for r in back.collect()) == sorted((t or "").encode() for _, t in rows)
    assert bpe.encode_documents(docs.where("false"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_token_files(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = odd_texts(200)
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "b"), (901, "a")]
    random.Random(0).shuffle(rows)
    folder, path, pattern = new_path(spark, "tokens"), P.path("byte_bpe_50k.json"), P.PATTERN
    token_files.write_token_files(docs_of(spark, rows), folder, lambda: token_files.file_tokenizer(path, pattern, added_tokens=True))
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in token_files.read_documents(spark, folder, with_ids=True).collect())
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert got == want
    empty = new_path(spark, "tokens")
    token_files.write_token_files(docs_of(spark, []), empty, lambda: token_files.file_tokenizer(path, pattern))
    assert token_files.read_documents(spark, empty).count() == 0


def test_op6_gives_added_tokens_their_id(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext |>", "no token here", *odd_texts(50)]
    docs_of(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in registry.queries()["op6_token_files"](spark, str(tmp_path)).collect())
    start, want = 0, []
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


# 7 and 9: classifiers


@pytest.mark.parametrize(("name", "label", "least"), [("op7_toxicity", "toxic", 0.9), ("op9_quality_knn", "quality", 0.95)])
def test_held_out_accuracy(name, label, least, spark):
    folder = "/root/testdata/sf0.01"
    out = registry.queries()[name](spark, folder)
    rows = out.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", label).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r[label] for r in rows) / len(rows) >= least


def one_vote(model, text):
    """The vote for one document in double precision, over all labelled vectors one by one."""
    counts = quality.term_counts(text)
    vector = model.project(counts[None])[0]
    near = sorted(((sum(float(a) * float(b) for a, b in zip(vector, v)), y) for v, y in zip(model.vectors, model.labels)), reverse=True)[: model.neighbours]
    weight = [max(c, 0.0) ** 2 for c, _ in near]
    return sum(w * y for w, (_, y) in zip(weight, near)) / sum(weight) if sum(weight) > 1e-9 else model.prior


def test_quality_is_the_vote_one_by_one(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels, labelled.fold("doc_id", 4) != 2)
    texts = {r.doc_id: r.text for r in docs.collect()}
    # Neighbours whose similarities agree to single precision may change places.
    far = [i for i in (r for r in quality.score_documents(docs, model).collect()) if abs(i.score - one_vote(model, texts[i.doc_id])) > 0.05]
    assert not far


def test_labelled_sample_has_one_row_an_id(spark):
    docs = docs_of(spark, [(i % 5, f"text {i}") for i in range(50)] + [(None, "x")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)] + [(2, 0)], "doc_id long, quality int")
    rows = labelled.labelled_sample(docs, labels, "quality", F.lit(True), 4).collect()
    assert len(rows) == 4 == len({r.id for r in rows})
    assert sorted(rows) == sorted(labelled.labelled_sample(docs.repartition(7), labels, "quality", F.lit(True), 4).collect())


def test_toxicity_is_trees_and_steps(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels, F.lit(True))
    texts = {r.doc_id: r.text for r in docs.collect()}
    trees, weights = model.trees.trees, model.trees.treeWeights
    edges, values = model.calibration.boundaries.toArray(), model.calibration.predictions.toArray()

    def leaf(node, x):
        while node.subtreeDepth():
            split = node.split()
            node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
        return node.prediction()

    roots = [t._call_java("rootNode") for t in trees]
    for r in sorted(model.score(docs).collect())[:40]:
        x = toxicity.features(texts[r.doc_id], model.lexicon)
        raw = 1 / (1 + np.exp(-2 * sum(w * leaf(n, x) for w, n in zip(weights, roots))))
        assert abs(r.score - np.interp(raw, edges, values)) < 1e-9


def test_classifiers_on_odd_tables(spark):
    docs = docs_of(spark, [(1, None), (2, ""), (3, "some words"), (3, "some words"), (None, "x")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, None, None), (2, 1, 0), (3, 0, 1), (3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for table in (docs, docs.where("false")):
            scores = quality.score_documents(table, quality.fit(docs, labels, F.lit(True))).collect()
            scores += toxicity.fit(docs, labels, F.lit(True)).score(table).collect()
            assert len(scores) == 2 * table.count()
            assert all(0 <= r.score <= 1 for r in scores)


def test_toxicity_features():
    lexicon = toxicity.Lexicon({"moron": 5.0}, {"vequ": 4.0})
    f = dict(zip(toxicity.NAMES, toxicity.features("You MORON! vequal m0ron s c u m", lexicon), strict=True))
    assert (f["hits"], f["distinct_hits"], f["near_second_person"], f["hidden_hits"], f["strongest"]) == (2, 2, 2, 1, 5.0)
    assert toxicity.features(None, lexicon) == toxicity.features("", lexicon) == [0.0] * len(toxicity.NAMES)


# 8: archives


@pytest.mark.parametrize("version", ["1", "2"])
def test_archives_round_trip(spark, version):
    big = "x" * 1500
    rows = [(1, "http://a/ b", big), (2, "http://b", big), (3, None, "small"), (4, "http://d", "small"), (5, "http://e", None), (6, "http://f", "WARC/1.1\r\n\r\n" + "é\n" * 600), (7, "http://g", big), (7, "http://g", big), (None, "http://h", big)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(pages, spark, version=version).collect())
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = html == big and i != 7
        want.append((str(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 7 if again else None))
    assert got == sorted(want, key=lambda r: r[:4])
    assert warc.archive_pages(pages.where("false"), spark, version=version).count() == 0


def test_arc_versions_and_damage():
    for version in ("1", "2"):
        data = warc.arc_file_header(version, "f", "20010203040506") + warc.arc_record(version, "http://x", "20010203040506", b"a\nb\n\n") + warc.arc_record(version, "http://y", "2001", b"")
        records = list(warc.read_arc(io.BytesIO(data)))
        assert [(f["URL"], c) for f, c in records] == [("http://x", b"a\nb\n\n"), ("http://y", b"")]
        cut = list(warc.read_arc(io.BytesIO(data[: data.index(b"a\nb") + 2])))
        assert [list(f) for f, _ in cut] == [["Error"]]
    assert warc.warc_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert warc.warc_date("2001") == "2001-01-01T00:00:00Z"
    assert warc.warc_date("00000000000000", "20020304") == "2002-03-04T00:00:00Z"
    assert warc.warc_date("20011399000000") == "1970-01-01T00:00:00Z"
    with pytest.raises(warc.ArcError):
        list(warc.read_arc(io.BytesIO(b"http://x 1 2 3 0\n\n")))


def test_foreign_archives(spark, tmp_path):
    page = b"HTTP/1.0 200 OK\r\nServer: old\r\nContent-Length: 1200\r\n\r\n" + b"p" * 1200
    line = lambda text, body: text.encode() + b" %d\n" % len(body) + body + b"\n"
    block1, block2 = b"1 0 Crawler\nURL IP-address Archive-date Content-type Archive-length\n", b"2 0 Crawler\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    first = b"".join([
        line("filedesc://old.arc 0.0.0.0 19990102030405 text/plain", block1), line("http://a.org/my page 1.2.3.4 19990102030406 text/html; charset=utf-8", page),
        line("dns:a.org 1.2.3.4 19990102030407 text/dns", b"a.org 1.2.3.4"), b"some stray line\nand another\n", line("http://b.org/ 1.2.3.4 00000000000000 text/html", b"<html>bare"),
        line("http://c.org/ 1.2.3.4 19990102030409 text/html", b"HTTP/1.1 404\n\ngone"), b"http://d.org/ 1.2.3.4 19990102030410 text/html 99\ncut off",
    ])
    second = line("filedesc://new.arc 0.0.0.0 2001 text/plain 200 - - 0 new.arc", block2) + line("http://e.org/ 1.2.3.4 20010101000000 no-type 200 sum - 17 new.arc", page)
    (tmp_path / "old.arc").write_bytes(first)
    (tmp_path / "new.arc.gz").write_bytes(__import__("gzip").compress(second))
    (tmp_path / "none.arc").write_bytes(b"not an archive\n")
    paths = [(str(tmp_path / n),) for n in ("old.arc", "new.arc.gz", "none.arc")]
    written, damaged = warc.convert(spark.createDataFrame(paths, "path string"), f"file://{tmp_path}/out")
    got = {r.url: r for r in warc.read_warcs(written, f"file://{tmp_path}/out", with_payload=True).collect()}
    assert {u: (r.record_type, r.date, r.payload_bytes) for u, r in got.items()} == {
        "http://a.org/my page": ("response", "1999-01-02T03:04:06Z", 1200), "dns:a.org": ("resource", "1999-01-02T03:04:07Z", 13), "http://b.org/": ("resource", "1999-01-02T03:04:05Z", 10),
        "http://c.org/": ("response", "1999-01-02T03:04:09Z", 4), "http://e.org/": ("revisit", "2001-01-01T00:00:00Z", 1200),
    }
    assert got["http://e.org/"].refers_to == got["http://a.org/my page"].record
    assert got["http://e.org/"].payload_digest == hashlib.sha1(b"p" * 1200).hexdigest()
    assert bytes(got["http://c.org/"].payload) == b"gone"
    with open(next(r.path for r in written.collect() if r.arc.endswith("new.arc.gz")), "rb") as f:
        head = [h for h, _ in warc.read_warc(f)][-1]
    assert (head["WARC-Refers-To-Target-URI"], head["WARC-Refers-To-Date"]) == ("http://a.org/my page", "1999-01-02T03:04:06Z")
    assert sorted((r.path.rsplit("/")[-1], r.error.split(":")[0]) for r in damaged.collect()) == [
        ("none.arc", "the file does not open with a version block"), ("old.arc", "99 bytes declared, 7 there"), ("old.arc", "no header line"),
    ]


# The pipeline


def lines_kept(rows, min_sites=10):
    """Texts of (doc_id, text, source) rows without lines of three words or more on ``min_sites`` sources, except where first seen."""
    sites, first = {}, {}
    strip = lambda x: re.sub(r"^\s+|\s+$", "", x, flags=re.ASCII)
    for i, text, source in rows:
        for x in set(map(strip, text.split("\n"))):
            sites.setdefault(x, set()).add(source)
            first[x] = min(first.get(x, i), i)
    gone = {x for x, s in sites.items() if len(s) >= min_sites and len(re.findall(r"\S+", x, re.ASCII)) >= 3}
    return {i: "\n".join(x for x in text.split("\n") if strip(x) not in gone or first[strip(x)] == i) for i, text, _ in rows}


def hits_a_window(text, windows):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return any(tuple(words[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(words) - n + 1))


def test_pipeline_stages_against_brute_force(spark, sf, own):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns, items = docs.columns, [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before, rows = docs.collect(), {r.doc_id: r for r in docs.collect()}
        out = materialize(stage(spark, docs, sf), f"test_{name}")
        after = {r.doc_id: r for r in out.collect()}
        if name == "quality":
            model = quality.fit(docs, labels, labelled.fold("doc_id", 4) != 2)
            assert sorted(after) == sorted(i for i, r in rows.items() if one_vote(model, r.text) >= 0.7)
        elif name == "line_dedup":
            assert {i: r.text for i, r in after.items()} == lines_kept([(r.doc_id, r.text, r.source) for r in before])
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "near_dedup":
            groups = jaccard_groups([r.text for r in sorted(before)])
            assert sorted(after) == sorted({sorted(before)[c].doc_id for c in groups})
        elif name == "decontamination":
            windows = set()
            for t in items:
                w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
                windows |= {tuple(w[s : s + 10]) for s in range(max(1, len(w) - 9))} - {()}
            assert sorted(after) == sorted(i for i, r in rows.items() if not hits_a_window(r.text, windows))
        else:
            assert {i: list(r.ids) for i, r in after.items()} == {i: own.encode(r.text) for i, r in rows.items()}
        if name != "encoding":
            assert out.columns == columns
            assert all(after[i][c] == rows[i][c] for i in after for c in columns if c not in ("text", "n_chars"))
        docs = out


def test_pipeline_runs_on_odd_tables(spark, sf, tmp_path):
    import corpus_pipeline

    whole = spark.read.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).count() > 0
    rows = [(1, None), (2, ""), (2, "x"), (None, "a b c d e f"), (None, "g h i j k l"), (3, "a b c d e f"), (3, "a b c d e f")]
    for odd in (whole.where("false"), docs_of(spark, rows)):
        for _, stage in corpus_pipeline.STAGES:
            odd = materialize(stage(spark, odd, sf), "test_odd")
        assert odd.count() <= 4
