"""Source divergence against sums over every kept term, with exact integers."""

import re
from collections import Counter, defaultdict

from tracelake.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, p0 string, count string, term string"


def slow_divergence(docs, min_docs, top):
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang or "", source or ""].update(words)
        seen[lang or ""].update(set(words))
    out = set()
    for (lang, source), own in counts.items():
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        whole = sum((c for (x, _), c in counts.items() if x == lang), Counter())

        def price(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept))

        f = lambda p, q: (p - q) ** 2 // (p + q)
        others = {s: sum(f(price(own, t), price(c, t)) for t in kept) for (x, s), c in counts.items() if x == lang and s != source}
        terms = {t: f(price(own, t), price(whole, t)) for t in kept if own[t] and price(own, t) > price(whole, t)}
        for part, values, most in (("pair", others, None), ("term", terms, top)):
            ranked = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:most]
            out |= {(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


def test_against_sums_over_all_terms(spark):
    words = "the Of and Über zoë qa qb qc qd qe qf".split()
    docs = [(" ".join(words[(i * k) % (3 + i % 9)] for k in range(1 + i % 13)) + f", only{i}-{i}!", ("en", "de", None)[i % 3], f"s{i % 5}") for i in range(90)]
    docs += [("the the THE", "en", None), (None, "en", "silent"), ("", None, None), ("solo words", "xx", "one"), (None, "yy", "a"), ("rare", "yy", "b"), *[("the same text", "de", "s1")] * 40]
    table = spark.createDataFrame([(i, *d, "x", "y", "z") for i, d in enumerate(docs)], SCHEMA)
    got = [tuple(r) for r in divergence.source_divergence(table, min_docs=4, top_terms=3).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == slow_divergence(docs, 4, 3)
    assert divergence.source_divergence(table.limit(0)).count() == 0


def test_prices_beyond_longs(spark):
    big = 1 << 55
    row = spark.range(1).selectExpr(f"{big} AS c", f"{3 * big + 7} AS n", "11 AS v").select(divergence.price(*map(divergence.F.col, "cnv")).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 2) // (3 * big + 7 + 22)


def test_counts_are_given_away_before_they_are_many(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "_HELD", 10)
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["s"]), pa.array([f"a a b{i}".encode()])], ["l", "s", "t"]) for i in "abcdefghijklmnop"]
    out = list(divergence._counted(iter(batches)))
    assert len(out) > 1 and sum(sum(b["count"].to_pylist()) for b in out) == 3 * len(batches)
