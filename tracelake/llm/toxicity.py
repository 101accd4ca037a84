"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learnt: words and word beginnings that labelled toxic texts have far more often than
others, in any language.  Features are the densities of lexicon hits, how near to them the second
person is, the rates of capitals and punctuation, and how much is obfuscated (letters set apart by
marks, digits for letters, drawn-out letters).  Trees and calibration are Spark ML's, fitted on a
bounded sample of labelled documents; scoring runs over all documents without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.labelled import labelled_sample
from tracelake.storage import materialize

#: Second-person words of the corpus's languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti tuyo usted ustedes vosotros".split()
)
#: Digits and marks that stand for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_RUNS = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"\w[^\w\s'’\-.,/:]+\w|[^\W\d_]\d|\d[^\W\d_]")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][ .\-*]){3,}[^\W\d_](?!\S)")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_PUNCTUATION = re.compile(r"[^\w\s]")
PREFIXES = (3, 4, 5, 6)
NAMES = (
    "log_words", "hits", "hit_density", "weight_density", "strongest", "distinct_hits", "near_second_person", "second_person",
    "capitals", "capital_words", "punctuation", "exclamations", "questions", "mixed", "hidden_hits", "spaced", "drawn_out",
)


class Lexicon:
    """Weights of words and of word beginnings."""

    def __init__(self, words: dict[str, float], prefixes: dict[str, float]):
        self.words, self.prefixes = words, prefixes
        self._heads = {w[:3] for w in words} | {p[:3] for p in prefixes}

    def weight(self, word: str) -> float:
        """0 if the word is not in the lexicon."""
        found = self.words.get(word, 0.0)
        for n in PREFIXES:
            if len(word) > n:
                found = max(found, self.prefixes.get(word[:n], 0.0))
        return found

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        heads, weight = self._heads, self.weight
        return [(i, w) for i, x in enumerate(words) if x[:3] in heads and (w := weight(x))]


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The values of ``NAMES`` for one text; an empty or null text has zeros."""
    text = text or ""
    lower = text.lower()
    words = _RUNS.findall(lower)
    n, chars = max(len(words), 1), max(len(text), 1)
    hits = lexicon.hits(words)
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON] if hits else []
    near = 0
    if second:
        at = np.array(second)
        places = np.searchsorted(at, [i for i, _ in hits])
        for (i, _), k in zip(hits, places, strict=True):
            near += any(0 <= j < len(at) and abs(int(at[j]) - i) <= 5 for j in (k - 1, k))
    mixed = spaced = drawn = 0
    hidden = 0.0
    if not text.isascii() or any(c in text for c in "0123456789*@$_-.!#%&"):
        odd = [t for t in set(lower.split()) if not t.isalpha() and _MIXED.search(t)]
        mixed = len(odd)
        hidden = sum(lexicon.weight("".join(_RUNS.findall(t.translate(LOOKALIKES)))) > 0 for t in odd)
        apart = _SPACED.findall(lower)
        spaced = len(apart)
        hidden += sum(lexicon.weight("".join(_RUNS.findall(t))) > 0 for t in _SPACED.findall(lower))
    drawn = len(_DRAWN.findall(lower))
    capitals = sum(map(str.isupper, text)) if not lower == text else 0
    loud = sum(t.isupper() and len(t) > 1 for t in text.split()) if capitals > 1 else 0
    return [
        float(np.log1p(len(words))), float(len(hits)), len(hits) / n, sum(w for _, w in hits) / n, max((w for _, w in hits), default=0.0),
        float(len({words[i] for i, _ in hits})), float(near), len(second) / n, capitals / chars, loud / n,
        len(_PUNCTUATION.findall(text)) / chars, text.count("!") / n, text.count("?") / n, mixed / n, float(hidden), spaced / n, drawn / n,
    ]


def learn_lexicon(sample: DataFrame, min_documents: int = 5, min_log_odds: float = 2.0, max_terms: int = 4000) -> Lexicon:
    """Terms of toxic texts among rows (text, label), by smoothed log odds of document frequencies.

    Counting is an aggregation over the sample's distinct words; what comes to the driver is the
    ``max_terms`` best.
    """
    totals = sample.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    p, q = (totals["p"] or 0) + 1.0, totals["n"] - (totals["p"] or 0) + 1.0
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)")))
    exploded = sample.select("label", F.explode(words).alias("word")).where(F.length("word") <= 40)
    by_word = materialize(exploded.groupBy("word").agg(F.sum("label").alias("p"), F.count("*").alias("n")), "toxic_words")
    # Beginnings count once per word and document; documents with two such words are rare enough not to matter.
    cuts = F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in PREFIXES])
    prefixes = by_word.select(F.explode(cuts).alias("term"), "p", "n").where("term is not null").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    terms = by_word.select(F.col("word").alias("term"), "p", "n", F.lit(False).alias("prefix")).unionByName(prefixes.withColumn("prefix", F.lit(True)))
    odds = F.log((F.col("p") + 0.5) / p) - F.log((F.col("n") - F.col("p") + 0.5) / q)
    best = (
        terms.where(F.col("p") >= min_documents).withColumn("odds", odds).where(F.col("odds") >= min_log_odds)
        .orderBy(F.desc(F.col("odds") * F.sqrt("p")), "term", "prefix").limit(max_terms).collect()
    )
    return Lexicon({r["term"]: r["odds"] for r in best if not r["prefix"]}, {r["term"]: r["odds"] for r in best if r["prefix"]})


def feature_udf(lexicon: Lexicon, docs: DataFrame):
    """Column function: the dense feature array of a text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most max_terms words

    @F.pandas_udf("array<double>")
    def dense(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([features(t, shared.value) for t in batch], dtype=object)

    return dense


class ToxicityModel:
    """Lexicon, trees and calibration; ``constant`` instead if the labels had only one class."""

    def __init__(self, lexicon=None, trees=None, calibration=None, constant: float | None = None):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def _raw(self, rows: DataFrame) -> DataFrame:
        scored = self.trees.transform(rows.withColumn("features", array_to_vector("dense")))
        return scored.withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
        """(id, score, predicted) for every row.

        Null and empty texts have zero features and are scored like any other.  Repeated rows give
        repeated rows, an empty table an empty one; only the two named columns are read.
        """
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        if self.constant is not None:
            scored = rows.select("id", F.lit(float(self.constant)).alias("score"))
        else:
            raw = self._raw(rows.select("id", feature_udf(self.lexicon, docs)(F.col("text")).alias("dense")))
            scored = self.calibration.transform(raw).select("id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))).alias("score"))
        return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", max_labelled: int = 8192, trees: int = 20, depth: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> ToxicityModel:
    """Fit on at most ``max_labelled`` labelled documents among those that satisfy ``train``.

    Three quarters grow the lexicon and the trees, the rest calibrates.  With labels of one class only,
    or none, the score is that class (0 for none).
    """
    sample = materialize(labelled_sample(docs, labels, label, train, max_labelled, id_col, text_col).withColumn("calibrates", F.pmod(F.xxhash64("id"), F.lit(4)) == 3), "toxic_sample")
    grow = sample.where(~F.col("calibrates"))
    seen = {(r["calibrates"], r["label"]): r["count"] for r in sample.groupBy("calibrates", "label").count().collect()}
    if not (seen.get((False, 0)) and seen.get((False, 1))):
        ones, zeros = (sum(n for (_, y), n in seen.items() if y == k) for k in (1, 0))
        return ToxicityModel(constant=1.0 if ones > zeros else 0.0)
    lexicon = learn_lexicon(grow)
    rows = materialize(sample.select("calibrates", F.col("label").cast("double").alias("label"), feature_udf(lexicon, docs)(F.col("text")).alias("dense")), "toxic_features")
    model = ToxicityModel(lexicon)
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, featuresCol="features", labelCol="label")
    model.trees = boosted.fit(rows.where(~F.col("calibrates")).withColumn("features", array_to_vector("dense")).select("label", "features"))
    held = rows.where(F.col("calibrates")) if seen.get((True, 0)) and seen.get((True, 1)) else rows
    model.calibration = IsotonicRegression(featuresCol="raw", labelCol="label").fit(model._raw(held).select("raw", "label"))
    return model
