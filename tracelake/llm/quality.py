"""Quality classification by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are pairs of neighbouring byte classes (letters by case, digits, each punctuation mark,
white space, ...) and how often words repeat: what sets junk apart in any language.  Labelled texts
span a latent space, by a truncated singular value decomposition of their tf-idf matrix; every
document is projected into it and compared, in exact blocked cosine products, with all labelled
vectors.  The nearest vote with their labels, weighted by similarity.

What is broadcast is the bounded set of labelled vectors and the projection: ``max_labelled`` rows of
``dims`` numbers and a few hundred rows for the terms, under 2 MB however large the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.labelled import labelled_sample

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_N = 6 + len(_MARKS)
_SLICE = 1 << 20
N_TERMS = _N * _N + 3


def _classes() -> np.ndarray:
    kind = np.zeros(256, dtype=np.int32)  # 0: control bytes
    kind[ord("a") : ord("z") + 1] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    kind[[9, 10, 11, 12, 13, 32]] = 4
    kind[128:] = 5
    kind[list(_MARKS)] = 6 + np.arange(len(_MARKS))
    return kind


_KIND = _classes()


def term_counts(text: str | None) -> np.ndarray:
    """Counts of all terms in one text; zeros for a null or empty one."""
    out = np.zeros(N_TERMS)
    data = (text or "").encode("utf-8", "surrogatepass")
    for at in range(0, len(data) - 1, _SLICE):
        kind = _KIND[np.frombuffer(data, np.uint8, min(_SLICE + 1, len(data) - at), at)]
        out[: _N * _N] += np.bincount(kind[:-1] * _N + kind[1:], minlength=_N * _N)
    words = data.lower().split()
    if words:
        out[-3] = sum(map(bytes.__eq__, words, words[1:]))
        out[-2] = len(words) - len(set(words))
        out[-1] = len(words)
    return out


@dataclass
class Model:
    """What scoring needs; all of it bounded."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Unit latent vectors of term-count rows; zero rows stay zero."""
        return _unit(_weighted(counts, self.idf) @ self.projection)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest; the prior where nothing is similar."""
        near = self.project(counts).astype(np.float32) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        if not k:
            return np.full(len(counts), self.prior)
        best = np.argpartition(near, -k, axis=1)[:, -k:]
        weight = np.clip(np.take_along_axis(near, best, axis=1), 0, None).astype(float) ** 2
        total = weight.sum(axis=1)
        vote = (weight * self.labels[best]).sum(axis=1)
        return np.where(total > 1e-9, vote / np.maximum(total, 1e-9), self.prior)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square-rooted relative frequencies times idf, at unit length: a short text weighs like a long one."""
    size = np.maximum(counts[:, : _N * _N].sum(axis=1, keepdims=True), 1)
    words = np.maximum(counts[:, -1:], 1)
    share = np.hstack([counts[:, : _N * _N] / size, counts[:, -3:-1] / words, np.zeros_like(words)])
    return _unit(np.sqrt(share) * idf)


def fit_counts(counts: np.ndarray, labels: np.ndarray, dims: int = 64, neighbours: int = 25) -> Model:
    """Latent space and labelled vectors from term-count rows."""
    df = (counts > 0).sum(axis=0)
    idf = np.log((1 + len(counts)) / (1 + df)) + 1
    # The Gram matrix has a few hundred rows whatever the number of texts.
    rows = _weighted(counts, idf)
    values, vectors = np.linalg.eigh(rows.T @ rows)
    projection = vectors[:, np.argsort(values)[::-1][:dims]]
    prior = float(labels.mean()) if len(labels) else 0.5
    return Model(idf, projection, _unit(rows @ projection).astype(np.float32), labels.astype(float), prior, neighbours)


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", max_labelled: int = 4096, id_col: str = "doc_id", text_col: str = "text", **options
) -> Model:
    """Fit on at most ``max_labelled`` labelled documents among those that satisfy ``train``.

    Without usable labels nothing is known against any text, and every score is 1.
    """
    sample = labelled_sample(docs, labels, label, train, max_labelled, id_col, text_col).select("label", "text")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [term_counts(t).astype("<i4").tobytes() for t in frame["text"]]
            yield pd.DataFrame({"label": frame["label"], "counts": rows})

    rows = sample.mapInPandas(count, "label int, counts binary").collect()  # a row per labelled id, max_labelled at most
    if not rows:
        return Model(np.zeros(N_TERMS), np.zeros((N_TERMS, 1)), np.zeros((0, 1), np.float32), np.zeros(0), 1.0, 1)
    rows.sort(key=lambda r: (r["label"], bytes(r["counts"])))
    counts = np.stack([np.frombuffer(r["counts"], "<i4") for r in rows]).astype(float)
    return fit_counts(counts, np.array([r["label"] for r in rows]), **options)


def scorer(model: Model, docs: DataFrame):
    """Column function: the score of a text, between 0 and 1, for the session of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            parts = [shared.value.score(np.stack([term_counts(t) for t in batch[at : at + 256]])) for at in range(0, len(batch), 256)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return quality


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, score, predicted) for every row.

    Null and empty texts have no terms and get the share of label 1 among the labelled.  Repeated rows
    give repeated rows, an empty table an empty one; only the two named columns are read.
    """
    scored = docs.select(F.col(id_col), scorer(model, docs)(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows whose text scores ``threshold`` or more; columns unchanged."""
    return docs.where(scorer(model, docs)(F.col(text_col)) >= threshold)
