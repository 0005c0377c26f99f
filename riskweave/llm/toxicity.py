"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import forget, held_out, labelled_sample, mapped, remainder, remembered, table
from .linear import sigmoid, sparse_logistic

SAMPLE_ROWS = 2_000  # labelled documents of each class that a fit sees at most
SAMPLE_CHARS = 200_000  # longer texts are scored, not learnt from
BITS = 20  # n-grams are hashed to so many bits
SIZES = (3, 4, 5)  # characters of an n-gram
LEAST_DOCUMENTS = 4  # an n-gram in fewer sampled documents says nothing
LEAST_RATIO = 0.5  # nor does one whose log-count ratio is nearer to 0
RIDGE = 1e-5
REMEMBERED = 300_000  # distinct words a worker remembers

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Weight of each hashed n-gram (ratio and coefficient multiplied), and the intercept."""

    weights: np.ndarray
    bias: float


def grams(word: str) -> list[int]:
    """Hashed n-grams of a word between marks for its ends."""
    marked = f"<{word}>"
    return [
        xxhash.xxh32_intdigest(marked[at : at + size]) >> (32 - BITS)
        for size in SIZES
        for at in range(len(marked) - size + 1)
    ]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def fit(documents: DataFrame, labels: DataFrame, learn, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``rows`` labelled documents of each class.

    N-grams are taken on the executors; only their numbers, for a bounded number of documents,
    come to the driver. With one class only, the intercept alone speaks for it; with none the
    score is one half.
    """
    sample = labelled_sample(documents, labels, "toxic", learn, rows, SAMPLE_CHARS)

    def featured(frames):
        for frame in frames:
            sets = [_present(words_of(text)) for text in frame["text"]]
            yield pd.DataFrame(
                {"y": frame["y"], "grams": [s.astype("<u4").tobytes() for s in sets]}
            )

    collected = sample.mapInPandas(featured, "y int, grams binary").toPandas()
    sets = [np.frombuffer(data, "<u4") for data in collected["grams"]]
    return _learn(sets, collected["y"].to_numpy(float))


def _present(words: set[str]) -> np.ndarray:
    return np.unique(np.array([g for word in words for g in grams(word)], dtype=np.int64))


def _learn(sets: list[np.ndarray], y: np.ndarray) -> Model:
    width = 1 << BITS
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(0, np.float32), 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0))
    columns = np.concatenate(sets).astype(np.int64)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    in_toxic = np.bincount(columns, y[rows], minlength=width)
    in_clean = np.bincount(columns, minlength=width) - in_toxic
    p, q = in_toxic + 1.0, in_clean + 1.0
    ratios = np.log((p / (y.sum() + 2.0)) / (q / (len(y) - y.sum() + 2.0)))
    ratios[(in_toxic + in_clean < LEAST_DOCUMENTS) | (np.abs(ratios) < LEAST_RATIO)] = 0.0
    kept = ratios[columns] != 0.0
    rows, columns = rows[kept], columns[kept]
    used, compact = np.unique(columns, return_inverse=True)
    beta, bias = sparse_logistic(rows, compact, ratios[columns], y, len(used), RIDGE)
    weights = np.zeros(width, np.float32)
    weights[used] = beta * ratios[used]
    return Model(weights, bias)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with score and predicted instead of text, see ``annotate``."""
    return annotate(documents.select("doc_id", "text"), model).drop("text")


def annotate(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with (score, predicted) of every whole text.

    An n-gram counts once per document however often it occurs. Empty and null texts score the
    intercept. Every row is answered, repeated ones too.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return mapped(
        documents,
        lambda texts: _scores(texts, shared.value),
        ("text",),
        "score double, predicted int",
        keep=("text",),
    )


def _scores(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    known: dict[str, np.ndarray] = remembered(model, dict)
    if len(known) > REMEMBERED:
        forget()
        known = remembered(model, dict)
    weights = model.weights
    out = np.full(len(texts), model.bias)
    for k, text in enumerate(texts):
        if not len(weights):
            continue
        some = words_of(text)
        for word in some.difference(known):
            numbers = np.array(grams(word), dtype=np.int64)
            known[word] = numbers[np.abs(weights[numbers]) > 1e-4]
        parts = [numbers for word in some if len(numbers := known[word])]
        if parts:
            out[k] += weights[np.unique(np.concatenate(parts))].sum(dtype=float)
    p = sigmoid(out)
    return p, (p >= 0.5).astype("int32")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels that are not held out."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = fit(documents, labels, remainder("doc_id", 5) != 0)
    return score(documents, model).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted"
    )
