"""Quality by compression: which of two dictionaries, of good or of bad text, helps more."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, mapped, remainder, table
from .linear import scalar_logistic, sigmoid

SAMPLE_ROWS = 1_000  # labelled documents of each class that a fit sees at most
SAMPLE_CHARS = 50_000  # longer texts are scored, not learnt from
DICTIONARY_BYTES = 409_600
LEVEL = 3
SHORT = 64  # bytes added to a length, so that a few bytes of text say little
CHUNK_BYTES = 512  # texts are compressed in chunks, so that long ones do not learn themselves



@dataclass(frozen=True)
class Model:
    """Two dictionaries and the line that turns their difference into a probability."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float
    _made: list = field(default_factory=list, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_made": []}

    def compressors(self):
        if not self._made:
            for content in (self.good, self.bad):
                made = zstandard.ZstdCompressionDict(content)
                made.precompute_compress(level=LEVEL)
                self._made.append(
                    zstandard.ZstdCompressor(
                        dict_data=made, write_content_size=False, write_dict_id=False
                    )
                )
        return self._made


def dictionary(texts: list[str]) -> bytes:
    """A dictionary of ``texts``: trained, or where they are too few for that their own bytes."""
    chunks = [c for text in texts for c in _chunks(text.encode())]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, chunks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(chunks)[-DICTIONARY_BYTES:]


def difference(model: Model, text: str | None) -> float:
    """(size by the bad dictionary - size by the good one) / (bytes of the text + SHORT)."""
    data = (text or "").encode()
    if not data:
        return 0.0
    good, bad = model.compressors()
    chunks = _chunks(data)
    return sum(len(bad.compress(c)) - len(good.compress(c)) for c in chunks) / (len(data) + SHORT)


def _chunks(data: bytes) -> list[bytes]:
    """Near-equal chunks of at most CHUNK_BYTES that cover all of ``data``."""
    count = -(-len(data) // CHUNK_BYTES)
    step = -(-len(data) // max(1, count))
    return [data[at : at + step] for at in range(0, len(data), step)] if data else []


def fit(documents: DataFrame, labels: DataFrame, learn, rows: int = SAMPLE_ROWS) -> Model | float:
    """Learn from at most ``rows`` labelled documents of each class.

    Half of each class makes its dictionary, the other half the calibration, in which a class
    weighs as much as it has among all labels to learn from. If a class is missing, the answer
    is a constant: the smoothed share of the other.
    """
    sample = labelled_sample(documents, labels, "quality", learn, rows, SAMPLE_CHARS).toPandas()
    y = sample["y"].to_numpy(float)
    if min((y == 1).sum(), (y == 0).sum()) < 2:
        return float((y.sum() + 1.0) / (len(y) + 2.0))
    second = np.zeros(len(y), bool)
    for label in (0.0, 1.0):
        second[np.flatnonzero(y == label)[1::2]] = True
    texts = sample["text"].to_numpy(object)
    model = Model(
        dictionary(texts[(y == 1) & ~second].tolist()),
        dictionary(texts[(y == 0) & ~second].tolist()),
        0.0,
        0.0,
    )
    x = np.array([difference(model, text) for text in texts[second]])
    share = labels.where(learn).agg(F.avg((F.col("quality") == 1).cast("int"))).first()[0]
    ones = y[second] == 1
    weight = np.where(ones, share / ones.sum(), (1.0 - share) / (~ones).sum()) * len(x)
    spread = max(float(x.std()), 1e-9)
    slope, intercept = scalar_logistic(x / spread, y[second], weight)
    return Model(model.good, model.bad, slope / spread, intercept)


def score(documents: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, score, predicted) of every whole text; empty and null texts have difference 0.

    Every row is answered, repeated ones too.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scored(texts):
        known = shared.value
        if isinstance(known, float):
            p = np.full(len(texts), known)
        else:
            x = np.array([difference(known, text) for text in texts], dtype=float)
            p = sigmoid(known.slope * x + known.intercept)
        return p, (p >= 0.5).astype("int32")

    return mapped(
        documents.select("doc_id", "text"), scored, ("text",), "score double, predicted int"
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labels that are not held out."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    model = fit(documents, labels, remainder("doc_id", 3) != 1)
    return score(documents, model).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted"
    )
