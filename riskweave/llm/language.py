"""Language by unigram pieces of a fixed vocabulary, summed over all segmentations."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, held_out, mapped, ranked_sample, remainder, remembered, table

PIECES = "piece_bpe_32k.model"
UNKNOWN = "und"
SAMPLE_ROWS = 1_500  # labelled documents per language that a fit sees at most
SAMPLE_CHARS = 200_000  # longer texts are scored, not learnt from
SMOOTHING = 0.1  # added to every count
REMEMBERED = 300_000  # distinct words a worker remembers
WORDS_AT_A_TIME = 4096
LONGEST = 16  # characters of a piece at most
ASTRAL = 0x10000  # first character beyond the basic plane


def _ranges(kinds: str, begin: int, end: int) -> str:
    """The characters from ``begin`` on, before ``end``, whose general category begins with one of
    the kinds, as ranges of a class."""
    out, start = [], None
    for code in range(begin, end + 1):
        inside = code < end and unicodedata.category(chr(code))[0] in kinds
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(out)


@cache
def _words() -> re.Pattern:
    """A word is a letter and the letters and combining marks after it, as Unicode has them.

    A class is a table for the basic plane, but a list of ranges beyond it, which every space and
    sign would be compared with; so the list is only asked about characters from beyond.
    """
    end = sys.maxunicode + 1
    first, later = _ranges("L", 0, ASTRAL), _ranges("LM", 0, ASTRAL)
    beyond = f"(?=[\\U{ASTRAL:08x}-\\U{sys.maxunicode:08x}])"
    first_beyond, later_beyond = (f"{beyond}[{_ranges(k, ASTRAL, end)}]" for k in ("L", "LM"))
    return re.compile(f"(?:[{first}]|{first_beyond})[{later}]*(?:{later_beyond}[{later}]*)*")


def words_of(text: str | None) -> list[str]:
    return _words().findall((text or "").lower())


@dataclass(frozen=True)
class Model:
    """Log-free piece probabilities, one row per piece and one column per language."""

    languages: tuple[str, ...]
    numbers: dict[str, int]
    probabilities: np.ndarray


@cache
def _processor(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))


def fit(documents: DataFrame, rows: int = SAMPLE_ROWS, pieces: str = PIECES) -> Model:
    """Piece probabilities per language from (doc_id, text, lang).

    Pieces are counted in the best segmentations of at most ``rows`` documents of each language, and
    pieces that none of them has get the smoothing alone. Counting is distributed; what returns
    has one row per language and piece.
    """
    classes = documents.where("lang IS NOT NULL AND doc_id IS NOT NULL").select(
        "doc_id", F.col("lang").alias("y")
    )
    sample = ranked_sample(
        documents.select("doc_id", "text"), classes.distinct(), rows, SAMPLE_CHARS
    )

    def counted(frames):
        processor = _processor(pieces)
        for frame in frames:
            for language, texts in frame.groupby("y")["text"]:
                sums = _piece_counts(texts, processor)
                if sums:
                    yield pd.DataFrame({"y": language, "piece": [*sums], "n": [*sums.values()]})

    counts = (
        sample.mapInPandas(counted, "y string, piece string, n long")
        .groupBy("y", "piece")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    return _model(counts, vocabulary(pieces))


def _piece_counts(texts: Iterable[str], processor) -> Counter[str]:
    """How often each piece stands in the best segmentations of all words, counted text by text."""
    found = Counter()
    for text in texts:
        found.update(words_of(text))
    words, sums = list(found), Counter()
    for at in range(0, len(words), WORDS_AT_A_TIME):
        some = words[at : at + WORDS_AT_A_TIME]
        for word, split in zip(some, processor.encode(some, out_type=str, num_threads=1), strict=True):
            for piece in split:
                sums[piece] += found[word]
    return sums


def vocabulary(name: str = PIECES) -> list[str]:
    """The pieces of a public vocabulary that stand for characters."""
    p = _processor(name)
    plain = (k for k in range(p.get_piece_size()) if not (p.is_control(k) or p.is_unknown(k) or p.is_byte(k)))
    return [piece for piece in map(p.id_to_piece, plain) if len(piece) <= LONGEST]


def _model(counts: pd.DataFrame, pieces: Sequence[str] = ()) -> Model:
    """Probabilities of all pieces of the vocabulary, whether the sample had them or not."""
    counts = counts[counts["piece"].str.len() <= LONGEST]
    wide = counts.pivot_table(index="piece", columns="y", values="n", aggfunc="sum", fill_value=0)
    if len(wide.columns):
        wide = wide.reindex(wide.index.union(pd.Index(pieces, dtype=object)), fill_value=0)
    wide = wide.sort_index().sort_index(axis=1)
    smooth = wide.to_numpy(float) + SMOOTHING
    # One more row for a character that no piece covers.
    smooth = np.vstack([smooth, np.full(smooth.shape[1], SMOOTHING)])
    return Model(
        tuple(wide.columns), {p: k for k, p in enumerate(wide.index)}, smooth / smooth.sum(axis=0)
    )


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """Log-probability of each word in each language, all its segmentations summed.

    The forward sums of all words run side by side: step i holds, per word, the probability of
    its first i characters. Only as many steps are kept as a piece has characters, so a long word
    takes no more memory than a short one. A word begins with the mark that the vocabulary puts for a space.
    """
    marked = ["▁" + word for word in words]
    unknown = len(model.numbers)
    longest = max(map(len, marked))
    turn = LONGEST + 1  # no piece reaches further back, so steps are kept in turn
    sums = np.zeros((turn, len(marked), len(model.languages)))
    sums[0] = 1.0
    scale = np.zeros((len(marked), 1))
    out = np.zeros((len(marked), len(model.languages)))
    find = model.numbers.get
    for end in range(1, longest + 1):
        alive = [k for k, word in enumerate(marked) if len(word) >= end]
        rows, starts, pieces = [], [], []
        for k in alive:
            word = marked[k]
            for start in range(max(0, end - LONGEST), end):
                piece = find(word[start:end])
                if piece is None and start == end - 1:
                    piece = unknown
                if piece is not None:
                    rows.append(k)
                    starts.append(start % turn)
                    pieces.append(piece)
        rows = np.array(rows)
        add = sums[starts, rows] * model.probabilities[pieces]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        now = end % turn
        sums[now, alive] = np.add.reduceat(add, first, axis=0)
        if end % 16 == 0:  # keep long words from running out of range
            most = sums[now, alive].max(axis=1, keepdims=True)
            sums[:, alive] /= most
            scale[alive] += np.log(most)
        done = [k for k in alive if len(marked[k]) == end]
        with np.errstate(divide="ignore"):
            out[done] = np.log(sums[now, done]) + scale[done]
    return np.maximum(out, -1e6)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with lang_pred and score instead of text, see ``annotate``."""
    return annotate(documents.select("doc_id", "text"), model).drop("text")


def annotate(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with (lang_pred, score): the likeliest language and its posterior.

    Whole texts are read. Null texts and texts without a letter are ``und`` with score 0, as is
    everything if nothing was learnt. Every row is answered, repeated ones too.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return mapped(
        documents,
        lambda texts: _answers(texts, shared.value),
        ("text",),
        "lang_pred string, score double",
        keep=("text",),
    )


class Known:
    """Words a worker has scored: the row of each, and the rows."""

    def __init__(self, model: Model):
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))


def _answers(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    words = [words_of(text) for text in texts]
    places, scores = _places(words, model)
    best, posterior = [], []
    for some in places:
        if not len(some) or not model.languages:
            best.append(UNKNOWN)
            posterior.append(0.0)
            continue
        total = scores[some].sum(axis=0)
        top = int(total.argmax())
        best.append(model.languages[top])
        posterior.append(1.0 / float(np.exp(total - total[top]).sum()))
    return best, posterior


def _places(words: list[list[str]], model: Model) -> tuple[list[np.ndarray], np.ndarray]:
    """Each document's words as rows of a table of scores, which a worker keeps between calls."""
    if not model.languages:
        return [np.zeros(0, int) for _ in words], np.zeros((0, 0))
    known = remembered(model, lambda: Known(model))
    if len(known.rows) > REMEMBERED:
        forget()
        known = remembered(model, lambda: Known(model))
    new = sorted({w for some in words for w in some}.difference(known.rows), key=len)
    fresh = [
        word_scores(model, new[at : at + WORDS_AT_A_TIME])
        for at in range(0, len(new), WORDS_AT_A_TIME)
    ]
    known.rows.update(zip(new, range(len(known.rows), len(known.rows) + len(new)), strict=True))
    known.scores = np.concatenate([known.scores, *fresh])
    find = known.rows.__getitem__
    return [np.fromiter(map(find, some), np.int64, len(some)) for some in words], known.scores


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(documents.where(remainder("doc_id", 5) != 0))
    return predict(documents, model).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score"
    )
