"""Byte-level BPE: each distinct word of the corpus is encoded once, then ids go back to texts.

Exploding every word with its position would shuffle several times the corpus. Documents are
therefore taken in blocks: a block lists its distinct words once, and a document is the run of
their numbers in text order, which is what position by position rows would say. The lists are
shuffled by a hash of the word, so that all mentions of a word meet, are encoded once there and
go back to their blocks, where every document is put together again. Lists travel packed: one
row for what a block has of a share of the words. There are as many shares as the corpus has
blocks, so neither shares nor blocks grow with it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocabulary
from .common import table

BLOCK_CHARS = 6_000_000  # characters after which a block closes
TEXTS_AT_A_TIME = 256
LEAST_SHARES = 64  # shares of words, in a small corpus


def encode(documents: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids array<int>) of every document; a null text is an empty one.

    A word is what stands between two safe cuts (``vocabulary.parted``): one pre-token, or some
    with the signs around them. Rows that repeat a doc_id, or have none, are encoded each.
    """
    source = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chars = source.agg(F.sum(F.length("text"))).first()[0] or 0
    shares = max(LEAST_SHARES, chars // block_chars)
    numbered = source.mapInPandas(
        lambda frames: map(_numbered, _blocks(frames, block_chars)),
        "block long, doc_id long, numbers binary",
    )
    listed = source.mapInPandas(
        lambda frames: (_listed(block, shares) for block in _blocks(frames, block_chars)),
        "block long, share int, numbers binary, words binary",
    )
    answers = listed.groupBy("share").applyInPandas(
        _encoded, "block long, numbers binary, sizes binary, ids binary"
    )
    return (
        numbered.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInPandas(_assembled, "doc_id long, ids array<int>")
    )


def decode(encoded: DataFrame) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of its ids, looked up in the token table.

    The table has one row per id of the vocabulary, so every task holds it whole, as one array
    in the order of the ids; no Python runs beside the one that puts documents together. An id
    outside it is an error.
    """
    known = {rank: token.hex() for token, rank in vocabulary.token_bytes().items()}
    tokens = [known.get(k) for k in range(max(known) + 1)]
    table_of = encoded.sparkSession.createDataFrame([(tokens,)], "tokens array<string>").scalar()
    outside = F.raise_error(F.lit("an id is outside the vocabulary")).cast("string")
    looked_up = F.transform("ids", lambda k: F.coalesce(F.get("tokens", k), outside))
    return (
        encoded.select("doc_id", "ids", table_of.alias("tokens"))
        .select("doc_id", "ids", F.unhex(F.array_join(looked_up, "")).alias("decoded"))
    )


def _blocks(frames, block_chars: int):
    """(name, doc_ids, words of each document); named by content, so that a rerun names it alike."""
    ids, texts, size = [], [], 0
    for frame in frames:
        for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size >= block_chars:
                yield _block(ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield _block(ids, texts)


def _block(ids: list, texts: list[str]) -> tuple[int, list, list[np.ndarray], list[str]]:
    """(name, doc_ids, numbers of each document's words, words by number)."""
    name = xxhash.xxh3_64()
    for doc_id, text in zip(ids, texts, strict=True):
        data = text.encode()
        name.update(f"{doc_id} {len(data)} ")
        name.update(data)
    numbers: dict[str, int] = {}  # by first mention, so that frequent words have low ones
    runs: list[np.ndarray] = []
    for at in range(0, len(texts), TEXTS_AT_A_TIME):
        runs += _runs(texts[at : at + TEXTS_AT_A_TIME], numbers)
    return name.intdigest() - 2**63, ids, runs, list(numbers)


def _runs(texts: list[str], numbers: dict[str, int]) -> list[np.ndarray]:
    """Numbers of each document's words; words met for the first time get the next ones."""
    cuts = [vocabulary.parted(text) for text in texts]
    exact = pa.array([part for parts, _ in cuts for part in parts], pa.large_string())
    split = pc.split_pattern(pa.array([rest for _, rest in cuts], pa.large_string()), " ")
    begin, after = exact.dictionary_encode(), split.flatten().dictionary_encode()
    words = [*_values(begin), *(" " + word for word in _values(after))]
    number = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), "<u4", len(words))
    first = number[begin.indices.to_numpy()]
    later = number[after.indices.to_numpy() + len(begin.dictionary)]
    of_first = np.cumsum([len(parts) for parts, _ in cuts])[:-1]
    of_later = np.cumsum(pc.list_value_length(split).fill_null(0).to_numpy())[:-1]
    both = zip(np.split(first, of_first), np.split(later, of_later), strict=True)
    return [np.concatenate(some) for some in both]


def _values(encoded: pa.DictionaryArray) -> list[str]:
    return encoded.dictionary.to_numpy(zero_copy_only=False).tolist()


def _numbered(block) -> pd.DataFrame:
    name, ids, runs, _ = block
    return pd.DataFrame(
        {
            "block": name,
            "doc_id": pd.array(ids, dtype="Int64"),
            "numbers": [_packed(run) for run in runs],
        }
    )


def _packed(numbers: np.ndarray) -> bytes:
    """First the low bytes of all numbers, then the next: frequent words have low numbers."""
    planes = np.ascontiguousarray(numbers, "<u4").view("u1").reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _listed(block, shares: int) -> pd.DataFrame:
    """What the block has of each share of the words: their numbers, and the words themselves."""
    name, _, _, words = block
    share_of = np.array([xxhash.xxh3_64_intdigest(w) % shares for w in words], np.int64)
    order = np.argsort(share_of, kind="stable")
    some, starts = np.unique(share_of[order], return_index=True)
    groups = np.split(order, starts[1:]) if len(words) else []
    squeeze = zstandard.ZstdCompressor(level=3).compress
    return pd.DataFrame(
        {
            "block": name,
            "share": some.astype("int32"),
            "numbers": [_packed(np.diff(group, prepend=0)) for group in groups],  # they ascend
            "words": [squeeze(_joined([words[k].encode() for k in group])) for group in groups],
        }
    )


def _joined(words: list[bytes]) -> bytes:
    """Their lengths, four bytes each, and the words; the first number says how many."""
    return np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words)


def _split(data: bytes) -> list[str]:
    count = int(np.frombuffer(data, "<u4", 1)[0])
    ends = 4 * (count + 1) + np.cumsum(np.frombuffer(data, "<u4", count, 4))
    starts = [4 * (count + 1), *ends.tolist()]
    return [data[a:b].decode() for a, b in zip(starts, ends.tolist(), strict=False)]


def _encoded(frame: pd.DataFrame) -> pd.DataFrame:
    """Encode each distinct word of a share once, and answer every block that lists it."""
    ids_of, known = vocabulary.encoding().encode_ordinary, {}
    sizes, ids = [], []
    for data in frame["words"]:
        found = []
        for word in _split(zstandard.decompress(data)):
            if word not in known:
                known[word] = np.array(ids_of(word), "<u4").tobytes()
            found.append(known[word])
        sizes.append(_packed(np.array([len(f) // 4 for f in found])))
        ids.append(_packed(np.frombuffer(b"".join(found), "<u4")))
    return frame[["block", "numbers"]].assign(sizes=sizes, ids=ids)


def _assembled(documents: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    none = np.zeros(0, "<u4")
    words = np.concatenate([none, *(np.cumsum(_unpacked(n)) for n in answers["numbers"])])
    ids = np.concatenate([none, *map(_unpacked, answers["ids"])])
    size = np.concatenate([none, *map(_unpacked, answers["sizes"])]).astype(np.int64)
    sizes, starts = np.full(len(words), -1), np.zeros(len(words), np.int64)
    out = []
    try:
        sizes[words], starts[words] = size, np.cumsum(size) - size
        for packed in documents["numbers"]:
            found, _ = vocabulary.gather(ids, starts, sizes, _unpacked(packed))
            out.append(found.astype("i4"))
    except (IndexError, ValueError) as error:
        raise ValueError("a block was cut differently when it was read again") from error
    return pd.DataFrame({"doc_id": documents["doc_id"].astype("Int64"), "ids": out})


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of every document."""
    both = decode(encode(table(spark, sf_dir, "documents", "doc_id", "text")))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias(
            "ids_sha256"
        ),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
