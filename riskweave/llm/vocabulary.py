"""Encoding with a fixed byte-level BPE vocabulary; the files stay where their package keeps them."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import tiktoken

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"

# Distinct words a worker remembers; beyond that it forgets all but the half it met most often.
REMEMBERED = 300_000
LINE_WORDS = 256  # words the tokenizer gets as one line
LINES_AT_A_TIME = 32


@cache
def token_bytes(name: str = RANKS) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def encoding(name: str = RANKS) -> tiktoken.Encoding:
    return tiktoken.Encoding(
        "ranks",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=token_bytes(name),
        special_tokens={},
    )


@cache
def tokenizer(name: str = TOKENIZER):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(public_tokenizers.path(name))
    loaded.encode_special_tokens = True
    return loaded


# White space other than space and line feed, as characters of a class.
_ODD = re.compile("[\t\r\v\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BETWEEN = re.compile(r"(?<=\S)(?= \S)")


def _unusual(text: str) -> bool:
    """Whether some white space is not a single space between other characters."""
    return "  " in text or " \n" in text or "\n " in text or _ODD.search(text) is not None


def parted(text: str) -> tuple[list[str], str | None]:
    """``text`` cut before every space that stands between two other characters.

    No match of the pattern reaches over such a place and none looks back over it, so the ids of
    the parts, one after the other, are the ids of the text. First come parts as they are, then,
    where all white space is single, what follows the first space: its words stand after a space.
    """
    if _unusual(text):
        return _BETWEEN.split(text), None
    first, space, rest = text.partition(" ")
    return [first], rest if space else None


def gather(
    ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the numbered words one after the other, and where each word's end."""
    counts = sizes[numbers]
    ends = np.cumsum(counts)
    return ids[np.repeat(starts[numbers] - ends + counts, counts) + np.arange(counts.sum())], ends


class Known:
    """Ids of the words met so far: a number for each word, and where its ids stand."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.ids = np.zeros(0, "<u4")
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int64)  # how often a word was looked up, of late

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Add words not yet known, with their ids one after the other."""
        first = len(self.numbers)
        self.numbers.update(zip(words, range(first, first + len(sizes)), strict=True))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.ids = np.append(self.ids, ids)
        self.met = np.append(self.met, np.zeros_like(sizes))

    def look_up(self, words: list[str]) -> np.ndarray:
        """Numbers of distinct words, all known."""
        found = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        self.met[found] += 1
        return found

    def keep(self, most: int) -> None:
        """Forget all but the ``most`` words that were met most often."""
        kept = np.sort(np.argsort(-self.met, kind="stable")[:most])
        words = list(self.numbers)
        self.numbers = {words[k]: number for number, k in enumerate(kept.tolist())}
        self.ids, ends = gather(self.ids, self.starts, self.sizes, kept)
        self.sizes, self.met = self.sizes[kept], self.met[kept] // 2
        self.starts = ends - self.sizes


class Encoder:
    """Ids of whole texts by the tokenizer file; a worker encodes each distinct part once."""

    def __init__(self, name: str = TOKENIZER):
        self._name = name
        self._known = Known()
        self._after_space = Known()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as little-endian unsigned 32-bit numbers."""
        cuts = [parted(text) for text in texts]
        tables = (self._known, self._after_space)
        total = sum(len(known.numbers) for known in tables)
        if total > REMEMBERED:
            for known in tables:
                known.keep(REMEMBERED // 2 * len(known.numbers) // total)
        parts = pa.array([part for parts, _ in cuts for part in parts], pa.large_string())
        counts = np.array([len(parts) for parts, _ in cuts])
        split = pc.split_pattern(pa.array([rest for _, rest in cuts], pa.large_string()), " ")
        words_after = pc.list_value_length(split).fill_null(0).to_numpy()
        begin = self._looked_up(parts, counts, self._known, "")
        after = self._looked_up(split.flatten(), words_after, self._after_space, " ")
        return [np.concatenate(both) for both in zip(begin, after, strict=True)]

    def _looked_up(
        self, words: pa.Array, counts: np.ndarray, known: Known, lead: str
    ) -> list[np.ndarray]:
        """Ids of the words of each text, all after ``lead``; ``counts`` says how many it has."""
        numbered = words.dictionary_encode()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(distinct, known, lead)
        numbers = known.look_up(distinct)[numbered.indices.to_numpy()]
        ids, ends = gather(known.ids, known.starts, known.sizes, numbers)
        return np.split(ids, np.append(0, ends)[np.cumsum(counts)[:-1]])

    def _learn(self, words: Iterable[str], known: Known, lead: str) -> None:
        """Encode words not yet known, each after ``lead``; many in one line where that is safe."""
        alone, joined = [], []
        for word in words:
            if word not in known.numbers:
                # White space at either end of a word would go with what stands next to it.
                (joined if lead and word and word.strip() == word else alone).append(word)
        lines = [joined[at : at + LINE_WORDS] for at in range(0, len(joined), LINE_WORDS)]
        ids, _ = self._encoded([lead + lead.join(line) for line in lines])
        # No word has a space within, so a token that begins with one begins a word.
        starts = np.flatnonzero(_begins_with_space()[ids])
        known.add(joined, ids, np.diff(starts, append=len(ids)))
        known.add(alone, *self._encoded([lead + word for word in alone]))

    def _encoded(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the lines one after the other, and how many each has."""
        encode, found = tokenizer(self._name).encode_batch_fast, [np.zeros(0, "<u4")]
        for at in range(0, len(lines), LINES_AT_A_TIME):
            some = encode(lines[at : at + LINES_AT_A_TIME], add_special_tokens=False)
            found += [np.array(line.ids, "<u4") for line in some]
        return np.concatenate(found), np.array([len(ids) for ids in found[1:]], np.int64)


@cache
def _begins_with_space() -> np.ndarray:
    """Whether the first byte of a token is a space, by id."""
    out = np.zeros(max(token_bytes().values()) + 1, bool)
    for token, rank in token_bytes().items():
        out[rank] = token.startswith(b" ")
    return out
