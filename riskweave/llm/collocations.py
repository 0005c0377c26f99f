"""Phrase collocations per language by best-first branch-and-bound growth of prefixes.

A phrase with prefix p scores at most 1000 * n / f(first word of p), since no phrase stands more
often than what follows any of its cuts. First words are expanded in the order of that bound: first
those that hold half of a language's frequent words, then, once the last place asked for has a
score, all others whose bound still reaches it. Prefixes grow word by word, and only those that
stand often enough grow further. After the second round nothing outside can reach the last place,
ties included.

Texts are kept as blocks of word numbers. A growth step counts 64-bit hashes, packed per share of
the hash space, and leaves a bit per place of a sieve of fixed size; what passes the sieves is then
counted by its words, so hashes only ever let too much through and decide nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exact import floor_div
from .common import release, store, table

LONGEST = 5  # words of a phrase
LEAST = 100  # occurrences of a phrase
COUNT = 2_000  # phrases per language
UNKNOWN = "und"


@dataclass(frozen=True)
class Sizes:
    """How the work is cut; results are the same for any."""

    block_bytes: int = 4 << 20  # text of a language that makes a block
    buffered_bytes: int = 16 << 20  # text that a task holds back at most, besides one document
    bundle_words: int = 2 << 20  # words of one language that are scanned together
    flush: int = 4 << 20  # hashes that a task gathers before it sends them on
    share_words: int = 1 << 20  # words of the corpus per share of the hash space
    bits: int = 26  # a sieve has at most 2 ** bits places, 8 MB


SIZES = Sizes()

_END = b"."  # stands for every end of a piece; never part of a word
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else _END[0] if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b
    for b in range(256)
)
_STEP = np.uint64(0x9E3779B97F4A7C15)


# --- Blocks of word numbers -------------------------------------------------------------------


def words_of(texts: list[bytes]) -> list[bytes]:
    """Words of the texts in order, with an end mark between pieces and between texts."""
    return _END.join(texts).translate(_FOLD).replace(_END, b" . ").split(b" ")


def blocks(documents: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """(lang, n, ids, words): blocks of texts of one language; ids count into words, ends are -1."""

    def packed(lang: str, texts: list[bytes]) -> pa.RecordBatch:
        found = [w for w in words_of(texts) if w]
        coded = pa.array(found, pa.binary()).dictionary_encode()
        ids = coded.indices.to_numpy().astype(np.int32)
        words = coded.dictionary.to_pylist()
        if _END in words:
            ids = np.where(ids == words.index(_END), np.int32(-1), ids)
        data = zstandard.ZstdCompressor(level=1).compress(ids.tobytes())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang]),
                pa.array([int((ids >= 0).sum())], pa.int64()),
                pa.array([data], pa.binary()),
                pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
            ],
            ["lang", "n", "ids", "words"],
        )

    def run(batches):
        held: dict[str, list[bytes]] = {}
        length: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                langs = part.column("lang").to_pylist()
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for lang, text in zip(langs, texts, strict=True):
                    if text:
                        lang = UNKNOWN if lang is None else lang
                        held.setdefault(lang, []).append(text)
                        length[lang] = length.get(lang, 0) + len(text)
                        if length[lang] >= sizes.block_bytes:
                            yield packed(lang, held.pop(lang))
                            del length[lang]
                if sum(length.values()) >= sizes.buffered_bytes:
                    yield from (packed(lang, texts) for lang, texts in held.items())
                    held, length = {}, {}
        yield from (packed(lang, texts) for lang, texts in held.items())

    return documents.select("lang", "text").mapInArrow(
        run, "lang string, n long, ids binary, words array<string>"
    )


@dataclass
class Bundle:
    """Words of one language from several blocks, as numbers into ``words``."""

    lang: str
    ids: np.ndarray
    words: pa.Array


def _bundles(batches, most: int) -> Iterator[Bundle]:
    waiting: dict[str, list[tuple[np.ndarray, pa.Array]]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for k, lang in enumerate(batch.column("lang").to_pylist()):
            data = zstandard.ZstdDecompressor().decompress(batch.column("ids")[k].as_py())
            ids = np.frombuffer(data, np.int32)
            words = batch.column("words")[k].values
            waiting.setdefault(lang, []).append((ids, words))
            sizes[lang] = sizes.get(lang, 0) + len(ids)
            if sizes[lang] >= most:
                yield _joined(lang, waiting.pop(lang))
                del sizes[lang]
    for lang, some in waiting.items():
        yield _joined(lang, some)


def _joined(lang: str, some: list[tuple[np.ndarray, pa.Array]]) -> Bundle:
    coded = pa.chunked_array([words for _, words in some]).combine_chunks().dictionary_encode()
    place = np.append(coded.indices.to_numpy(), -1).astype(np.int32)  # -1 stays -1
    start, parts = 0, []
    for ids, words in some:
        parts += [np.where(ids >= 0, place[start + ids], np.int32(-1)), np.array([-1], np.int32)]
        start += len(words)
    return Bundle(lang, np.concatenate(parts), coded.dictionary)


# --- Hashes and sieves ------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _word_hashes(words: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)


def _seed(lang: str) -> np.uint64:
    return _word_hashes(np.array([lang], dtype=object))[0]


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _empty(bits: int) -> np.ndarray:
    return np.zeros(1 << (bits - 3), np.uint8)


def _passes(sieve: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = _slot(hashes, (8 * len(sieve)).bit_length() - 1)
    return (sieve[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def phrase_hashes(langs: list[str], phrases: list[str]) -> list[list[int]]:
    """Hashes of the beginnings of each phrase: of its first word, of its first two, and so on."""
    split = [p.split(" ") for p in phrases]
    flat = np.array([w for words in split for w in words], dtype=object)
    hashes, out, at = _word_hashes(flat), [], 0
    seeds = {lang: _seed(lang) for lang in set(langs)}
    for lang, words in zip(langs, split, strict=True):
        gram = _mixed(hashes[at : at + 1] ^ seeds[lang])
        chain = [gram]
        for k in range(1, len(words)):
            chain.append(_mixed(chain[-1] * _STEP + hashes[at + k : at + k + 1]))
        out.append([int(x[0]) for x in chain])
        at += len(words)
    return out


def _walk(bundle: Bundle, sieves: dict, last: int, closed: bool):
    """(length, places, hashes) of the grams up to ``last`` words that may be frequent.

    ``sieves`` has the frequent words under "word", the first words to expand under "first", and
    the frequent grams under their length. A gram goes on if its beginning passed. With ``closed``
    all frequent grams with these first words are in the sieves, so its end must have passed too.
    """
    by_word = _word_hashes(bundle.words.to_numpy(zero_copy_only=False))
    seeded = _mixed(by_word ^ _seed(bundle.lang))
    ids = bundle.ids
    inside = ids >= 0
    often = np.append(_passes(sieves["word"], seeded), False)[ids]  # -1 finds the last
    first = np.append(_passes(sieves["first"], seeded), False)[ids] & often
    places = np.flatnonzero(first & inside)
    grams = seeded[ids[places]]
    alive = first
    yield 1, places, grams
    for length in range(2, last + 1):
        ok = places + length - 1 < len(ids)
        places, grams = places[ok], grams[ok]
        ok = often[places + length - 1]
        if closed and length > 2:
            ok &= ~first[places + 1] | alive[places + 1]
        places, grams = places[ok], grams[ok]
        grams = _mixed(grams * _STEP + by_word[ids[places + length - 1]])
        yield length, places, grams
        if length < last:
            ok = _passes(sieves[length], grams)
            places, grams = places[ok], grams[ok]
            alive = np.zeros(len(ids), bool)
            alive[places] = True


def _assembled(rows, bits: int) -> dict[int, np.ndarray]:
    """Sieves by length from their shares; one sieve has a fixed size, however many grams there are."""
    out: dict[int, np.ndarray] = {}
    for row in rows:
        part = np.frombuffer(row.bits, np.uint8)
        out.setdefault(row.length, _empty(bits))[row.share * len(part) : (row.share + 1) * len(part)] |= part
    return out


def _part(slots: np.ndarray, share: int, size: int) -> bytes:
    """The bits of a share, which has so many places of the sieve."""
    sieve = np.zeros(size, np.uint8)
    sieve[slots - share * size] = 1
    return np.packbits(sieve, bitorder="little").tobytes()


def _opened(packed: dict) -> dict:
    return {k: np.frombuffer(zstandard.decompress(v), np.uint8) for k, v in packed.items()}


class Corpus:
    """Stored blocks, and the ways of counting in them."""

    def __init__(self, documents: DataFrame, least: int, cut: Sizes):
        self.blocks = store(blocks(documents, cut), "blocks")
        self.least, self.cut = least, cut
        self.sizes = self.blocks.groupBy("lang").agg(F.sum("n").alias("n"))
        words = self.blocks.agg(F.sum("n")).first()[0] or 0
        # A gram that stands often enough takes least words of the corpus: 16 places for each.
        self.whole = min(cut.bits, max(13, int(16 * words / least).bit_length()))
        # Bits of the hash that say the share: shares grow with the corpus, a share's sieve shrinks.
        self.share_bits = min(self.whole - 6, int(words // cut.share_words).bit_length())
        self.places = 1 << (self.whole - self.share_bits)  # of the sieve, per share

    def _shared(self, sieves: dict):
        """The sieves for all tasks, packed: their bits are sparse."""
        pack = zstandard.ZstdCompressor(level=3).compress
        return self.blocks.sparkSession.sparkContext.broadcast({k: pack(v.tobytes()) for k, v in sieves.items()})

    def frequent(self, sieves: dict, length: int) -> np.ndarray:
        """A sieve of the grams of ``length`` words whose hash stands often enough."""
        bits, least, cut, places, whole = self.share_bits, self.least, self.cut, self.places, self.whole
        shared = self._shared(sieves)

        def sent(hashes: np.ndarray):
            hashes, counts = np.unique(hashes, return_counts=True)
            share = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), int)
            first = np.flatnonzero(np.r_[True, share[1:] != share[:-1]]) if len(share) else np.zeros(0, int)
            ends = np.r_[first[1:], len(hashes)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(share[first], pa.int64()),
                    pa.array([hashes[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                    pa.array(
                        [counts[a:b].astype(np.uint32).tobytes() for a, b in zip(first, ends)], pa.binary()
                    ),
                ],
                ["share", "hashes", "counts"],
            )

        def run(batches):
            gathered, size = [], 0
            opened = _opened(shared.value)
            for bundle in _bundles(batches, cut.bundle_words):
                if length == 1:
                    seeded = _mixed(_word_hashes(bundle.words.to_numpy(zero_copy_only=False)) ^ _seed(bundle.lang))
                    grams = seeded[bundle.ids[bundle.ids >= 0]]
                else:
                    *_, (_, _, grams) = _walk(bundle, opened, length, True)
                gathered.append(grams)
                size += len(grams)
                if size >= cut.flush:
                    yield from sent(np.concatenate(gathered))
                    gathered, size = [], 0
            if size:
                yield from sent(np.concatenate(gathered))

        def summed(frame: pd.DataFrame) -> pd.DataFrame:
            share = int(frame["share"].iloc[0])
            hashes = np.frombuffer(b"".join(frame["hashes"]), np.uint64)
            counts = np.frombuffer(b"".join(frame["counts"]), np.uint32)
            order = np.argsort(hashes, kind="stable")
            hashes, counts = hashes[order], counts[order].astype(np.int64)
            first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            many = hashes[first][np.add.reduceat(counts, first) >= least]
            made = [_part(_slot(many, whole), share, places)] if len(many) else []
            return pd.DataFrame({"length": length, "share": share, "bits": made})

        rows = (
            self.blocks.mapInArrow(run, "share long, hashes binary, counts binary")
            .groupBy("share")
            .applyInPandas(summed, "length int, share long, bits binary")
            .collect()  # at most one sieve: 8 MB
        )
        shared.destroy()
        return _assembled(rows, whole).get(length, _empty(whole))

    def sieve(self, phrases: DataFrame) -> dict[int, np.ndarray]:
        """Sieves of all beginnings of the phrases, by their number of words."""
        bits, places, whole = self.share_bits, self.places, self.whole

        def run(frames):
            for frame in frames:
                chains = phrase_hashes(frame["lang"].tolist(), frame["phrase"].tolist())
                made = {(k, h >> (64 - whole)) for chain in chains for k, h in enumerate(chain, 1)}
                yield pd.DataFrame(list(made), columns=["length", "slot"]).assign(
                    share=[slot >> (whole - bits) for _, slot in made]
                )

        def packed(frame: pd.DataFrame) -> pd.DataFrame:
            share = int(frame["share"].iloc[0])
            made = _part(frame["slot"].to_numpy(), share, places)
            return pd.DataFrame({"length": frame["length"].iloc[:1], "share": share, "bits": [made]})

        rows = (
            phrases.select("lang", "phrase")
            .mapInPandas(run, "length int, slot long, share long")
            .groupBy("length", "share")
            .applyInPandas(packed, "length int, share long, bits binary")
            .collect()  # at most LONGEST sieves
        )
        return _assembled(rows, whole)

    def counted(self, sieves: dict, lengths: range, closed: bool) -> DataFrame:
        """(lang, phrase, words, a, inner) of the grams that pass the sieves, counted by their words.

        ``inner`` says that all occurrences have the same word before them, or all the same after
        them: then a longer phrase stands as often.
        """
        shared = self._shared(sieves)
        least, most, bits = self.least, self.cut.bundle_words, self.share_bits

        def run(batches):
            opened = _opened(shared.value)
            for bundle in _bundles(batches, most):
                for length, places, grams in _walk(bundle, opened, lengths[-1], closed):
                    if length not in lengths:
                        continue
                    ok = _passes(opened["word" if length == 1 else length], grams)
                    if ok.any():
                        yield _phrases(bundle, length, places[ok], grams[ok], bits)

        return (
            self.blocks.mapInArrow(
                run,
                "share long, lang string, words int, phrase array<string>, n array<long>, "
                "left array<string>, right array<string>",
            )
            .groupBy("share")
            .applyInPandas(
                lambda frame: _summed(frame, least), "lang string, phrase string, words int, a long, inner boolean"
            )
        )


def _phrases(bundle: Bundle, length: int, places: np.ndarray, grams: np.ndarray, bits: int) -> pa.RecordBatch:
    """The distinct phrases at the places, with their one neighbour on each side, or null.

    They travel as lists, a row for what the bundle has of a share of the hash space.
    """
    ids = bundle.ids
    share = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
    spelled = np.stack([ids[places + k] for k in range(length)])
    order = np.argsort(grams, kind="stable")
    spelled, places, share = spelled[:, order], places[order], share[order]
    new = np.r_[True, (spelled[:, 1:] != spelled[:, :-1]).any(axis=0)]
    first = np.flatnonzero(new)  # a clash of hashes only makes more rows of one phrase
    counts = np.diff(np.r_[first, len(places)])
    sides = []
    for at in (places - 1, places + length):
        beside = np.where((at >= 0) & (at < len(ids)), ids[np.clip(at, 0, len(ids) - 1)], -1)
        low, high = np.minimum.reduceat(beside, first), np.maximum.reduceat(beside, first)
        sides.append(bundle.words.take(pa.array(low, mask=(low != high) | (low < 0))))
    parts = [bundle.words.take(pa.array(spelled[k, first])) for k in range(length)]
    phrase = pc.binary_join_element_wise(*parts, " ") if length > 1 else parts[0]
    share = share[first]
    begin = np.flatnonzero(np.r_[True, share[1:] != share[:-1]])
    offsets = pa.array(np.r_[begin, len(share)].astype(np.int32))
    columns = [phrase, pa.array(counts.astype(np.int64)), *sides]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(share[begin]),
            pa.array([bundle.lang] * len(begin), pa.string()),
            pa.array(np.full(len(begin), length, np.int32)),
            *[pa.ListArray.from_arrays(offsets, column) for column in columns],
        ],
        ["share", "lang", "words", "phrase", "n", "left", "right"],
    )


def _summed(frame: pd.DataFrame, least: int) -> pd.DataFrame:
    """Counts of the phrases of a share, and whether one neighbour is the same everywhere."""
    sizes = frame["phrase"].str.len().to_numpy()
    lang = frame["lang"].to_numpy().repeat(sizes)
    words = frame["words"].to_numpy().repeat(sizes)
    phrase, n, left, right = (np.concatenate(frame[c].tolist()) for c in ("phrase", "n", "left", "right"))
    lang_code, langs = pd.factorize(lang)
    code, _ = pd.factorize(phrase)
    code = code.astype(np.int64) * len(langs) + lang_code
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
    a = np.add.reduceat(n[order].astype(np.int64), first)
    inner = np.zeros(len(first), bool)
    for side in (left, right):
        beside = pd.factorize(side)[0][order]  # null is -1
        low = np.minimum.reduceat(beside, first)
        inner |= (low >= 0) & (low == np.maximum.reduceat(beside, first))
    often = a >= least
    one = order[first][often]
    return pd.DataFrame(
        {"lang": lang[one], "phrase": phrase[one], "words": words[one], "a": a[often], "inner": inner[often]}
    )


# --- Growth -----------------------------------------------------------------------------------


def collocations(
    documents: DataFrame, count: int = COUNT, least: int = LEAST, cut: Sizes = SIZES
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``count`` best phrases of each language.

    A null lang is ``und``, a null text empty; rows count as often as they are repeated, and
    further columns are left out. Languages without a phrase that stands ``least`` times are not
    in the result. Phrases are ordered by score, then a, both descending, then by their bytes.
    """
    corpus = Corpus(documents, least, cut)
    common: dict = {"word": corpus.frequent({}, 1)}
    common["first"] = common["word"]
    words = store(
        corpus.counted(common, range(1, 2), False).select("lang", "phrase", "a"), "words"
    )
    sizes = store(corpus.sizes, "sizes")
    bar = _half(words)  # expand at first what stands at most so often
    grown: DataFrame | None = None
    for last_round in (False, True):
        todo = words.join(bar, "lang")
        todo = todo.where((F.col("a") > F.col("above")) & (F.col("a") <= F.col("upto")))
        if last_round and todo.isEmpty():
            break
        sieves = common | {"first": corpus.sieve(todo).get(1, _empty(corpus.whole))}
        for length in range(2, LONGEST + 1):
            sieves[length] = corpus.frequent(sieves, length)
            release(documents.sparkSession)
        found = corpus.counted(sieves, range(2, LONGEST + 1), True)
        # The sieve may let in words of the other round; each first word belongs to one round.
        first = F.substring_index("phrase", " ", 1)
        own = todo.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_first"))
        found = store(
            found.join(own, (F.col("lang") == F.col("_lang")) & (first == F.col("_first")), "left_semi"),
            "grown",
        )
        grown = found if grown is None else grown.unionByName(found)
        known = words.unionByName(grown.select("lang", "phrase", "a"))
        ranked = store(_ranked(_scored(corpus, grown, known, common, sizes), count), "ranked")
        if not last_round:
            reached = ranked.where(F.col("rank") == count).select("lang", "score")
            bar = (
                bar.join(reached, "lang", "left")
                .join(sizes, "lang")
                .select(
                    "lang",
                    F.col("upto").alias("above"),
                    # floor(1000 n / f) reaches the score exactly when f is at most this.
                    F.when(F.col("score") > 0, floor_div(_wide(F.col("n")) * 1000, _wide(F.col("score"))))
                    .otherwise(F.col("n"))
                    .cast("long")
                    .alias("upto"),
                )
            )
            bar = store(bar, "bar")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _wide(number: Column) -> Column:
    return number.cast("decimal(19,0)")


def _half(words: DataFrame) -> DataFrame:
    """(lang, above, upto): the frequency up to which words hold half of a language's occurrences.

    Words are counted by frequency first: a language has at most sqrt(2 n) different ones.
    """
    by = words.groupBy("lang", "a").agg(F.sum("a").alias("held"))
    ascending = Window.partitionBy("lang").orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("lang")
    reached = by.withColumn("sum", F.sum("held").over(ascending)).withColumn("all", F.sum("held").over(whole))
    return store(
        reached.groupBy("lang").agg(
            F.lit(0).cast("long").alias("above"),
            F.coalesce(F.max(F.when(2 * F.col("sum") <= F.col("all"), F.col("a"))), F.min("a")).alias("upto"),
        ),
        "half",
    )


def _scored(corpus: Corpus, grown: DataFrame, known: DataFrame, common: dict, sizes: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases that no longer one stands as often as."""
    kept = grown.where(~F.col("inner") | (F.col("words") == LONGEST)).select("lang", "phrase", "words", "a")
    cuts = store(
        kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        .withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
        .withColumn("rest", F.expr("substring(phrase, length(first) + 2)")),
        "cuts",
    )
    # Ends of phrases may begin with a word that is not expanded: those are counted as they are.
    missing = store(
        cuts.select("lang", F.col("rest").alias("phrase")).distinct().join(
            known.select("lang", "phrase"), ["lang", "phrase"], "left_anti"
        ),
        "missing",
    )
    if not missing.isEmpty():
        sieves = corpus.sieve(missing)
        top = max(sieves)
        asked = corpus.counted(common | {"first": sieves[1]} | sieves, range(2, top + 1), False)
        asked = asked.join(missing, ["lang", "phrase"], "left_semi").select("lang", "phrase", "a")
        known = known.unionByName(store(asked, "ends"))
    left = known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    parts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(sizes, "lang")
    product = (F.lit(1000).cast("decimal(4,0)") * _wide(F.col("a")) * _wide(F.col("n"))).cast("decimal(38,0)")
    score = floor_div(product, (_wide(F.col("l")) * _wide(F.col("r"))).cast("decimal(38,0)")).cast("long")
    return (
        parts.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min("cut").alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    )


def _ranked(scored: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language."""
    return collocations(table(spark, sf_dir, "documents", "lang", "text"))
