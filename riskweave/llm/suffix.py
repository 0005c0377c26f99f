"""Exact removal of long repeated byte strings by a logarithmic family of sparse suffix arrays.

A repeated string of ``LENGTH`` bytes holds, wherever it stands, the same anchor: the place whose
following ``SEED`` bytes hash lowest within it. So only anchored suffixes are indexed, about one
in 60, in the order of their seed's hash, which puts suffixes with equal beginnings next to each
other. Batches of documents get such arrays one after the other; each is merge-scanned against
the levels of the index for seeds that stand elsewhere, then added, and levels of like size are
merged, so a suffix is rewritten a logarithmic number of times.

What the scans find are seeds. Around each occurrence of one, the strings that it anchors begin
at consecutive places, its run. Runs that are byte for byte the same elsewhere are repeated as a
whole; where they are not, as at the ends of a match, its strings are looked up: first blocks of
neighbouring strings by the bytes all of them share, then the strings of blocks where those stand
elsewhere too.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, mapped, release, store, table

LENGTH = 200  # bytes of a repeated string
SEED = 50  # bytes that an anchor is chosen and indexed by
BATCHES = 4  # batches that a whole corpus is added in
TEXTS_AT_A_TIME = 256

_BASE = 0x9E3779B97F4A7C15
_FULL = np.uint64(2**64 - 1)


@cache
def _bytes_table() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power(base: int, count: int) -> np.ndarray:
    return _powers(base, max(16, int(count).bit_length()))[:count]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@dataclass
class Hashes:
    """Hashes of any substring of ``data`` in constant time, from sums over its beginning."""

    data: np.ndarray

    def __post_init__(self):
        n = len(self.data)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_bytes_table()[self.data] * _power(_BASE, n), out=self._sums[1:])
        self._inverse = _power(pow(_BASE, -1, 2**64), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self._sums[end] - self._sums[start]) * self._inverse[start])

    def all(self, size: int) -> np.ndarray:
        """Hash of the ``size`` bytes from every place."""
        count = len(self.data) - size + 1
        return _mixed((self._sums[size:] - self._sums[:-size]) * self._inverse[:count])


@dataclass
class Runs:
    """Anchors of a text, and for each the first and last start of the strings it anchors."""

    seed: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray


def runs(hashes: Hashes, length: int = LENGTH, seed: int = SEED) -> Runs:
    n, width = len(hashes.data), length - seed + 1
    if n < length:
        none = np.zeros(0, np.int64)
        return Runs(none.astype(np.uint64), none, none, none)
    seeds = hashes.all(seed)
    # High half of the hash, then the place: the least is the leftmost of the lowest.
    ranked = (seeds & ~np.uint64(0xFFFFFFFF)) | np.arange(len(seeds), dtype=np.uint64)
    rows = -(-len(ranked) // width)
    padded = np.full(rows * width, _FULL)
    padded[: len(ranked)] = ranked
    padded = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    chosen = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    last = np.r_[first[1:], count] - 1
    anchor = chosen[first]
    return Runs(seeds[anchor], anchor, first, last)


def _zones(hashes: Hashes, found: Runs, length: int) -> np.ndarray:
    """Hash of all bytes that a run's strings cover, and of where in them the anchor stands."""
    shape = (found.anchor - found.first) * (length + 1) + found.last - found.first
    return _mixed(hashes.of(found.first, found.last + length) ^ _mixed(shape.astype(np.uint64)))


def suffixes(documents: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(row, seed, zone, anchor) of every anchored suffix; ``row`` names the document."""

    def anchored(frames):
        for some in _lots(frames):
            yield _suffixes(some["row"].to_numpy(), some["text"], length, seed)

    return documents.select("row", "text").mapInPandas(
        anchored, "row long, seed long, zone long, anchor int"
    )


def _suffixes(rows: np.ndarray, texts, length: int, seed: int) -> pd.DataFrame:
    seeds, zones, anchors = [], [], []
    for text in texts:
        hashes = Hashes(np.frombuffer(text.encode(), np.uint8))
        found = runs(hashes, length, seed)
        seeds.append(found.seed)
        zones.append(_zones(hashes, found, length))
        anchors.append(found.anchor)
    return pd.DataFrame(
        {
            "row": np.repeat(rows, [len(a) for a in anchors]),
            "seed": np.concatenate(seeds).view(np.int64),
            "zone": np.concatenate(zones).view(np.int64),
            "anchor": np.concatenate(anchors).astype(np.int32),
        }
    )


def _seeds(documents: DataFrame, length: int, seed: int) -> DataFrame:
    """(seed) of every anchored suffix, all that levels are made of."""

    def anchored(frames):
        for some in _lots(frames):
            texts = (np.frombuffer(text.encode(), np.uint8) for text in some["text"])
            found = [runs(Hashes(text), length, seed).seed for text in texts]
            yield pd.DataFrame({"seed": np.concatenate(found).view(np.int64)})

    return documents.select("text").mapInPandas(anchored, "seed long")


class IndexFamily:
    """Sorted arrays of seeds, the levels, of sizes that grow geometrically.

    A level holds each of its seeds once. ``add`` scans a batch against every level; what a scan
    returns are the seeds that stand in both, and those that the batch itself repeats.
    """

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []  # (batches held, seeds), largest first
        self.repeated: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """Scan and add the suffixes of a batch."""
        array = store(
            batch.groupBy("seed").agg(F.count("*").alias("n")).sortWithinPartitions("seed"),
            "array",
        )
        found = array.where("n > 1").select("seed")
        for _, level in self.levels:
            found = found.union(array.join(level, "seed", "left_semi").select("seed"))
        self.repeated.append(store(found.distinct(), "repeated"))
        held, merged = 1, array.select("seed")
        while self.levels and self.levels[-1][0] <= held:
            size, level = self.levels.pop()
            held, merged = held + size, merged.union(level)
        if held > 1:
            merged = store(merged.distinct().sortWithinPartitions("seed"), "level")
        self.levels.append((held, merged))

    def seeds(self) -> DataFrame:
        """Seeds that stand in two places or more."""
        out = self.repeated[0]
        for more in self.repeated[1:]:
            out = out.union(more)
        return out.distinct()


def repeats(
    documents: DataFrame, length: int = LENGTH, seed: int = SEED, batches: int = BATCHES
) -> DataFrame:
    """``documents`` with ``spans``: the [start, end) bytes of text that lie in repeated strings.

    Columns other than text pass through; none may be called row, data, whole, starts, counts or
    spans.

    Texts are UTF-8 bytes; a null text is empty. A string is repeated if it also starts anywhere
    else in the input, be it in the same text, overlapping itself, or in a row that repeats this
    one. Matches never cross texts. Every row is answered; a null doc_id stays null. Strings are
    compared by 64-bit hashes of all their bytes together with the place of their anchor.
    """

    def decoded(texts, spans):
        return [text.decode() for text in texts], spans

    return answered(
        documents, decoded, "text string, spans array<array<int>>", length, seed, batches
    )


def answered(
    documents: DataFrame,
    answer,
    added: str,
    length: int = LENGTH,
    seed: int = SEED,
    batches: int = BATCHES,
) -> DataFrame:
    """``documents`` with columns ``added`` instead of text, which ``answer`` makes of lists of
    texts in UTF-8 and of their spans; see ``repeats``.

    What is made of the spans is made where they are found: a second function after the first would
    keep a second worker for every task, as long as the executor lives.
    """
    source = documents.withColumn("text", F.coalesce("text", F.lit(""))).withColumn(
        "row", F.xxhash64("doc_id", "text")
    )
    family = IndexFamily()
    for k in range(batches):
        part = source.where(F.pmod("row", F.lit(batches)) == k)
        family.add(_seeds(part, length, seed))
    marked = store(
        _marked(suffixes(source, length, seed), store(family.seeds(), "seeds")), "marked"
    )
    del family
    release(documents.sparkSession)
    packed = _packed(source)
    look = marked.where("look").groupBy("row").agg(F.collect_set("anchor").alias("anchors"))
    sought = store(packed.select("row", "data").join(look, "row"), "sought")
    release(documents.sparkSession)
    found = store(_looked_up(sought, length, seed), "found")
    release(documents.sparkSession)
    whole = marked.where("whole").groupBy("row").agg(F.collect_list("anchor").alias("whole"))
    single = found.groupBy("row").agg(F.collect_set(F.struct("start", "count")).alias("single"))
    single = single.select(
        "row", F.col("single.start").alias("starts"), F.col("single.count").alias("counts")
    )
    covered = store(whole.join(single, "row", "full_outer"), "covered")
    release(documents.sparkSession)

    def spanned(data, whole, starts, counts):
        texts = [zstandard.decompress(d) for d in data]
        spans = [
            _spans(*one, length, seed) for one in zip(texts, whole, starts, counts, strict=True)
        ]
        return answer(texts, spans)

    # Merged, not broadcast, so that packing and this are never one stage with two workers a task.
    return mapped(
        packed.join(covered.hint("merge"), "row", "left").drop("row"),
        spanned,
        ("data", "whole", "starts", "counts"),
        added,
    )


def _marked(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """(row, anchor, whole, look) of suffixes with a repeated seed.

    ``whole``: the same run stands elsewhere, so all its strings are repeated. ``look``: its
    strings must be looked up one by one, or stand for those of equal runs in that.
    """
    shared = store(found.join(seeds, "seed"), "shared")
    zones = shared.groupBy("zone").agg(
        F.count("*").alias("n"), F.min(F.struct("row", "anchor")).alias("head"), F.min("seed").alias("seed")
    )
    zones = store(zones, "zones")
    # Only seeds with a run of its own kind need a look; of equal runs one does.
    lone = store(zones.where("n = 1").select("seed").distinct(), "lone")
    heads = store(
        zones.join(lone, "seed", "left_semi").select(
            F.col("head.row").alias("row"), F.col("head.anchor").alias("anchor"), F.lit(True).alias("look")
        ),
        "heads",
    )
    whole = zones.where("n > 1").select("zone", F.lit(True).alias("whole"))
    resolved = shared.join(whole, "zone", "left").select(
        "row", "anchor", F.coalesce("whole", F.lit(False)).alias("whole")
    )
    return (
        resolved.join(heads, ["row", "anchor"], "left")
        .select("row", "anchor", "whole", F.coalesce("look", F.lit(False)).alias("look"))
        .where("whole OR look")
    )


def _packed(source: DataFrame) -> DataFrame:
    """Documents with compressed bytes, ``data``, for a text, since they are shuffled."""

    def pack(texts):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return ([squeeze(text.encode()) for text in texts],)

    return mapped(source, pack, ("text",), "data binary")


def _looked_up(sought: DataFrame, length: int, seed: int) -> DataFrame:
    """(row, start, count): ``count`` strings from ``start`` that stand more than once among those
    looked up.

    Equal strings lie in blocks of one core. So a block whose core stands once is done with, one
    that is the same elsewhere is repeated as a whole, and only the rest goes string by string; of
    equal blocks one does.
    """

    def blocked(frames):
        for some in _lots(frames):
            yield _blocks(some["row"].to_numpy(), some["data"], some["anchors"], length, seed)

    def strings(frames):
        for some in _lots(frames):
            yield _strings(some, length)

    blocks = store(
        sought.mapInPandas(
            blocked, "core long, zone long, row long, start int, place int, count int"
        ),
        "blocks",
    )
    head = F.min(F.struct("row", "start", "place", "count")).alias("head")
    zones = store(blocks.groupBy("core", "zone").agg(F.count("*").alias("n"), head), "block_zones")
    lone = (
        zones.groupBy("core")
        .agg(F.count("*").alias("zones"), F.min("n").alias("least"))
        .where("zones > 1 AND least = 1")
    )
    heads = zones.join(lone, "core", "left_semi").groupBy("head.row")
    heads = heads.agg(F.collect_list("head").alias("heads")).select(
        "row", *[F.col(f"heads.{c}").alias(c) for c in ("start", "place", "count")]
    )
    single = store(
        sought.select("row", "data")
        .join(heads, "row")
        .mapInPandas(strings, "string long, row long, start int"),
        "looked",
    )
    release(sought.sparkSession)
    repeated = single.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    alone = single.join(repeated, "string").select("row", "start", F.lit(1).alias("count"))
    same = zones.where("n > 1").select("core", "zone")
    return blocks.join(same, ["core", "zone"], "left_semi").select("row", "start", "count").union(alone)


def _lots(frames):
    forget()
    for frame in frames:
        for at in range(0, len(frame), TEXTS_AT_A_TIME):
            yield frame.iloc[at : at + TEXTS_AT_A_TIME]


def _blocks(rows: np.ndarray, texts, anchors, length: int, seed: int) -> pd.DataFrame:
    """Blocks of the strings of the named anchors' runs.

    A block is some strings with neighbouring places before their anchor. ``core`` hashes the bytes
    that all of a full block share, ``zone`` those that its strings in this run cover; ``place``
    is how far the first of them, at ``start``, stands before the anchor.
    """
    size = max(1, length // 12)
    made = []
    for row, data, some in zip(rows, texts, anchors, strict=True):
        hashes = Hashes(np.frombuffer(zstandard.decompress(data), np.uint8))
        found = runs(hashes, length, seed)
        chosen = np.isin(found.anchor, some)
        anchor, first, last = found.anchor[chosen], found.first[chosen], found.last[chosen]
        least = (anchor - last) // size
        counts = (anchor - first) // size - least + 1
        run = np.repeat(np.arange(len(anchor)), counts)
        number = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts - least, counts)
        latest = anchor[run] - size * number
        start = np.maximum(latest - size + 1, first[run])
        end = np.minimum(latest, last[run])
        place = anchor[run] - start
        core = hashes.of(latest, latest - size + 1 + length) ^ _mixed(number.astype(np.uint64))
        shape = (place * (length + 1) + end - start).astype(np.uint64)
        zone = hashes.of(start, end + length) ^ _mixed(shape)
        made.append((_mixed(core), _mixed(zone), np.full(len(run), row), start, place, end - start + 1))
    core, zone, row, start, place, count = map(np.concatenate, zip(*made, strict=True))
    return pd.DataFrame(
        {
            "core": core.view(np.int64),
            "zone": zone.view(np.int64),
            "row": row,
            "start": start.astype(np.int32),
            "place": place.astype(np.int32),
            "count": count.astype(np.int32),
        }
    )


def _strings(some: pd.DataFrame, length: int) -> pd.DataFrame:
    """Hash of every string of the blocks in ``some``, together with the place of its anchor."""
    strings, starts = [], []
    for data, start, place, count in zip(
        some["data"], some["start"], some["place"], some["count"], strict=True
    ):
        hashes = Hashes(np.frombuffer(zstandard.decompress(data), np.uint8))
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        begin = np.repeat(start, count) + within
        before = (np.repeat(place, count) - within).astype(np.uint64)
        strings.append(_mixed(hashes.of(begin, begin + length) ^ _mixed(before)))
        starts.append(begin)
    return pd.DataFrame(
        {
            "string": np.concatenate(strings).view(np.int64),
            "row": np.repeat(some["row"].to_numpy(), [len(s) for s in starts]),
            "start": np.concatenate(starts).astype(np.int32),
        }
    )


def _spans(text: bytes, whole, starts, counts, length: int, seed: int) -> list[list[int]]:
    """Maximal covered [start, end) runs of one text.

    ``whole`` are anchors whose run is covered, and from each of ``starts`` so many strings are.
    """
    edge = np.zeros(len(text) + 1, np.int64)
    if whole is not None and len(whole):
        found = runs(Hashes(np.frombuffer(text, np.uint8)), length, seed)
        chosen = np.isin(found.anchor, whole)
        np.add.at(edge, found.first[chosen], 1)
        np.add.at(edge, found.last[chosen] + length, -1)
    if starts is not None and len(starts):
        begin = np.asarray(starts, np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + np.asarray(counts, np.int64) - 1 + length, -1)
    inside = np.cumsum(edge) > 0
    turns = np.flatnonzero(np.diff(np.r_[False, inside]))
    return turns.reshape(-1, 2).astype(int).tolist()


def remaining(text: str, spans) -> bytes:
    """The bytes of ``text`` outside ``spans``."""
    return outside(text.encode(), spans)


def outside(data: bytes, spans) -> bytes:
    """``data`` without ``spans``."""
    at, parts = 0, []
    for start, end in spans:
        parts.append(data[at:start])
        at = end
    return b"".join([*parts, data[at:]])


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from every document and the digest of what is left."""

    def digested(texts, spans):
        kept = [outside(t, s) for t, s in zip(texts, spans, strict=True)]
        sizes = [len(text) for text in texts]
        return (
            sizes,
            [n - len(k) for n, k in zip(sizes, kept, strict=True)],
            [len(s) for s in spans],
            [hashlib.sha256(k).hexdigest() for k in kept],
        )

    return answered(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        digested,
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    )
