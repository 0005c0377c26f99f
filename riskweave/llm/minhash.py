"""Near-duplicate documents by one-permutation MinHash with optimal densification."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, release, store, table
from .graph import components, lowest

WORDS = 5  # of a shingle
PERCENT = 80  # similarity that links, in percent
BINS = 512  # of the one permutation
ROWS = 8  # bins of a band: at a similarity of 0.8 all 64 bands miss a pair 8 times in a million
FAMILIES = 8  # orders by which buckets choose their centre
SMALL = 8  # members from which on a bucket is compared in blocks, not in joined pairs
BLOCK = 256  # members of a bucket that are compared at a time
COLUMNS = 4096  # shingles that a block lays out at a time

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles.

    A-Z become lower case; words end at space, tab, line feed, vertical tab, form feed and
    carriage return. A text of fewer words is one shingle, one without words none.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(words, len(codes))
    rolled = np.full(len(codes) - size + 1, size, np.uint64)
    for k in range(size):
        rolled = rolled * _MIX + codes[k : k + len(rolled)]
        rolled ^= rolled >> np.uint64(32)
    return np.unique(_mixed(rolled))


@cache
def _donors(attempt: int) -> np.ndarray:
    """The bin that each empty bin asks at this attempt, the same for all documents."""
    asked = np.arange(BINS, dtype=np.uint64) + np.uint64(attempt + 1) * np.uint64(BINS)
    return (_mixed(asked * _MIX) % np.uint64(BINS)).astype(np.int64)


def signature(sorted_set: np.ndarray) -> np.ndarray:
    """Least hash of each bin; empty bins borrow from the bins their own probe sequence names."""
    width = np.uint64(64 - BINS.bit_length() + 1)
    starts = np.arange(BINS, dtype=np.uint64) << width
    first = np.searchsorted(sorted_set, starts)
    ends = np.append(first[1:], len(sorted_set))
    full = first < ends
    out = sorted_set[np.minimum(first, len(sorted_set) - 1)]
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        donor = _donors(attempt)[empty]
        found = full[donor]
        out[empty[found]] = out[donor[found]]
        empty, attempt = empty[~found], attempt + 1
    return out


def band_keys(sorted_set: np.ndarray) -> np.ndarray:
    """One bucket key per band."""
    rows = signature(sorted_set).reshape(-1, ROWS)
    out = np.arange(len(rows), dtype=np.uint64)
    for k in range(ROWS):
        out = _mixed((out ^ rows[:, k]) * _MIX)
    return out.astype(np.int64)


def _sketched(documents: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, digest, keys): the digest stands for the whole set."""

    def sketch(frames):
        forget()
        for frame in frames:
            sets = [shingles(text, words) for text in frame["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].astype("Int64"),
                    "n_shingles": [len(s) for s in sets],
                    "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    "keys": [band_keys(s) if len(s) else np.zeros(0, np.int64) for s in sets],
                }
            )

    return documents.select("doc_id", "text").mapInPandas(
        sketch, "doc_id long, n_shingles long, digest binary, keys array<long>"
    )


def deduplicate(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Documents with equal sets are one class, which its smallest doc_id stands for. In every
    bucket one member is the centre of a star: in an eighth of the buckets the one that shares
    most buckets, in the others the first by an order of its family; edges from it are confirmed
    on full sets. In buckets whose members do not all reach each other by then, all pairs that
    are still apart are compared: those of small buckets as joined pairs, those of large ones
    block by block inside the tasks, which give back a spanning forest and never the pairs.
    So no two alike documents that share a bucket stay apart. Confirmed links make components.

    Texts that are null or without words have an empty set and link with nothing. Rows without a
    doc_id have no component (null) and are not kept. Rows that repeat a doc_id are answered
    each; they count as one document, which has all their links.
    """
    sketches = store(_sketched(documents, words), "sketches")
    sound = sketches.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = store(sound.groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    members = store(
        sound.join(
            classes.select(F.col("id").alias("doc_id"), F.col("digest").alias("of")), "doc_id"
        )
        .where("digest = of")
        .select(F.col("doc_id").alias("id"), F.explode("keys").alias("key"))
        .distinct(),
        "members",
    )
    links = _links(documents, members, words, percent)
    groups = components(links.union(_ties(sound, classes)))
    labels = store(
        classes.join(groups, F.col("id") == F.col("node"), "left").select(
            "digest", F.coalesce("component", "id").alias("label")
        ),
        "labels",
    )
    component = F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc_id"))
    return (
        sketches.drop("keys")
        .join(labels, "digest", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
            F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
        )
    )


def _ties(sound: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes in which one doc_id stands with different texts."""
    repeated = (
        sound.groupBy("doc_id")
        .agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
        .where("low < high")
        .select("doc_id")
    )
    held = store(
        sound.join(repeated, "doc_id", "left_semi").join(classes, "digest").select("doc_id", "id"),
        "held",
    )
    first = held.groupBy("doc_id").agg(F.min("id").alias("b"))
    return held.join(first, "doc_id").where("id <> b").select(F.col("id").alias("a"), "b")


def _links(documents: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between classes, enough of them to connect what belongs together."""
    sizes = store(
        members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets"
    )
    shared = store(members.join(sizes, "key"), "shared")
    central = store(shared.groupBy("id").agg(F.sum("size").alias("weight")), "central")
    weighted = store(shared.join(central, "id"), "weighted")
    # Buckets of a family choose by the same order, so large ones mostly choose the same centre.
    family = F.pmod("key", F.lit(FAMILIES))
    order = F.when(family == 0, -F.col("weight")).otherwise(F.xxhash64("id", family))
    centres = store(
        weighted.groupBy("key").agg(
            F.min_by("id", F.struct(order.alias("order"), "id")).alias("centre")
        ),
        "centres",
    )
    texts = store(
        documents.select(F.col("doc_id").alias("id"), "text").join(central, "id", "left_semi"),
        "texts",
    )
    release(documents.sparkSession)
    candidates = weighted.join(centres, "key").where("id <> centre")
    links = store(_confirmed(candidates, texts, words, percent), "links")
    groups = components(links)
    labelled = store(
        weighted.join(groups, F.col("id") == F.col("node"), "left").select(
            "key", "id", "size", F.coalesce("component", "id").alias("label")
        ),
        "labelled",
    )
    apart = store(
        labelled.groupBy("key")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low < high")
        .select("key"),
        "apart",
    )
    rest = store(labelled.join(apart, "key"), "rest")
    small = rest.where(F.col("size") < SMALL)
    other = small.select("key", F.col("id").alias("centre"), F.col("label").alias("centre_label"))
    pairs = small.join(other, "key").where("label < centre_label")
    met = _met_in_blocks(rest.where(F.col("size") >= SMALL), texts, words, percent)
    return links.union(store(_confirmed(pairs, texts, words, percent), "links")).union(
        store(met, "links")
    )


def _met_in_blocks(rest: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what is alike among members (key, id, size, label) of a bucket.

    Every two members with different labels are compared on their full sets. Block i meets block
    j in the group (i, j), i <= j, so no bucket is one group, however large.
    """

    def sets(frames):
        for frame in frames:
            made = [shingles(text, words).tobytes() for text in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], "shingles": made})

    payload = (
        texts.join(rest.select("id").distinct(), "id", "left_semi")
        .mapInPandas(sets, "id long, shingles binary")
        .distinct()
    )
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(
            F.least(k, F.col("block")).alias("low"), F.greatest(k, F.col("block")).alias("high")
        ),
    )
    return (
        rest.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("meeting", F.explode(others))
        .join(payload, "id")
        .select("key", "meeting.low", "meeting.high", "block", "id", "label", "shingles")
        .groupBy("key", "low", "high")
        .applyInPandas(lambda name, frame: _meet(name, frame, percent), "a long, b long")
    )


def _meet(name, frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Each member that is alike to one of another label, and the smallest that it reaches."""
    _, low, high = name
    ids, labels = frame["id"].to_numpy(), frame["label"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
    one = np.flatnonzero(frame["block"].to_numpy() == low)
    two = np.flatnonzero(frame["block"].to_numpy() == high)
    sizes = np.array([len(s) for s in sets])
    both = _shared(sets, one, two)
    alike = 100 * both >= percent * (sizes[one][:, None] + sizes[two] - both)
    i, j = np.nonzero(alike & (labels[one][:, None] != labels[two]))
    used, place = np.unique(np.r_[ids[one[i]], ids[two[j]]], return_inverse=True)
    reached = used[lowest(place[: len(i)], place[len(i) :], len(used))]
    return pd.DataFrame({"a": used, "b": reached})[used != reached]


def _shared(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many shingles each set of ``one`` has in common with each of ``two``."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times > 1
    owner, column = owner[common[column]], (np.cumsum(common) - 1)[column[common[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(one), len(two)), np.int64)
    for start in range(0, int(common.sum()), COLUMNS):
        some = slice(*np.searchsorted(column, [start, start + COLUMNS]))
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[some], column[some] - start] = 1
        both += (held[one] @ held[two].T).astype(np.int64)
    return both


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The distinct (id, centre) pairs whose full sets are similar enough, as (a, b)."""
    distinct = store(
        pairs.select(
            F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")
        ).distinct(),
        "pairs",
    )

    def compared(frames):
        known, of = None, None
        for frame in frames:
            kept = []
            for left, right in zip(frame["left"], frame["right"], strict=True):
                if left != known:
                    known, of = left, shingles(left, words)
                other = shingles(right, words)
                both = len(np.intersect1d(of, other, assume_unique=True))
                kept.append(100 * both >= percent * (len(of) + len(other) - both))
            yield frame.loc[kept, ["a", "b"]]

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("right"))
    return (
        distinct.join(right, "b")
        .join(left, "a")
        .select("a", "b", "left", "right")
        .mapInPandas(compared, "a long, b long")
    )


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document over shingles of four words."""
    return deduplicate(table(spark, sf_dir, "documents", "doc_id", "text"), words=4)
