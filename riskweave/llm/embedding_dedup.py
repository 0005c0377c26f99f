"""Near-duplicate vectors by p-stable hashing of normalised vectors and exact cosines.

A key is a row of quantised random projections; vectors that share a key in some table are compared
exactly. Two unrelated unit vectors are as far apart as in any corpus, so with keys of one length
they would meet in a fixed share of all pairs. Keys therefore grow with the logarithm of the number
of vectors, so that a vector meets about ``MEETINGS`` unrelated ones at any size, and the number of
tables follows from the chance that a pair at the similarity asked for shares a key.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store, table
from .graph import components, lowest
from .vectors import cosines, matrix, tagged, unit

SIMILARITY = 0.9
MISSED = 0.002  # chance that no table holds a pair of just that cosine; a tenth of it at 0.92
MEETINGS = 30  # unrelated vectors that one meets in all tables, about
LEAST_PROJECTIONS = 8
WIDTH = 2.0  # of a quantised step; normalised vectors are at most 2 apart
BLOCK = 256  # vectors of a bucket that are compared at a time
SMALL = 16  # members of a bucket up to which pairs of many buckets are formed together
PAIRS_AT_A_TIME = 100_000
ROWS_AT_A_TIME = 256
FIRST_TABLES = 8  # tables that are looked into at first for where a pair meets


def collision(distance: float) -> float:
    """Chance that two points so far apart fall into one step of a projection."""
    t = WIDTH / distance
    below = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def design(vectors: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """(projections of a key, tables) for so many vectors."""
    near = collision(math.sqrt(2 - 2 * similarity))
    apart = collision(math.sqrt(2))
    needed = math.log(1 / MISSED)
    grown = math.log(max(1.0, needed * vectors / MEETINGS)) / math.log(near / apart)
    projections = max(LEAST_PROJECTIONS, math.ceil(grown))
    return projections, math.ceil(needed / near**projections)


@cache
def _directions(size: int, tables: int, projections: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(20_000 + size)
    return (
        made.standard_normal((size, tables * projections)),
        made.uniform(0.0, WIDTH, tables * projections),
    )


def keys(x: np.ndarray, projections: int, tables: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """One bucket key per row and table, of 64 bits; tables never share a key by design.

    With ``start`` and ``stop`` the keys of some of the tables.
    """
    stop = tables if stop is None else stop
    directions, shifts = _directions(x.shape[1], tables, projections)
    some = slice(start * projections, stop * projections)
    directions, shifts = directions[:, some], shifts[some]
    numbers = np.arange(start, stop, dtype=np.uint64) + np.uint64(x.shape[1] << 20)
    out = np.empty((len(x), stop - start), np.int64)
    for at in range(0, len(x), ROWS_AT_A_TIME):
        u = unit(x[at : at + ROWS_AT_A_TIME])
        steps = np.floor((u @ directions + shifts) / WIDTH).astype(np.int64).astype(np.uint64)
        steps = steps.reshape(len(u), stop - start, projections)
        key = np.broadcast_to(numbers, (len(u), stop - start))
        for k in range(projections):
            key = (key ^ steps[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            key = key ^ (key >> np.uint64(29))
        out[at : at + ROWS_AT_A_TIME] = key.view(np.int64)
    return out


def deduplicate(embeddings: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Equal vectors are one class and are hashed once. Buckets are compared block by block; a pair
    counts in the first table only that holds both, so counts and a spanning forest of the links
    leave the task, never the pairs. Rows without an id, and those with null, zero or non-finite
    vectors, have no links; without an id component_id is null and kept false. Rows that repeat
    an id with the same vector count once; with different vectors each row has the links of its
    own one. Vectors of different length never link.

    What is joined grows with the vectors, and Spark takes it for far smaller than it is: the keys
    that a function makes of a vector, rows of an explode, packed files. So all joins are merged.
    """
    rows = store(tagged(embeddings), "rows")
    known = rows.where("digest IS NOT NULL")
    # Copies of a vector: one of them, their ids counted and their smallest one.
    classes = store(
        store(
            known.groupBy("digest").agg(
                F.min("vec_id").alias("id"),
                F.count_distinct("vec_id").alias("copies"),
                F.first("embedding").alias("embedding"),
            ),
            "classes",
        ).withColumn("node", F.monotonically_increasing_id()),
        "numbered",
    )
    found = store(_compared(classes, similarity), "links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = components(found.select(F.col("node").alias("a"), F.col("lowest").alias("b")))
    placed = store(
        classes.select("digest", "node", "id", "copies")
        .join(linked.hint("merge"), "node", "left")
        .join(grouped.hint("merge"), "node", "left")
        .withColumn("component", F.coalesce("component", "node")),
        "placed",
    )
    # Stored, so that the join after it may split a component that holds most classes.
    smallest = store(placed.groupBy("component").agg(F.min("id").alias("component_id")), "smallest")
    labels = placed.join(smallest.hint("merge"), "component").select(
        "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    lowest_id = F.coalesce("component_id", "vec_id")
    return rows.drop("embedding").join(labels.hint("merge"), "digest", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        lowest_id.alias("component_id"),
        F.coalesce(F.col("vec_id") == lowest_id, F.lit(False)).alias("kept"),
    )


def _compared(classes: DataFrame, similarity: float) -> DataFrame:
    """(node, links, lowest): per task, how many vectors a class links with, and one to tie it to."""
    projections, tables = design(classes.count(), similarity)

    def hashed(frames):
        for frame in frames:
            for _, same in frame.groupby(frame["embedding"].str.len()):
                found = keys(matrix(same["embedding"]), projections, tables)
                yield pd.DataFrame({"node": np.repeat(same["node"].to_numpy(), tables), "key": found.ravel()})

    members = classes.select("node", "embedding").mapInPandas(hashed, "node long, key long")
    shared = store(
        members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(
            "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
        ),
        "buckets",
    )
    placed = store(
        members.join(shared.hint("merge"), "key").withColumn(
            "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        ),
        "members",
    )
    # Block i meets block j in the group (i, j), i <= j; every member goes where its block does.
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(
            F.least(k, F.col("block")).alias("low"), F.greatest(k, F.col("block")).alias("high")
        ),
    )
    group = ["key", "low", "high"]
    meetings = (
        placed.withColumn("meeting", F.explode(others))
        .join(classes.select("node", "copies", "embedding").hint("merge"), "node")
        .select("key", "meeting.low", "meeting.high", "block", "node", "copies", "embedding")
        .repartition(*group)
        .sortWithinPartitions(*group, "block", "node")
    )
    return meetings.mapInPandas(
        lambda frames: _met(frames, similarity, projections, tables), "node long, links long, lowest long"
    )


def _met(frames, similarity: float, projections: int, tables: int):
    """Links of the groups of a sorted partition; a group may go on in the next frame."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        group = frame[["key", "low", "high"]].to_numpy()
        new = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
        if len(new):
            yield from _linked(frame.iloc[: new[-1]], similarity, projections, tables)
            frame = frame.iloc[new[-1] :]
        rest = frame.reset_index(drop=True)  # a group has at most two blocks
    if rest is not None:
        yield from _linked(rest, similarity, projections, tables)


def _linked(frame: pd.DataFrame, similarity: float, projections: int, tables: int):
    """Links within whole groups, summed per class."""
    for _, same in frame.groupby(frame["embedding"].str.len()):
        group = same[["key", "low", "high"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(same)])
        x = matrix(same["embedding"])
        u = unit(x)
        block, node, copies = (same[c].to_numpy() for c in ("block", "node", "copies"))
        # Within a group of one block all pairs are due, else those of one block with the other.
        crossing = group[:, 1] != group[:, 2]
        a, b = _small_pairs(starts, sizes)
        a, b = _near(u, a, b, similarity)
        left, right = [a], [b]
        for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            i, j = np.nonzero(np.triu(u[start : start + size] @ u[start : start + size].T >= similarity - 1e-9, 1))
            left.append(i + start)
            right.append(j + start)
        a, b = np.concatenate(left), np.concatenate(right)
        due = (node[a] != node[b]) & (~crossing[a] | (block[a] != block[b]))
        a, b = a[due], b[due]
        parts = [cosines(x[a[k : k + PAIRS_AT_A_TIME]], x[b[k : k + PAIRS_AT_A_TIME]]) >= similarity
                 for k in range(0, len(a), PAIRS_AT_A_TIME)]
        sure = np.concatenate([np.zeros(0, bool), *parts])
        a, b = a[sure], b[sure]
        if not len(a):
            continue
        used, first = np.unique(node[np.r_[a, b]], return_index=True)
        i, j = np.searchsorted(used, node[a]), np.searchsorted(used, node[b])
        first = _first_here(x[np.r_[a, b][first]], i, j, group[a, 0], projections, tables)
        links = np.bincount(i, copies[b] * first, len(used)) + np.bincount(j, copies[a] * first, len(used))
        yield pd.DataFrame(
            {"node": used, "links": links.astype("int64"), "lowest": used[lowest(i, j, len(used))]}
        )


def _small_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within each group of at most SMALL rows, for all such groups together."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = sizes <= SMALL
    for size in np.unique(sizes[small]):
        i, j = np.triu_indices(size, 1)
        at = starts[sizes == size][:, None]
        left.append((at + i).ravel())
        right.append((at + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def _near(u: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float):
    """The pairs whose approximate cosine may reach the similarity."""
    kept = [
        k + np.flatnonzero(
            np.einsum("nd,nd->n", u[a[k : k + PAIRS_AT_A_TIME]], u[b[k : k + PAIRS_AT_A_TIME]])
            >= similarity - 1e-9
        )
        for k in range(0, len(a), PAIRS_AT_A_TIME)
    ]
    kept = np.concatenate([np.zeros(0, np.int64), *kept])
    return a[kept], b[kept]


def _first_here(
    x: np.ndarray, i: np.ndarray, j: np.ndarray, key: np.ndarray, projections: int, tables: int
) -> np.ndarray:
    """Whether each pair of rows first meets under this key.

    Keys are made again for a few tables first: most linked pairs meet early, and only the others
    need more of them.
    """
    out = np.zeros(len(i), bool)
    waiting, start, width = np.arange(len(i)), 0, FIRST_TABLES
    while len(waiting) and start < tables:
        stop = min(tables, start + width)
        rows, place = np.unique(np.r_[i[waiting], j[waiting]], return_inverse=True)
        known = keys(x[rows], projections, tables, start, stop)
        one, two = place[: len(waiting)], place[len(waiting) :]
        met = np.zeros(len(waiting), bool)
        for k in range(stop - start):
            hit = ~met & (known[one, k] == known[two, k])
            out[waiting[hit]] = known[one[hit], k] == key[waiting[hit]]
            met |= hit
        waiting, start, width = waiting[~met], stop, 2 * width
    return out


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and whether to keep it, of every vector."""
    return deduplicate(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
