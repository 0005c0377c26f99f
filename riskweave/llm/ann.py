"""Nearest neighbours from balanced posting lists with replicated boundary vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store, table
from .vectors import cosines, matrix, tagged, unit

NEAREST = 5
SAMPLE_ROWS = 20_000  # vectors that centroids are fitted on; every vector is indexed
LIST_ROWS = 200  # vectors of a list to aim at
MOST_LISTS = 4_096  # centroids at most, so that they and their graph fit in every task
DEGREE = 24  # neighbours of a centroid in the graph
REPLICAS = 3  # lists that hold a boundary vector at most
BOUNDARY = 1.08  # a vector also joins lists whose centroid is so many times as far as the nearest
ASSIGN_STEPS = 24  # centroids looked into when a vector is placed
PROBE_STEPS = 512  # and when a query chooses its lists
PRUNE = 1.25  # a query reads lists whose centroid is so many times as far as the nearest
LEAST_LISTS = 8  # but never fewer than these
ROUNDING = 1e-9  # far above what two ways to compute one cosine differ by
HELD = 500_000  # candidates that a task holds before it cuts them down
BLOCK = 512  # queries, and vectors of a list, that are compared at a time


@dataclass(frozen=True)
class Index:
    """Unit centroids and, per centroid, its neighbours in the search graph."""

    centroids: np.ndarray
    neighbours: np.ndarray


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Centres of equal shares: halve the largest share across its widest direction, again and again."""
    shares = [np.arange(len(x))]
    while len(shares) < lists:
        shares.sort(key=len)
        share = shares.pop()
        if len(share) < 2:
            shares.append(share)
            break
        y = x[share] - x[share].mean(axis=0)
        direction = y[np.argmax((y * y).sum(axis=1))]
        for _ in range(8):
            direction = y.T @ (y @ direction)
            direction /= max(np.linalg.norm(direction), 1e-30)
        order = np.argsort(y @ direction, kind="stable")
        shares += [share[order[: len(order) // 2]], share[order[len(order) // 2 :]]]
    return np.stack([x[share].mean(axis=0) for share in shares])


def fit(vectors: DataFrame, rows: int) -> dict[int, Index]:
    """One index per vector length, from at most SAMPLE_ROWS vectors taken by a hash of the id.

    ``rows`` says how many vectors there are and so how many lists are wanted.
    """
    order = [F.xxhash64("id"), F.col("id")]
    sample = vectors.select("id", "embedding").orderBy(*order).limit(SAMPLE_ROWS).toPandas()
    made = {}
    for size, same in sample.groupby(sample["embedding"].str.len()):
        x = unit(matrix(same["embedding"]))
        lists = min(MOST_LISTS, max(1, round(rows * len(same) / len(sample) / LIST_ROWS)))
        centroids = balanced_centroids(x, min(lists, len(x)))
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-30)
        near = np.argsort(-(centroids @ centroids.T), axis=1, kind="stable")[:, 1 : DEGREE + 1]
        # A ring keeps every centroid within reach of every other.
        ring = (np.arange(len(centroids))[:, None] + 1) % len(centroids)
        made[int(size)] = Index(centroids, np.hstack([near, ring]))
    return made


def search_graph(index: Index, x: np.ndarray, steps: int) -> np.ndarray:
    """Distance of each unit row of ``x`` to the centroids it meets; infinite for the others.

    Best first: each step looks at the neighbours of the nearest centroid not yet looked into.
    All rows step together.
    """
    k = len(index.centroids)
    distance = np.full((len(x), k), np.inf)
    waiting = np.full((len(x), k), np.inf)
    rows = np.arange(len(x))
    entry = np.unique(np.linspace(0, k - 1, min(k, 16)).astype(int))
    new = np.broadcast_to(entry, (len(x), len(entry)))
    for _ in range(min(steps, k) + 1):
        unseen = np.isinf(distance[rows[:, None], new])
        found = np.einsum("nd,nkd->nk", x, index.centroids[new])
        found = np.sqrt(np.maximum(2.0 - 2.0 * found, 0.0))
        r, c = np.nonzero(unseen)
        distance[r, new[r, c]] = found[r, c]
        waiting[r, new[r, c]] = found[r, c]
        best = waiting.argmin(axis=1)
        waiting[rows, best] = np.inf
        new = index.neighbours[best]
    return distance


def lists_of(index: Index, x: np.ndarray, steps: int, ratio: float, least: int, most: int):
    """(row, list) pairs: centroids within ``ratio`` times the nearest distance, nearest first."""
    rows, lists = [], []
    for at in range(0, len(x), 512):
        distance = search_graph(index, x[at : at + 512], steps)
        take = min(most, distance.shape[1])
        order = np.argsort(distance, axis=1, kind="stable")[:, :take]
        ranked = np.take_along_axis(distance, order, axis=1)
        chosen = ranked <= np.maximum(ranked[:, :1], 1e-9) * ratio
        chosen[:, :least] = True
        chosen &= np.isfinite(ranked)
        r, c = np.nonzero(chosen)
        rows.append(r + at)
        lists.append(order[r, c])
    return np.concatenate(rows), np.concatenate(lists)


def nearest(embeddings: DataFrame, is_query, count: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``count`` nearest found of every query, best first.

    ``is_query`` is a condition on vec_id. Equal vectors form one class that is indexed and
    searched once, so copies neither fill a list nor repeat a search; of a class, as many of the
    smallest ids as can be needed answer. A query never finds its own id. Ties go to the smaller
    id. Rows without an id and null, zero or non-finite vectors take no part; repeated rows
    count once, and an id on rows with different vectors stands for the one of the least digest;
    vectors of different length never meet.
    """
    rows = store(tagged(embeddings).where("vec_id IS NOT NULL AND digest IS NOT NULL"), "rows")
    digests = store(rows.groupBy("vec_id").agg(F.min("digest").alias("digest")), "digests")
    few = Window.partitionBy("digest").orderBy("vec_id")
    members = store(
        digests.withColumn("place", F.row_number().over(few))
        .where(F.col("place") <= count + 1)
        .groupBy("digest")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
        .withColumn("id", F.col("members")[0]),
        "members",
    )
    reps = store(
        rows.withColumnRenamed("vec_id", "id")
        .join(members.select("id", "digest"), ["id", "digest"], "left_semi")
        .dropDuplicates(["id"])
        .select("id", "embedding"),
        "reps",
    )
    indexes = fit(reps, reps.count())
    queries = store(
        digests.where(is_query).join(members.select("digest", "id"), "digest").select(
            F.col("vec_id").alias("query_id"), F.col("id").alias("rep")
        ),
        "queries",
    )
    asked = reps.join(queries.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    shared = embeddings.sparkSession.sparkContext.broadcast(indexes)
    postings = _blocks(_placed(reps, shared, ASSIGN_STEPS, BOUNDARY, 1, REPLICAS))
    probes = _blocks(_placed(asked, shared, PROBE_STEPS, PRUNE, LEAST_LISTS, MOST_LISTS))
    pairs = probes.select(
        "size", "list", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")
    ).join(postings.select("size", "list", "ids", "vectors"), ["size", "list"])
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "id")
    hits = (
        pairs.mapInPandas(
            lambda frames: _compared(frames, count + 1), "rep long, id long, score double"
        )
        .distinct()
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= count + 1)
        .join(members.select("id", "members"), "id")
        .select("rep", "score", F.explode("members").alias("vec_id"))
        .withColumn("place", F.row_number().over(
            Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
        ))
        .where(F.col("place") <= count + 1)
        .groupBy("rep")
        .agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    )
    # A query's own id is among the first count + 1 or it is not; either way count remain.
    others = F.filter("found", lambda f: f["vec_id"] != F.col("query_id"))
    return (
        queries.join(store(hits, "hits"), "rep")
        .select("query_id", F.posexplode(F.slice(others, 1, count)).alias("at", "hit"))
        .select(
            "query_id",
            (F.col("at") + 1).cast("int").alias("rank"),
            "hit.vec_id",
            "hit.score",
        )
    )


def _placed(vectors: DataFrame, shared, steps, ratio, least, most) -> DataFrame:
    """(size, list, id, embedding): every vector in each of its lists."""

    def placed(frames):
        for frame in frames:
            for size, same in frame.groupby(frame["embedding"].str.len()):
                index = shared.value.get(int(size))
                x = unit(matrix(same["embedding"]))
                if index is None:  # a length that the sample did not hold: one list of its own
                    row, lists = np.arange(len(x)), np.zeros(len(x), int)
                else:
                    row, lists = lists_of(index, x, steps, ratio, least, most)
                yield pd.DataFrame(
                    {
                        "size": int(size),
                        "list": lists,
                        "id": same["id"].to_numpy()[row],
                        "embedding": same["embedding"].to_numpy()[row],
                    }
                )

    return vectors.mapInPandas(placed, "size int, list int, id long, embedding array<double>")


def _blocks(placed: DataFrame) -> DataFrame:
    """Vectors of a list in blocks of about BLOCK, whatever the size of the list.

    A list of n vectors is dealt over ceil(n / BLOCK) blocks by a hash of the id.
    """
    placed = store(placed, "placed")
    sizes = placed.groupBy("size", "list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    return (
        placed.join(sizes, ["size", "list"])
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        .groupBy("size", "list", "block")
        .agg(F.collect_list(F.struct("id", "embedding")).alias("rows"))
        .select(
            "size", "list", F.col("rows.id").alias("ids"), F.col("rows.embedding").alias("vectors")
        )
    )


def _compared(frames, count: int):
    """The ``count`` nearest of each query within all the pairs of blocks that a task gets.

    Candidates of a query are cut down to the nearest as they come, so that what a task returns
    hangs on its queries only, and what it holds is bounded by ``HELD``.
    """
    held: list[pd.DataFrame] = []
    rows = 0
    for frame in frames:
        for pair in zip(
            frame["q_ids"], frame["q_vectors"], frame["ids"], frame["vectors"], strict=True
        ):
            met = _met(*pair, count)
            held += met
            rows += sum(map(len, met))
            if rows >= HELD:
                held = [_first(held, count)]
                rows = len(held[0])
                if rows >= HELD // 2:  # so many queries: what is known of them goes on
                    yield held.pop()
                    rows = 0
    if held:
        yield _first(held, count)


def _met(q_ids, q_vectors, ids, vectors, count: int) -> list[pd.DataFrame]:
    """The ``count`` nearest of each query of one block among the vectors of another."""
    q, x = matrix(q_vectors), matrix(vectors)
    ids = np.asarray(ids)
    near = unit(q) @ unit(x).T
    # All that may be among the first by the exact score, which orders near-equal ones.
    last = len(ids) - min(len(ids), count)
    least = np.partition(near, last, axis=1)[:, last] - ROUNDING
    out = []
    for at in range(0, len(q), 64):
        row, col = np.nonzero(near[at : at + 64] >= least[at : at + 64, None])
        row += at
        score = cosines(q[row], x[col])
        found = {"rep": np.asarray(q_ids)[row], "id": ids[col], "score": score}
        out.append(_first([pd.DataFrame(found)], count))
    return out


def _first(frames: list[pd.DataFrame], count: int) -> pd.DataFrame:
    """The ``count`` nearest of each query, each candidate once, ties to the smaller id."""
    found = pd.concat(frames, ignore_index=True)
    rep, ids, score = (found[c].to_numpy() for c in ("rep", "id", "score"))
    order = np.lexsort((ids, -score, rep))
    rep, ids, score = rep[order], ids[order], score[order]
    new = np.r_[True, (rep[1:] != rep[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])]
    rep, ids, score = rep[new], ids[new], score[new]
    rank = np.arange(len(rep)) - np.searchsorted(rep, rep)
    kept = rank < count
    return pd.DataFrame({"rep": rep[kept], "id": ids[kept], "score": score[kept]})


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50."""
    embeddings = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(embeddings, F.col("vec_id") % 50 == 0)
