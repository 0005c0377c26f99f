"""Connected components of an undirected graph of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is its smallest node.

    Each node is tied to its smallest neighbour below; its other neighbours below are tied to
    that one in its stead, until no node has two. What is left is a forest, in which pointers
    then double their reach each round. Nothing but the test for an end reaches the driver: joins
    are merged, as files of links are far smaller than the links.
    Links with a null end count for nothing.
    """
    edges = store(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    while True:
        lowest = store(
            edges.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("below")), "lowest"
        )
        if lowest.where("below > 1").isEmpty():
            break
        tied = lowest.select("u", F.col("low").alias("v"))
        moved = (
            edges.join(lowest.hint("merge"), "u").where("v <> low").select(F.col("v").alias("u"), "low")
        )
        edges = store(tied.union(moved).distinct(), "edges")
    above = lowest.select("u", "low")
    while True:
        up = above.select(F.col("u").alias("low"), F.col("low").alias("top"))
        above = store(
            above.join(up.hint("merge"), "low", "left").select(
                "u", F.coalesce("top", "low").alias("low"), F.col("top").isNotNull().alias("moved")
            ),
            "pointers",
        )
        ended = above.where("moved").isEmpty()
        above = above.select("u", "low")
        if ended:
            break
    roots = above.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return above.select(F.col("u").alias("node"), F.col("low").alias("component")).union(roots)


def lowest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that links (i, j) reach, by halving paths."""
    up = np.arange(n)
    while True:
        before = up.copy()
        least = np.minimum(up[i], up[j])
        np.minimum.at(up, up[i], least)
        np.minimum.at(up, up[j], least)
        up = up[up]
        if np.array_equal(up, before):
            return up
