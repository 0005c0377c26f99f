"""Fitted trees as plain expressions: a node table, SQL text and columns.

Scoring by expressions needs no vectors and no model object: the text runs wherever SQL runs, next
to the rules, and Spark plans it like any other projection.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Trees that are added up in one column; sums of sums keep generated code short.
_TREES_AT_A_TIME = 20

_TREE = re.compile(r"\s*Tree (\d+) \(weight ([^)]+)\):")
_SPLIT = re.compile(r"( *)(If|Else) \(feature (\d+) (<=|>) ([^)]+)\)")
_LEAF = re.compile(r"( *)Predict: (\S+)")


@dataclass(frozen=True)
class Node:
    """A split, whose rows with ``feature <= threshold`` go left, or a leaf with a prediction."""

    tree: int
    node: int
    weight: float
    feature: str | None = None
    threshold: float | None = None
    left: int | None = None
    right: int | None = None
    prediction: float | None = None


def tree_nodes(model: PipelineModel, features: Sequence[str]) -> list[Node]:
    """All nodes of the fitted trees, numbered within each tree from 0, the root."""
    out: list[Node] = []
    for number, weight, lines in _trees(model.stages[-1].toDebugString):
        nodes: list[Node] = []
        _grow(iter(lines), number, weight, features, nodes)
        out += sorted(nodes, key=lambda n: n.node)
    return out


def _trees(text: str):
    """(number, weight, lines) of each tree of the printed model."""
    number, weight, lines = None, 1.0, []
    for line in text.splitlines():
        if head := _TREE.match(line):
            if number is not None:
                yield number, weight, lines
            number, weight, lines = int(head[1]), float(head[2]), []
        elif number is not None and line.strip():
            lines.append(line)
    if number is not None:
        yield number, weight, lines


def _grow(lines, tree: int, weight: float, features: Sequence[str], nodes: list[Node]) -> int:
    """Read one subtree, append its nodes, return its number."""
    node = len(nodes)
    nodes.append(Node(tree, node, weight))  # holds the place
    line = next(lines)
    if leaf := _LEAF.match(line):
        nodes[node] = Node(tree, node, weight, prediction=float(leaf[2]))
        return node
    split = _SPLIT.match(line)
    if not split or split[2] != "If":
        raise ValueError(f"not a numeric split: {line.strip()}")
    left = _grow(lines, tree, weight, features, nodes)
    other = _SPLIT.match(next(lines))
    if not other or other[2] != "Else":
        raise ValueError("a split without its other side")
    right = _grow(lines, tree, weight, features, nodes)
    name = features[int(split[3])]
    nodes[node] = Node(tree, node, weight, name, float(split[5]), left, right)
    return node


def node_table(spark: SparkSession, nodes: Sequence[Node]) -> DataFrame:
    """The nodes as rows, to be kept or to be looked at."""
    rows = [tuple(vars(n).values()) for n in nodes]
    return spark.createDataFrame(
        rows,
        "tree int, node int, weight double, feature string, threshold double, left int, right int, "
        "prediction double",
    )


def tree_sql(nodes: Sequence[Node]) -> list[str]:
    """SQL of each tree's weighted prediction, as nested CASE over the feature columns.

    An unknown value counts as 0, as in training.
    """
    by_tree: dict[int, list[Node]] = {}
    for node in nodes:
        by_tree.setdefault(node.tree, []).append(node)

    def text(some: list[Node], at: int) -> str:
        n = some[at]
        if n.feature is None:
            return f"CAST({n.prediction * n.weight!r} AS DOUBLE)"
        test = f"COALESCE({n.feature}, 0) <= CAST({n.threshold!r} AS DOUBLE)"
        return f"CASE WHEN {test} THEN {text(some, n.left)} ELSE {text(some, n.right)} END"

    return [text(sorted(some, key=lambda n: n.node), 0) for _, some in sorted(by_tree.items())]


def margin_sql(nodes: Sequence[Node]) -> str:
    """SQL of the sum over all trees."""
    return " + ".join(f"({tree})" for tree in tree_sql(nodes)) or "CAST(0 AS DOUBLE)"


def probability_sql(margin: str) -> str:
    """SQL of the probability of fraud from a margin, the logistic of twice of it."""
    return f"CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + exp(CAST(-2 AS DOUBLE) * ({margin})))"


def score_trees(nodes: Sequence[Node], rows: DataFrame) -> DataFrame:
    """Predicted class and probability of fraud per row, with the columns of ``rows``."""
    trees = tree_sql(nodes)
    parts = [trees[k : k + _TREES_AT_A_TIME] for k in range(0, len(trees), _TREES_AT_A_TIME)] or [
        ["CAST(0 AS DOUBLE)"]
    ]
    sums = {f"_part{k}": F.expr(" + ".join(f"({t})" for t in part)) for k, part in enumerate(parts)}
    margin = " + ".join(sums)
    return (
        rows.withColumns(sums)
        .withColumn("probability", F.expr(probability_sql(margin)))
        .withColumn("prediction", F.when(F.expr(margin) > 0, 1).otherwise(0))
        .select(*rows.columns, "prediction", "probability")
    )
