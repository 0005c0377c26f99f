"""Quality of decisions and scores against the label, from counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.signals import RISK_WEIGHTS, cuts_reached
from .scoring import open_tallies, sum_tallies
from .skew import HOT_SHARE

# The thresholds that are swept.
SCORE_THRESHOLDS = tuple(range(35, 98, 5))
PROBABILITY_THRESHOLDS = tuple(i / 100 for i in range(10, 91, 5))

# Cells that the distinct scores are dealt into, a square number.
SCORE_CELLS = 1_024


def confusion_counts(df: DataFrame, label: str = "is_fraud", prediction: str = "prediction") -> DataFrame:
    """Rows per label and prediction: all that the two reports below need."""
    return (
        df.where(F.col(label).isNotNull())
        .groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def decision_counts(tallies: DataFrame, flagged: Sequence[str] = ("BLOCK", "REVIEW")) -> DataFrame:
    """The same counts from tallied decisions; ``flagged`` ones predict fraud."""
    predicted = F.col("decision").isin(*flagged).cast("int")
    sides = F.array(
        F.struct(F.lit(1).alias("label"), F.col("fraud").alias("n")),
        F.struct(F.lit(0).alias("label"), F.col("legit").alias("n")),
    )
    return (
        tallies.select(predicted.alias("prediction"), F.explode(sides).alias("s"))
        .groupBy("s.label", "prediction")
        .agg(F.sum("s.n").alias("n"))
    )


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """True and false negatives and positives, one row."""
    return counts.agg(
        _cell(0, 0).alias("true_negatives"),
        _cell(0, 1).alias("false_positives"),
        _cell(1, 0).alias("false_negatives"),
        _cell(1, 1).alias("true_positives"),
    )


def classification_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and both averages."""
    m = confusion_matrix(counts).select(
        F.col("true_negatives").alias("tn"),
        F.col("false_positives").alias("fp"),
        F.col("false_negatives").alias("fn"),
        F.col("true_positives").alias("tp"),
    )
    m = (
        m.withColumn("n0", F.col("tn") + F.col("fp"))
        .withColumn("n1", F.col("tp") + F.col("fn"))
        .withColumn("n", F.col("n0") + F.col("n1"))
        .withColumn("p0", _share("tn", F.col("tn") + F.col("fn")))
        .withColumn("p1", _share("tp", F.col("tp") + F.col("fp")))
        .withColumn("r0", _share("tn", F.col("n0")))
        .withColumn("r1", _share("tp", F.col("n1")))
        .withColumn("f0", _f1("p0", "r0"))
        .withColumn("f1", _f1("p1", "r1"))
        .withColumn("acc", _share("tn", F.col("n")) + _share("tp", F.col("n")))
    )

    def averaged(name: str) -> Column:
        return (F.col(f"{name}0") + F.col(f"{name}1")) / F.lit(2.0).cast("double")

    def weighted(name: str) -> Column:
        total = F.col(f"{name}0") * F.col("n0") + F.col(f"{name}1") * F.col("n1")
        return F.when(F.col("n") > 0, total / F.col("n").cast("double")).otherwise(0.0)

    def row(order: int, name: str, p: Column, r: Column, f: Column, support: Column) -> Column:
        rounded = [F.round(c, 6).alias(a) for c, a in ((p, "precision"), (r, "recall"), (f, "f1_score"))]
        return F.struct(
            F.lit(order).alias("_order"), F.lit(name).alias("class"), *rounded, support.alias("support")
        )

    none = F.lit(None).cast("double")
    rows = F.array(
        row(0, "0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("n0")),
        row(1, "1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("n1")),
        row(2, "accuracy", none, none, F.col("acc"), F.col("n")),
        row(3, "macro avg", averaged("p"), averaged("r"), averaged("f"), F.col("n")),
        row(4, "weighted avg", weighted("p"), weighted("r"), weighted("f"), F.col("n")),
    )
    return m.select(F.inline(rows)).orderBy("_order").drop("_order")


def ranking_metrics(
    df: DataFrame, score: str, label: str = "is_fraud", cells: int = SCORE_CELLS
) -> DataFrame:
    """Area under the ROC curve and average precision, exact, one row.

    Both need only the labels per distinct score, in order of the score. Those counts are
    cumulated in two steps: over cells, then over the scores in a cell. A sketch of the distinct
    scores puts about as many of them into each of ``cells`` cells, wherever the scores crowd.
    It reads the counts, so the scored rows are evaluated once.
    """
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = known.groupBy(F.col(score).alias("score")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
        F.count(F.when(F.col(label) != 1, 1)).alias("neg"),
    )
    points = _with_cell(counts, F.col("score").cast("double"), math.isqrt(max(4, cells)))
    descending = Window.partitionBy(F.lit(1)).orderBy(F.desc("cell"))
    above = descending.rowsBetween(Window.unboundedPreceding, -1)
    whole = descending.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = points.groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    offsets = cells.select(
        "cell",
        F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("pos_above"),
        F.coalesce(F.sum("neg").over(above), F.lit(0)).alias("neg_above"),
        F.sum("pos").over(whole).alias("all_pos"),
        F.sum("neg").over(whole).alias("all_neg"),
    )
    within = Window.partitionBy("cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        points.select(
            "cell",
            "pos",
            "neg",
            F.sum("pos").over(within).alias("pos_in"),
            F.sum("neg").over(within).alias("neg_in"),
        )
        # Every cell matches. A left join adds no null filter, so both sides share the counts.
        .join(offsets, "cell", "left")
        .withColumn("tp", (F.col("pos_above") + F.col("pos_in")).cast("double"))
        .withColumn("fp", (F.col("neg_above") + F.col("neg_in")).cast("double"))
    )
    beaten = F.col("all_neg") - F.col("fp") + F.col("neg") / F.lit(2.0).cast("double")
    return ranked.agg(
        F.max("all_pos").alias("positives"),
        F.max("all_neg").alias("negatives"),
        F.sum(F.col("pos") * beaten).alias("_pairs"),
        F.sum(F.col("pos") * F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0.0))).alias("_steps"),
    ).select(
        "positives",
        "negatives",
        F.round(
            F.col("_pairs")
            / F.nullif(F.col("positives").cast("double") * F.col("negatives"), F.lit(0.0).cast("double")),
            6,
        ).alias("auc_roc"),
        F.round(F.col("_steps") / F.nullif(F.col("positives"), F.lit(0)).cast("double"), 6).alias("auc_pr"),
    )


def _with_cell(counts: DataFrame, value: Column, step: int) -> DataFrame:
    """Counts with the cell of their score: how many cuts lie below it, looked up in two steps."""
    cuts = step * step
    steps = [k / cuts for k in range(1, cuts)]
    # All columns take part, so that the sketch shares the shuffle of the counts.
    sketched = F.when(F.col("pos") + F.col("neg") > 0, value)
    cut = counts.agg(F.percentile_approx(sketched, steps, 100 * cuts).alias("fine"))
    every = F.sequence(F.lit(1), F.lit(step - 1))
    coarse_cuts = F.transform(every, lambda k: F.get("fine", k * step - 1))
    found = cut.select(F.struct("fine", coarse_cuts.alias("coarse"))).scalar()
    coarse = F.size(F.filter("_cut.coarse", lambda c: c < value))
    fine = F.slice("_cut.fine", F.col("_coarse") * step + 1, F.lit(step - 1))
    return (
        counts.withColumn("_cut", found)
        .withColumn("_coarse", coarse)
        .withColumn("cell", F.col("_coarse") * step + F.size(F.filter(fine, lambda c: c < value)))
        .drop("_cut", "_coarse")
    )


def threshold_sweep_score(
    df: DataFrame,
    thresholds: Sequence[int] = SCORE_THRESHOLDS,
    weights=RISK_WEIGHTS,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Precision and recall of flagging every row whose risk score reaches a threshold."""
    levels = sum_tallies(open_tallies(df, weights, thresholds, hot_share=hot_share), "level")
    return _sweep(levels.select("level", "total", "fraud", "legit"), thresholds, "int")


def threshold_sweep(
    scored: DataFrame,
    score: str,
    label: str = "is_fraud",
    thresholds: Sequence[float] = PROBABILITY_THRESHOLDS,
) -> DataFrame:
    """The same over any scored rows, such as a model's probabilities."""
    levels = scored.groupBy(cuts_reached(F.col(score), thresholds).alias("level")).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(label).alias("fraud"),
        F.count(F.when(F.col(label) == 0, 1)).alias("legit"),
    )
    return _sweep(levels, thresholds, "double")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row with the highest F1, the lowest threshold among equals."""
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def _sweep(levels: DataFrame, thresholds: Sequence[float], kind: str) -> DataFrame:
    """One row per threshold from at most ``len(thresholds)`` + 1 level counts."""
    if list(thresholds) != sorted(set(thresholds)):
        raise ValueError("thresholds must ascend")

    def upto(name: str, index: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("level") > index, F.col(name))), F.lit(0)).alias(name)

    points = [
        F.struct(
            F.lit(t).cast(kind).alias("threshold"), upto("total", i), upto("fraud", i), upto("legit", i)
        )
        for i, t in enumerate(thresholds)
    ]
    rows = levels.agg(F.sum("fraud").alias("all_fraud"), F.array(*points).alias("points")).select(
        "all_fraud", F.inline("points")
    )
    # The false positive rate is the share of flagged rows that are legitimate, in percent.
    return (
        rows.where("total > 0")
        .withColumn("precision", _share("fraud", F.col("fraud") + F.col("legit")))
        .withColumn("recall", _share("fraud", F.col("all_fraud")))
        .select(
            "threshold",
            "precision",
            "recall",
            _f1("precision", "recall").alias("f1"),
            (_share("legit", F.col("total")) * 100).alias("fp_rate"),
            F.col("fraud").alias("caught"),
            (F.col("all_fraud") - F.col("fraud")).alias("missed"),
        )
        .orderBy("threshold")
    )


def _cell(label: int, prediction: int) -> Column:
    hit = (F.col("label") == label) & (F.col("prediction") == prediction)
    return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))


def _share(num: str, den: Column) -> Column:
    """Ratio as a double, 0 where nothing is counted."""
    return F.when(den > 0, F.col(num).cast("double") / den.cast("double")).otherwise(0.0)


def _f1(precision: str, recall: str) -> Column:
    p, r = F.col(precision), F.col(recall)
    return F.when(p + r > 0, F.lit(2.0).cast("double") * p * r / (p + r)).otherwise(0.0)
