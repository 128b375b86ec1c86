"""Quality of 0/1 predictions, from counts. One aggregation per call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.functions.expressions import ratio
from cohortweave.session import materialize

COUNTS = ("tp", "tn", "fp", "fn", "total")


def confusion_matrix(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, tn, fp, fn and their total per group.

    Pairs of prediction and label outside {0, 1} are in no count.
    """

    def pairs(prediction: int, label: int) -> Column:
        match = (F.col("prediction") == prediction) & (F.col("label") == label)
        return F.count(F.when(match, F.lit(1)))

    counted = predictions.groupBy(*by).agg(
        pairs(1, 1).alias("tp"), pairs(0, 0).alias("tn"), pairs(1, 0).alias("fp"), pairs(0, 1).alias("fn")
    )
    return counted.withColumn("total", F.expr("tp + tn + fp + fn"))


def accuracy() -> Column:
    return ratio(F.col("tp") + F.col("tn"), F.col("total"))


def precision(undefined_as: float | None = 1.0) -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fp"), undefined_as)


def recall(undefined_as: float | None = 1.0) -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fn"), undefined_as)


def specificity(undefined_as: float | None = 1.0) -> Column:
    return ratio(F.col("tn"), F.col("tn") + F.col("fp"), undefined_as)


def f_measure(undefined_as: float | None = 1.0) -> Column:
    """Of precision and recall as they stand, that is with ``undefined_as`` filled in."""
    p, r = precision(undefined_as), recall(undefined_as)
    return ratio(2 * p * r, p + r, undefined_as)


def with_ratio_metrics(counts: DataFrame, undefined_as: float | None = 1.0) -> DataFrame:
    """Add precision, recall, specificity and F to counts.

    ``undefined_as`` stands for 0/0. With 1.0 a model that finds no positive at all
    gets F = 1.0 and so the highest weight; 0.0 avoids that.
    """
    return counts.withColumns(
        {
            "precision": precision(undefined_as),
            "recall": recall(undefined_as),
            "specificity": specificity(undefined_as),
            "f_measure": f_measure(undefined_as),
        }
    )


def _positives() -> Column:
    return F.col("tp") + F.col("fn")


def _negatives() -> Column:
    return F.col("tn") + F.col("fp")


def _predicted() -> Column:
    return F.col("tp") + F.col("fp")


def with_threshold_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall and F at the highest score that occurs.

    Scores are the predictions themselves. If nothing is predicted positive the
    only score is 0, at which everything is: precision is then the prevalence and
    recall 1. F is null where precision and recall are both 0.
    """
    nothing = _predicted() == 0
    p = F.when(nothing, ratio(_positives(), F.col("total"))).otherwise(ratio(F.col("tp"), _predicted()))
    r = F.when(_positives() == 0, F.lit(0.0)).when(nothing, F.lit(1.0)).otherwise(ratio(F.col("tp"), _positives()))
    return counts.withColumns({"precision": p, "recall": r, "f_measure": ratio(2 * p * r, p + r)})


def auroc() -> Column:
    """Area under ROC of 0/1 predictions: two trapezoids over one inner point."""
    tpr, fpr = ratio(F.col("tp"), _positives()), ratio(F.col("fp"), _negatives())
    return (
        F.when(F.col("total") == 0, F.lit(None).cast("double"))
        .when(_positives() == 0, F.lit(0.0))
        .when(_negatives() == 0, F.lit(1.0))
        .otherwise((1 + tpr - fpr) / 2)
    )


def aupr() -> Column:
    """Area under precision-recall of 0/1 predictions, starting at the first precision."""
    prevalence = ratio(_positives(), F.col("total"))
    tpr, p = ratio(F.col("tp"), _positives()), ratio(F.col("tp"), _predicted())
    return (
        F.when(F.col("total") == 0, F.lit(None).cast("double"))
        .when(_positives() == 0, F.lit(0.0))
        .when(_predicted() == 0, prevalence)
        .otherwise(tpr * p + (1 - tpr) * (p + prevalence) / 2)
    )


def score_curve(scored: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """``(by, threshold, tp, fp, positives, negatives, tp_before, fp_before)``, one row per distinct score.

    ``tp`` and ``fp`` count the rows with at least that score, ``_before`` those above it; rows without a
    score or with a label other than 0 and 1 are left out. Running counts are prefix sums over ranges of
    the scores: counts within a range, and the totals of the ranges before it, of which there are as many
    as partitions. So no task holds all scores of a group.
    """
    known = scored.filter(F.col(score).isNotNull() & F.col(label).isin(0, 1))
    counted = known.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("p"), F.count(F.when(F.col(label) == 0, 1)).alias("n")
    )
    ranges = counted.repartitionByRange(*by, F.col("threshold").desc()).withColumn("part", F.spark_partition_id())
    ranges = materialize(ranges)
    totals = ranges.groupBy(*by, "part").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_p", "_n")],
        F.sum("_p").over(whole).alias("positives"), F.sum("_n").over(whole).alias("negatives"),
    )
    within = Window.partitionBy(*by, "part").orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    running = ranges.withColumns({"_rp": F.sum("p").over(within), "_rn": F.sum("n").over(within)})
    joined = running.join(offsets, [*by, "part"])
    tp, fp = F.col("_p_before") + F.col("_rp"), F.col("_n_before") + F.col("_rn")
    return joined.select(
        *by, "threshold", tp.alias("tp"), fp.alias("fp"), "positives", "negatives",
        (tp - F.col("p")).alias("tp_before"), (fp - F.col("n")).alias("fp_before"),
    )


def curve_areas(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, points, auroc, aupr)`` of :func:`score_curve`: trapezoids between neighbouring scores.

    The precision-recall curve starts at the precision of the highest score. A group without positives
    has 0.0 for both areas, one without negatives an ROC area of 1.0, as for 0/1 predictions.
    """
    tpr = ratio(F.col("tp") + F.col("tp_before"), 2 * F.col("positives"), 0.0)
    step = ratio(F.col("fp") - F.col("fp_before"), F.col("negatives"), 0.0)
    now = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.coalesce(F.try_divide("tp_before", F.col("tp_before") + F.col("fp_before")), now)
    gained = ratio(F.col("tp") - F.col("tp_before"), F.col("positives"), 0.0)
    areas = curve.groupBy(*by).agg(
        F.count(F.lit(1)).alias("points"), F.sum(step * tpr).alias("_roc"), F.sum(gained * (now + before) / 2).alias("aupr"),
        F.max("positives").alias("_p"), F.max("negatives").alias("_n"),
    )
    roc = F.when(F.col("_p") == 0, 0.0).when(F.col("_n") == 0, 1.0).otherwise(F.col("_roc"))
    return areas.select(*by, "points", roc.alias("auroc"), "aupr")


def binary_statistics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, accuracy, precision, recall, F, areas under ROC and PR per group."""
    return counted_statistics(confusion_matrix(predictions, by))


def added_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The confusion matrix per group of rows ``(by, tp, tn, fp, fn)``, of which a group may have several."""
    summed = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS[:-1]])
    return summed.withColumn("total", F.expr("tp + tn + fp + fn"))


def counted_statistics(counts: DataFrame) -> DataFrame:
    """As :func:`binary_statistics`, from confusion matrices."""
    with_areas = counts.withColumns({"accuracy": accuracy(), "auroc": auroc(), "aupr": aupr()})
    return with_threshold_metrics(with_areas)


def combine_statistics(statistics: DataFrame, by: Sequence[str], undefined_as: float | None = 1.0) -> DataFrame:
    """Sum the counts of several sites and derive the metrics again."""
    summed = statistics.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS])
    return with_ratio_metrics(summed.withColumn("accuracy", accuracy()), undefined_as)


def multiclass_statistics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and class-weighted precision, recall, FPR, TPR and F for any number of classes.

    Pairs are counted first; the rest works on one row per pair of classes.
    """
    pairs = predictions.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    # Every pair counts once for its label and once for its prediction.
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("labelled"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("labelled"), F.col("n").alias("predicted")),
    )
    right = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    classes = (
        pairs.select(*by, right.alias("right"), F.explode(sides).alias("s"))
        .select(*by, "right", "s.*")
        .groupBy(*by, "class")
        .agg(
            F.sum("labelled").alias("labelled"),
            F.sum("predicted").alias("predicted"),
            # A right pair has both its sides in the same class.
            (F.sum("right") / 2).alias("right"),
        )
    )
    totals = pairs.groupBy(*by).agg(F.sum("n").alias("total"))
    if by:
        joined = classes.join(totals, list(by))
    else:
        joined = classes.withColumn("total", F.lit(totals.first()["total"]))
    p = ratio(F.col("right"), F.col("predicted"), 0.0)
    r = ratio(F.col("right"), F.col("labelled"), 0.0)
    false_rate = ratio(F.col("predicted") - F.col("right"), F.col("total") - F.col("labelled"), 0.0)
    f = ratio(2 * p * r, p + r, 0.0)
    weight = F.col("labelled") / F.col("total")
    return joined.groupBy(*by).agg(
        (F.sum("right") / F.max("total")).alias("accuracy"),
        F.sum(weight * p).alias("precision"),
        F.sum(weight * r).alias("recall"),
        F.sum(weight * false_rate).alias("fpr"),
        F.sum(weight * r).alias("tpr"),
        F.sum(weight * f).alias("f_measure"),
    )
