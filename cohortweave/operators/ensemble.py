"""Weights of site models and votes of their ensemble, over prediction tables.

A prediction table is long: ``(site, model_site, algorithm, pid, label,
prediction[, negative, positive])``, one row per record and model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortweave.operators.evaluate import combine_statistics
from cohortweave.session import materialize

# Sums of doubles depend on the order of addition, which a distributed sum does
# not fix. Votes are compared with 0 after rounding to this many digits.
VOTE_DIGITS = 9


def ensemble_weights(
    statistics: DataFrame, model: Sequence[str] = ("algorithm", "model_site"), undefined_as: float | None = 1.0
) -> DataFrame:
    """``(model columns, f_measure, weight, models)`` from training and validation counts.

    The weight is the F of the counts summed over all sites, divided by the sum
    over the algorithm's models. A weight that would be 0 or undefined becomes
    1/n after that division, so weights need not add up to 1.
    """
    combined = combine_statistics(statistics, model, undefined_as)
    siblings = Window.partitionBy(model[0])  # the sites' models of one algorithm
    share = F.col("f_measure") / F.when(F.col("_sum") != 0, F.col("_sum"))
    return (
        combined.withColumn("_sum", F.sum("f_measure").over(siblings))
        .withColumn("models", F.count(F.lit(1)).over(siblings))
        .withColumn(
            "weight",
            F.when(F.coalesce(share, F.lit(0.0)) != 0, share).otherwise(1.0 / F.col("models")),
        )
        .drop("_sum")
    )


def _votes(
    predictions: DataFrame,
    weights: DataFrame,
    key: Sequence[str],
    model: Sequence[str],
) -> DataFrame:
    """Sums over the models of an ensemble, for records that every model scored.

    Weights are one row per site and algorithm. They are computed and written once;
    from the size of what was written Spark sees that it can broadcast them.
    """
    ensembles = materialize(weights.select(*model, "weight", "models"))
    sign = F.when(F.col("prediction") == 0.0, F.lit(-1.0)).otherwise(F.lit(1.0))
    # The weight of a single model does not count.
    weight = F.when(F.col("models") == 1, F.lit(1.0)).otherwise(F.col("weight"))
    scored = predictions.join(ensembles, list(model)).withColumn("_w", weight).withColumn("_s", sign)

    def total(value: Column) -> Column:
        return F.round(F.sum(value), VOTE_DIGITS)

    aggregates = [
        total(F.col("_w") * F.col("_s")).alias("weighted_prediction"),
        F.sum("_s").alias("signed_votes"),
        F.count(F.lit(1)).alias("_scored"),
        F.max("models").alias("_models"),
    ]
    if "positive" in predictions.columns:
        aggregates += [
            total(F.col("_w") * F.col("negative")).alias("negative"),
            total(F.col("_w") * F.col("positive")).alias("positive"),
        ]
    voted = scored.groupBy(*key, model[0], "pid", "label").agg(*aggregates)
    return voted.filter(F.col("_scored") == F.col("_models")).drop("_scored", "_models")


def vote_class(votes: Column) -> Column:
    """The class of a weighted sum of votes; a balance, up to the error of the sum, is 0."""
    return _zero_or_one(F.round(votes, VOTE_DIGITS) <= 0)


def _zero_or_one(is_zero: Column) -> Column:
    return F.when(is_zero, F.lit(0.0)).otherwise(F.lit(1.0))


MODEL = ("algorithm", "model_site")


def weighted_vote(
    predictions: DataFrame, weights: DataFrame, key: Sequence[str] = ("site",), model: Sequence[str] = MODEL
) -> DataFrame:
    """Prediction 1 where the weighted votes for 1 outweigh those for 0, else 0."""
    votes = _votes(predictions, weights, key, model).drop("signed_votes")
    return votes.withColumn("prediction", vote_class(F.col("weighted_prediction")))


def weighted_probability(
    predictions: DataFrame, weights: DataFrame, key: Sequence[str] = ("site",), model: Sequence[str] = MODEL
) -> DataFrame:
    """Prediction of the class with the larger weighted probability; a tie is 0."""
    votes = _votes(predictions, weights, key, model).drop("signed_votes", "weighted_prediction")
    return votes.withColumn("prediction", _zero_or_one(F.col("negative") >= F.col("positive")))


def majority_vote(
    predictions: DataFrame, weights: DataFrame, key: Sequence[str] = ("site",), model: Sequence[str] = MODEL
) -> DataFrame:
    """Prediction of the majority of the models; a tie is 0. Weights give only the ensemble."""
    votes = _votes(predictions, weights, key, model)
    return votes.select(
        *key, model[0], "pid", "label", "signed_votes", _zero_or_one(F.col("signed_votes") <= 0).alias("prediction")
    )
