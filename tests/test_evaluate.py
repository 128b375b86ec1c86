import pytest
from pyspark.mllib.evaluation import BinaryClassificationMetrics, MulticlassMetrics
from pyspark.sql import functions as F

from cohortweave.operators import ensemble, evaluate


def pairs(spark, *counted):
    data = [(float(p), float(y)) for p, y, n in counted for _ in range(n)]
    return spark.createDataFrame(data, "prediction double, label double")


CASES = {
    "usual": [(1, 1, 5), (0, 0, 7), (1, 0, 2), (0, 1, 3)],
    "nothing predicted positive": [(0, 0, 4), (0, 1, 2)],
    "all predicted positive": [(1, 0, 4), (1, 1, 2)],
    "no positives": [(0, 0, 4), (1, 0, 2)],
    "no negatives": [(0, 1, 4), (1, 1, 2)],
    "always wrong": [(0, 1, 4), (1, 0, 2)],
    "always right": [(0, 0, 4), (1, 1, 2)],
}


@pytest.mark.parametrize("case", CASES)
def test_areas_agree_with_mllib(spark, case):
    df = pairs(spark, *CASES[case])
    metrics = BinaryClassificationMetrics(df.rdd.map(lambda r: (r[0], r[1])))
    ours = evaluate.binary_statistics(df).first()
    assert ours["auroc"] == pytest.approx(metrics.areaUnderROC)
    assert ours["aupr"] == pytest.approx(metrics.areaUnderPR)


def test_threshold_metrics(spark):
    usual = evaluate.binary_statistics(pairs(spark, *CASES["usual"])).first()
    assert (usual["precision"], usual["recall"]) == pytest.approx((5 / 7, 5 / 8))
    assert usual["accuracy"] == pytest.approx(12 / 17)
    nothing = evaluate.binary_statistics(pairs(spark, *CASES["nothing predicted positive"])).first()
    assert (nothing["precision"], nothing["recall"]) == pytest.approx((1 / 3, 1.0))
    wrong = evaluate.binary_statistics(pairs(spark, *CASES["always wrong"])).first()
    assert (wrong["precision"], wrong["recall"], wrong["f_measure"]) == (0.0, 0.0, None)


def test_other_classes_are_not_counted(spark):
    counts = evaluate.confusion_matrix(pairs(spark, (1, 1, 2), (2, 1, 3), (0, 2, 1))).first()
    assert (counts["tp"], counts["total"]) == (2, 2)


def test_undefined_ratios(spark):
    counts = spark.createDataFrame([(0, 5, 0, 0, 5), (0, 0, 3, 2, 5)], "tp long, tn long, fp long, fn long, total long")
    first, second = evaluate.with_ratio_metrics(counts).collect()
    assert (first["precision"], first["recall"], first["specificity"], first["f_measure"]) == (1.0, 1.0, 1.0, 1.0)
    assert (second["precision"], second["recall"], second["specificity"], second["f_measure"]) == (0.0, 0.0, 0.0, 1.0)
    strict = evaluate.with_ratio_metrics(counts, undefined_as=0.0).collect()
    assert [r["f_measure"] for r in strict] == [0.0, 0.0]


def test_multiclass_agrees_with_mllib(spark):
    df = pairs(spark, (0, 0, 5), (1, 0, 2), (2, 0, 1), (1, 1, 4), (0, 1, 3), (2, 2, 2), (0, 2, 6), (3, 1, 1))
    theirs = MulticlassMetrics(df.rdd.map(lambda r: (r[0], r[1])))
    ours = evaluate.multiclass_statistics(df).first()
    assert ours["accuracy"] == pytest.approx(theirs.accuracy)
    assert ours["precision"] == pytest.approx(theirs.weightedPrecision)
    assert ours["recall"] == pytest.approx(theirs.weightedRecall)
    assert ours["fpr"] == pytest.approx(theirs.weightedFalsePositiveRate)
    assert ours["tpr"] == pytest.approx(theirs.weightedTruePositiveRate)
    assert ours["f_measure"] == pytest.approx(theirs.weightedFMeasure())


COUNTS = "algorithm string, model_site string, site string, tp long, tn long, fp long, fn long, total long"


def test_weights(spark):
    statistics = spark.createDataFrame(
        [
            ("a", "A", "A", 4, 4, 1, 1, 10), ("a", "A", "B", 4, 4, 1, 1, 10),  # F 0.8
            ("a", "B", "B", 2, 4, 2, 2, 10), ("a", "B", "A", 2, 4, 2, 2, 10),  # F 0.5
            ("z", "A", "A", 1, 1, 0, 0, 2), ("z", "B", "B", 0, 0, 2, 2, 4),  # F 1 and undefined
        ],
        COUNTS,
    )
    weights = {(r["algorithm"], r["model_site"]): r["weight"] for r in ensemble.ensemble_weights(statistics).collect()}
    assert weights == {
        ("a", "A"): pytest.approx(0.8 / 1.3), ("a", "B"): pytest.approx(0.5 / 1.3),
        ("z", "A"): pytest.approx(0.5), ("z", "B"): pytest.approx(0.5),
    }
    strict = ensemble.ensemble_weights(statistics, undefined_as=0.0).filter("algorithm = 'z'").collect()
    # A weight of 0 becomes 1/n after the others were normalized.
    assert {r["model_site"]: r["weight"] for r in strict} == {"A": 1.0, "B": 0.5}


PREDICTIONS = (
    "site string, algorithm string, model_site string, pid string, label double, prediction double, "
    "negative double, positive double"
)


@pytest.fixture(scope="module")
def voting(spark):
    def row(model_site, pid, prediction, positive):
        return ("S", "a", model_site, pid, 1.0, prediction, 1 - positive, positive)

    rows = [
        row("A", "p1", 1.0, 0.9), row("B", "p1", 0.0, 0.4), row("C", "p1", 0.0, 0.4),
        row("A", "p2", 1.0, 0.6), row("B", "p2", 1.0, 0.6), row("C", "p2", 0.0, 0.1),
        row("A", "p3", 1.0, 0.5), row("B", "p3", 0.0, 0.5), row("C", "p3", 0.0, 0.5),
        row("A", "p4", 1.0, 0.9), row("B", "p4", 1.0, 0.9),
    ]
    weights = spark.createDataFrame(
        [("a", "A", 0.6, 3), ("a", "B", 0.2, 3), ("a", "C", 0.2, 3)],
        "algorithm string, model_site string, weight double, models long",
    )
    return spark.createDataFrame(rows, PREDICTIONS), weights


def by_pid(df, column="prediction"):
    return {r["pid"]: r[column] for r in df.collect()}


def test_votes(voting):
    # p4 was not scored by every model.
    assert by_pid(ensemble.weighted_vote(*voting)) == {"p1": 1.0, "p2": 1.0, "p3": 1.0}
    assert by_pid(ensemble.majority_vote(*voting)) == {"p1": 0.0, "p2": 1.0, "p3": 0.0}
    assert by_pid(ensemble.majority_vote(*voting), "signed_votes") == {"p1": -1.0, "p2": 1.0, "p3": -1.0}
    assert by_pid(ensemble.weighted_probability(*voting)) == {"p1": 1.0, "p2": 0.0, "p3": 0.0}
    positives = by_pid(ensemble.weighted_probability(*voting), "positive")
    assert positives["p1"] == pytest.approx(0.6 * 0.9 + 0.4 * 0.4)


def test_a_tie_is_negative(voting):
    predictions, weights = voting
    even = weights.withColumn("weight", F.when(F.col("model_site") == "A", 0.5).otherwise(0.25))
    assert by_pid(ensemble.weighted_vote(predictions, even))["p1"] == 0.0


def test_a_single_model_ignores_its_weight(voting):
    predictions, weights = voting
    alone = weights.filter("model_site = 'B'").withColumn("models", F.lit(1).cast("long"))
    votes = ensemble.weighted_vote(predictions.filter("model_site = 'B'"), alone)
    assert by_pid(votes) == {"p1": 0.0, "p2": 1.0, "p3": 0.0, "p4": 1.0}
    assert by_pid(votes, "positive")["p1"] == pytest.approx(0.4)
