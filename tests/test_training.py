"""Invariants of fitted models, on separable rows of three sites."""

import pytest
from pyspark.sql import functions as F

from cohortweave.operators import training as T
from cohortweave.operators.ensemble import vote_class
from cohortweave.operators.evaluate import binary_statistics
from cohortweave.operators.federation import error_rollup
from cohortweave.plans import prediction as P
from cohortweave.spec import CATEGORICAL, DEPENDENT, Featureset, SpecError, Variable
from cohortweave.streaming.scoring import score_stream

FEATURES = Featureset(
    (
        Variable("kind", "/Patient", "value:kind", CATEGORICAL),
        Variable("size", "/Patient", "value:size"),
        Variable("noise", "/Patient", "value:noise"),
        Variable("ill", "/Patient", "value:ill", role=DEPENDENT),
    )
)
SMALL = {
    T.LOGISTIC_REGRESSION: {"max_iter": 20, "reg_param": "0.001,0.1"},
    T.DECISION_TREE: {"max_depth": 3},
    T.RANDOM_FOREST: {"num_trees": 5, "max_depth": 3},
    T.GBT: {"max_iter": 3, "max_depth": 3},
    T.SVM: {"max_iter": 20, "reg_param": 0.01},
    T.NAIVE_BAYES: {},
}


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    """600 rows; ill goes with size, and some sizes and kinds are missing."""
    n = F.col("id")
    size = (F.abs(F.hash(n, F.lit(1))) % 100).cast("double")
    rows = spark.range(600).select(
        F.concat(F.lit("Patient/"), n).alias("pid"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (n % 3 + 1).cast("int")).alias("site"),
        F.when(n % 10 != 0, F.element_at(F.array(F.lit("x"), F.lit("y")), (n % 2 + 1).cast("int"))).alias("kind"),
        F.when(n % 13 != 0, size).alias("size"),
        (F.abs(F.hash(n, F.lit(2))) % 50).cast("double").alias("noise"),
        F.when(size > 60, 1.0).otherwise(0.0).alias("ill"),
    )
    path = str(tmp_path_factory.mktemp("data") / "by_site")
    rows.write.partitionBy("site").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(dataset):
    found = T.label_order(dataset, FEATURES)
    assert found == [0.0, 1.0]
    return found


@pytest.mark.parametrize("name", SMALL)
def test_every_classifier(dataset, labels, name):
    algorithm = T.Algorithm(name, {**SMALL[name], "num_folds": 2})
    labelled = T.with_label(dataset, FEATURES, labels, algorithm)
    model = T.train(T.training_split(labelled), FEATURES, [algorithm])[0]
    scored = T.add_prediction(T.test_split(labelled), model, "m")
    assert scored.columns == [*labelled.columns, "m"]
    bad = scored.filter("abs(m.negative + m.positive - 1) > 1e-9 or m.prediction not in (0.0, 1.0)")
    assert bad.count() == 0
    statistics = binary_statistics(scored.select("label", "m.prediction")).first()
    assert statistics["total"] == labelled.count() - T.training_split(labelled).count()
    assert statistics["auroc"] > 0.8


def test_grid_and_parameters():
    algorithm = T.Algorithm(T.RANDOM_FOREST, {"max_depth": "3, 5", "impurity": "gini,entropy", "num_trees": 7})
    estimator = algorithm.estimator()
    assert estimator.getOrDefault("numTrees") == 50
    points = [{p.name: v for p, v in point.items()} for point in algorithm.grid(estimator)]
    assert len(points) == 4
    assert points[0] == {"maxDepth": 3, "impurity": "gini", "numTrees": 7}
    assert T.Algorithm(T.SVM).grid(T.Algorithm(T.SVM).estimator()) == [{}]
    with pytest.raises(SpecError):
        T.Algorithm("regression_linear")
    with pytest.raises(SpecError):
        T.Algorithm(T.SVM, {"max_depth": 3})


def test_cross_validation_prefers_the_deeper_tree(dataset, labels):
    algorithm = T.Algorithm(T.DECISION_TREE, {"max_depth": "0,3", "num_folds": 3})
    labelled = T.with_label(dataset, FEATURES, labels, algorithm)
    metrics = T.cross_validate(labelled, FEATURES, [algorithm])[0]
    assert metrics[0][0]["maxDepth"] == 0
    assert metrics[0][1] == pytest.approx(0.5)
    assert metrics[1][1] > 0.9
    assert T.train(labelled, FEATURES, [algorithm])[0].stages[-1].depth == 3


def test_algorithms_trained_together_equal_those_trained_alone(dataset, labels):
    algorithms = [
        T.Algorithm(T.DECISION_TREE, {"max_depth": "1,3"}),
        T.Algorithm(T.LOGISTIC_REGRESSION, {"max_iter": 5, "reg_param": "0.001,0.5"}),
        T.Algorithm(T.NAIVE_BAYES),
    ]
    labelled = T.with_label(dataset, FEATURES, labels, algorithms[0])
    together = T.train(labelled, FEATURES, algorithms)
    for algorithm, model in zip(algorithms, together, strict=True):
        alone = T.train(labelled, FEATURES, [algorithm])[0]
        both = T.add_prediction(T.add_prediction(labelled, model, "a"), alone, "b")
        assert both.filter("abs(a.positive - b.positive) > 1e-6").count() == 0
    other = T.Algorithm(T.SVM, {"handle_invalid": "skip"})
    with pytest.raises(SpecError):
        T.cross_validate(labelled, FEATURES, [algorithms[0], other])


def test_one_failing_algorithm_does_not_stop_the_others(dataset, labels):
    broken = T.Algorithm(T.DECISION_TREE, {"max_depth": 99})
    sound = T.Algorithm(T.NAIVE_BAYES)
    models = P.train_per_site(dataset, FEATURES, [broken, sound], ["A"], labels)
    assert [(m.algorithm.name, m.model is None) for m in models] == [(T.DECISION_TREE, True), (T.NAIVE_BAYES, False)]
    assert models[0].error.startswith("A: ")


def test_skip_drops_rows_and_keep_does_not(dataset, labels):
    skip = T.Algorithm(T.DECISION_TREE, {"handle_invalid": "skip"})
    keep = T.Algorithm(T.DECISION_TREE)
    complete = dataset.na.drop(subset=["kind", "size"]).count()
    assert T.with_label(dataset, FEATURES, labels, skip).count() == complete < 600
    assert T.with_label(dataset, FEATURES, labels, keep).count() == 600
    model = T.train(T.with_label(dataset, FEATURES, labels, skip), FEATURES, [skip])[0]
    assert [type(s).__name__ for s in model.stages][0] == "StringIndexerModel"


def test_stored_model_predicts_the_same(dataset, labels, tmp_path):
    algorithm = T.Algorithm(T.LOGISTIC_REGRESSION, {"max_iter": 5})
    labelled = T.with_label(dataset, FEATURES, labels, algorithm)
    model = T.train(labelled, FEATURES, [algorithm])[0]
    T.save_model(model, str(tmp_path / "model"))
    both = T.add_prediction(T.add_prediction(labelled, model, "a"), T.load_model(str(tmp_path / "model")), "b")
    assert both.filter("a.prediction <> b.prediction or a.positive <> b.positive").count() == 0


@pytest.fixture(scope="module")
def run(dataset, labels):
    algorithms = [
        T.Algorithm(T.LOGISTIC_REGRESSION, {"max_iter": 20, "reg_param": 0.001}),
        T.Algorithm(T.DECISION_TREE, {"max_depth": 3}),
    ]
    models = P.train_per_site(dataset, FEATURES, algorithms, ["A", "B", "C"], labels)
    assert all(m.error is None for m in models)
    labelled = T.with_label(dataset, FEATURES, labels, algorithms[0])
    return models, labelled


def test_every_model_is_validated_at_every_other_site(run):
    models, labelled = run
    statistics = P.site_statistics(models, T.training_split(labelled)).collect()
    assert len(statistics) == 2 * 3 * 3
    assert {(r["model_site"] == r["site"]) == (r["step"] == "train") for r in statistics} == {True}
    totals = dict(T.training_split(labelled).groupBy("site").count().collect())
    assert all(r["total"] == totals[r["site"]] for r in statistics)


def test_ensembles(run):
    models, labelled = run
    statistics = P.site_statistics(models, T.training_split(labelled))
    ensembles = P.build_ensembles(models, statistics)
    assert {name: len(e.members) for name, e in ensembles.items()} == {T.LOGISTIC_REGRESSION: 3, T.DECISION_TREE: 3}
    for e in ensembles.values():
        assert sum(weight for weight, _ in e.members) == pytest.approx(1)
    held_out = T.test_split(labelled)
    tested = P.combined_test_statistics(P.test_ensembles(ensembles, held_out)).collect()
    assert all(r["total"] == held_out.count() and r["accuracy"] > 0.9 for r in tested)


def test_scoring_a_stream_equals_scoring_a_table(spark, run, tmp_path):
    models, labelled = run
    statistics = P.site_statistics(models, T.training_split(labelled))
    ensemble = P.build_ensembles(models, statistics)[T.DECISION_TREE]
    # New records have no label; one misses a value.
    records = labelled.drop("label", "ill").withColumn("noise", F.when(F.col("noise") > 1, F.col("noise")))
    records.write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "in"))
    query = score_stream(ensemble, stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    expected = ensemble.score(stored)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 600
    assert got.exceptAll(expected).count() == 0
    plan = expected._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_site_with_one_class_is_reported(dataset, labels):
    one_class = dataset.filter("site <> 'B' or ill = 0")
    algorithm = T.Algorithm(T.DECISION_TREE, {"max_depth": 2})
    models = P.train_per_site(one_class, FEATURES, [algorithm], ["A", "B"], labels)
    assert [m.error for m in models] == [None, "B: only one class to train on"]
    labelled = T.with_label(one_class, FEATURES, labels, algorithm)
    statistics = P.site_statistics(models, T.training_split(labelled))
    assert {r["model_site"] for r in statistics.collect()} == {"A"}
    with pytest.raises(P.TrainingError, match="B: only one class"):
        P.build_ensembles(models, statistics)
    assert len(P.build_ensembles(models, statistics, without_failed=True)[T.DECISION_TREE].members) == 1
    results = P.training_results(dataset.sparkSession, models, "m1")
    rolled = error_rollup(results).collect()
    assert [(r["model_id"], r["error_message"]) for r in rolled] == [("m1", "B: only one class to train on")]
    with pytest.raises(P.TrainingError, match="B: only"):
        P.model_predictions([m for m in models if m.model is None], labelled)


def test_nothing_stays_cached_after_a_failed_fit(spark, dataset, labels):
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    broken = T.Algorithm(T.DECISION_TREE, {"max_depth": "99,98"})
    P.train_per_site(dataset, FEATURES, [broken], ["A"], labels)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_a_null_label_is_filled_by_the_training_rows(dataset, labels):
    algorithm = T.Algorithm(T.DECISION_TREE)
    training = F.col("pid").isin([r["pid"] for r in T.training_split(dataset).select("pid").collect()])
    # Held-out rows say otherwise than the training rows.
    changed = dataset.withColumn("ill", F.when(~training, 1.0).when(F.col("noise") > 5, 0.0))
    labelled = T.with_label(changed, FEATURES, labels, algorithm)
    assert labelled.filter("ill is null and label <> 0").count() == 0
    assert labelled.count() == 600
    error = T.Algorithm(T.DECISION_TREE, {"handle_invalid": "error"})
    with pytest.raises(Exception, match="holds a null"):
        T.with_label(changed, FEATURES, labels, error).count()


def test_balanced_votes_are_the_negative_class(spark, run):
    """Weights 0.1, 0.2 and 0.3 with votes +, +, -: 0.1 + 0.2 - 0.3 is not quite 0 in doubles."""
    votes = spark.createDataFrame([(0.1 + 0.2 - 0.3,), (0.1,), (-0.1,)], "v double")
    assert [r[0] for r in votes.select(vote_class(F.col("v"))).collect()] == [0.0, 1.0, 0.0]


def test_trees_pass_over_distinct_rows(spark):
    """Equal rows are one with a weight; the split of a value is that of what stands for it."""
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(60_000).select(
        array_to_vector(F.array((F.col("id") % 1000).cast("double"), (F.col("id") % 3).cast("double"))).alias("features"),
        F.when(F.col("id") % 1000 > 612, 1.0).otherwise(0.0).alias("label"),
    )
    equal = T.gathered(rows, 32)
    assert equal.count() <= 32 * 3 * 2 and equal.agg(F.sum("weight")).first()[0] == 60_000
    assert T.gathered(rows.limit(0), 32).count() == 0
    model = T.fit_points(T.GBTClassifier(maxIter=5), rows, [{}])[0]
    right = model.transform(rows).filter(F.col("prediction") == F.col("label")).count()
    assert right > 0.97 * 60_000


def test_rows_of_a_site_are_read_once_and_linear_fits_take_few_tasks(spark, dataset, labels, monkeypatch):
    seen = []

    def train(training, featureset, algorithms, fit=T.train):
        seen.append((training.is_cached, training.columns))
        return fit(training, featureset, algorithms)

    monkeypatch.setattr(T, "train", train)
    algorithm = T.Algorithm(T.LOGISTIC_REGRESSION, {**SMALL[T.LOGISTIC_REGRESSION], "num_folds": 2})
    models = P.train_per_site(dataset, FEATURES, [algorithm], ["A", "B"], labels)
    assert [m.error for m in models] == [None, None]
    assert seen == [(True, ["pid", "kind", "size", "noise", "label"])] * 2
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
    rows = spark.range(0, 150_000, 1, 8)
    assert T.in_few_tasks(rows, T.LogisticRegression()).rdd.getNumPartitions() == 1
    assert T.in_few_tasks(rows, T.GBTClassifier()).rdd.getNumPartitions() == 3


def test_own_statistics_score_each_row_by_one_model(run):
    models, labelled = run[0], T.training_split(run[1])
    of = {m.site: m for m in models if m.algorithm.name == models[0].algorithm.name}
    own = P.model_predictions([*of.values()], labelled, own=True)
    assert own.select("pid").distinct().count() == own.count() == labelled.count()
    both = [P.site_statistics([*of.values()], labelled, own).filter("step = 'train'") for own in (True, False)]
    assert both[0].count() == len(of) and both[0].exceptAll(both[1]).count() == both[1].exceptAll(both[0]).count() == 0


def test_a_fit_reads_its_rows_once(dataset, labels, monkeypatch):
    algorithm = T.Algorithm(T.RANDOM_FOREST, SMALL[T.RANDOM_FOREST])
    seen = []

    def prepared(features, rows, made=T._prepared):
        seen.append((rows.is_cached, rows.columns))
        return made(features, rows)

    monkeypatch.setattr(T, "_prepared", prepared)
    labelled = T.with_label(dataset, FEATURES, labels, algorithm)
    T.train(T.training_split(labelled), FEATURES, [algorithm])
    assert seen == [(True, ["pid", "kind", "size", "noise", "label"])]
