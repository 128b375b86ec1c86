"""One-plan fits and models as rows against MLlib."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortweave.operators import evaluate as E
from cohortweave.operators import site_models as S
from cohortweave.operators import training as T
from cohortweave.session import materialize
from cohortweave.spec import CATEGORICAL, DEPENDENT, Featureset, Variable

FEATURES = Featureset(
    (
        Variable("site", "/Patient", "value:site", CATEGORICAL, role="site"),
        Variable("color", "/Patient", "value:color", CATEGORICAL),
        Variable("age", "/Patient", "value:age"),
        Variable("weight", "/Patient", "value:weight"),
        Variable("flat", "/Patient", "value:flat"),
        Variable("y", "/Patient", "value:y", role=DEPENDENT),
    )
)


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    out = []
    for i in range(600):
        site = "AB"[i % 2]
        color = rnd.choice(["red", "green", "blue", None] if site == "A" else ["red", "pink"])
        age, weight = rnd.gauss(50, 20), rnd.gauss(0, 1) if rnd.random() < 0.9 else None
        y = float(age / 25 + (weight or 0) + (color == "red") + rnd.gauss(0, 1.5) > 2.6)
        out.append((f"p{i}", site, color, age, weight, 7.0, y))
    df = spark.createDataFrame(out, "pid string, site string, color string, age double, weight double, flat double, y double")
    return materialize(df.withColumn("label", F.col("y")))


def of_site(df, site):
    return df.filter(F.col("site") == site)


def as_vectors(featured, site):
    return of_site(featured, site).select(array_to_vector("features").alias("features"), "label").coalesce(1).cache()


@pytest.fixture(scope="module")
def stages(rows):
    """MLlib's feature stages, one pipeline per site."""
    fitted = {}
    for site in "AB":
        own = of_site(rows, site)
        fitted[site] = Pipeline(stages=T.feature_stages(FEATURES, T.Algorithm(T.DECISION_TREE))).fit(own)
    return fitted


@pytest.fixture(scope="module")
def whole(rows):
    sets = S.training_sets(rows)
    fitted = materialize(S.fit_features(sets, FEATURES))
    return sets, fitted


@pytest.fixture(scope="module")
def featured(whole):
    sets, fitted = whole
    vector = S.feature_vector(FEATURES).alias("features")
    return materialize(sets.join(fitted, ["site", "set"]).select("site", "pid", "set", "validating", vector, "label"))


def test_features_are_those_of_the_pipelines(rows, stages, whole):
    for site in "AB":  # also of rows of the other site, with values unseen at this one
        theirs = stages[site].transform(rows).select("pid", vector_to_array("features").alias("f")).collect()
        fitted = whole[1].filter(F.col("site") == site).drop("site")
        ours = rows.join(fitted.hint("broadcast")).select("pid", S.feature_vector(FEATURES).alias("f")).collect()
        ours = {r.pid: r.f for r in ours}
        assert len(ours) == len(theirs) == 600
        for r in theirs:
            assert np.allclose(ours[r.pid], r.f, atol=1e-12), site


@pytest.mark.parametrize("policy", ["keep", "skip", "error"])
def test_features_under_each_policy(spark, policy):
    data = [("A", "r", 1.0, 2.0, 7.0), ("A", "s", 3.0, 5.0, 7.0), ("A", "t", 2.0, 4.0, 7.0)]
    df = spark.createDataFrame(data, "site string, color string, age double, weight double, flat double")
    sets = df.withColumns({"set": F.lit(S.WHOLE), "validating": F.lit(False)})
    fitted = S.fit_features(sets, FEATURES, policy)
    stages = Pipeline(stages=T.feature_stages(FEATURES, T.Algorithm(T.DECISION_TREE, {"handle_invalid": policy}))).fit(df)
    theirs = sorted(map(tuple, [r[0] for r in stages.transform(df).select(vector_to_array("features")).collect()]))
    ours = df.join(fitted, "site").select(S.feature_vector(FEATURES, policy)).collect()
    assert sorted(tuple(r[0]) for r in ours) == theirs
    new = spark.createDataFrame([("A", "new", 1.0, 2.0, 7.0)], df.schema).join(fitted, "site")
    if policy == "error":
        with pytest.raises(Exception, match="unseen category"):
            new.select(S.feature_vector(FEATURES, policy)).collect()
    else:
        assert (new.select(S.feature_vector(FEATURES, policy)).first()[0] is None) == (policy == "skip")


POINTS = [S.Point(0.0, 0.0), S.Point(0.05, 0.0), S.Point(0.02, 1.0), S.Point(0.03, 0.5)]


def test_logistic_regressions_of_all_sites_agree_with_mllib(featured):
    found = {(r.site, r.point): r for r in S.fit_logistic(featured, POINTS).collect()}
    assert len(found) == 2 * len(POINTS)
    for (site, k), ours in found.items():
        own = as_vectors(featured, site)
        point = POINTS[k]
        theirs = LogisticRegression(
            maxIter=500, tol=1e-12, regParam=point.reg_param, elasticNetParam=point.elasticnet_param
        ).fit(own)
        data = own.select(vector_to_array("features").alias("f"), "label").collect()
        x, y = np.array([r.f for r in data]), np.array([r.label for r in data])
        spread = x.std(axis=0, ddof=1)

        def objective(beta, intercept, x=x, y=y, spread=spread, point=point):
            margin, scaled = x @ beta + intercept, beta * spread
            loss = np.mean(np.logaddexp(0, margin) - y * margin)
            l1, l2 = point.elasticnet_param * abs(scaled).sum(), (1 - point.elasticnet_param) * (scaled**2).sum() / 2
            return loss + point.reg_param * (l1 + l2)

        beta = np.array(ours.coefficients)
        assert math.isclose(ours.objective, objective(beta, ours.intercept), rel_tol=1e-9)
        assert ours.objective <= objective(theirs.coefficients.toArray(), theirs.intercept) + 1e-9
        moving = spread > 0
        if point.reg_param and point.elasticnet_param < 1:  # else the optimum need not be one point
            assert np.allclose(beta, theirs.coefficients.toArray(), atol=2e-3) and abs(ours.intercept - theirs.intercept) < 2e-3
        p, q = (1 / (1 + np.exp(-(x @ b + c))) for b, c in ((beta, ours.intercept), (theirs.coefficients.toArray(), theirs.intercept)))
        assert np.allclose(p, q, atol=1e-3) and (beta[~moving] == 0).all()
        assert ours.iterations < 30


def test_folds_and_points_are_fitted_in_one_plan(rows):
    sets = S.training_sets(rows, folds=3)
    fitted = materialize(S.fit_features(sets, FEATURES))
    table = materialize(
        sets.join(fitted, ["site", "set"]).select("site", "set", "validating", S.feature_vector(FEATURES).alias("features"), "label")
    )
    assert table.filter("set >= 0 and validating").count() == 600 and table.filter("set = -1").count() == 600
    tracker = rows.sparkSession.sparkContext.statusTracker()
    group = rows.sparkSession.sparkContext
    group.setJobGroup("fits", "fits")
    found = S.fit_logistic(table, POINTS[1:3]).collect()
    group.setJobGroup("", "")
    assert len(found) == 2 * 4 * 2
    # Jobs go with iterations (a few stages each), not with the 16 models.
    assert len(tracker.getJobIdsForGroup("fits")) < 6 * max(r.iterations for r in found) + 12
    alone = table.filter("site = 'B' and `set` = 1")
    (one,) = [r for r in S.fit_logistic(alone, POINTS[1:2]).collect()]
    (same,) = [r for r in found if (r.site, r.set, r.point) == ("B", 1, 0)]
    assert np.allclose(one.coefficients, same.coefficients, atol=1e-6)


def test_a_site_with_one_class_has_constant_chances(spark):
    df = spark.createDataFrame([("A", [1.0, 0.0], 0.0), ("A", [0.0, 0.5], 0.0)], "site string, features array<double>, label double")
    sets = df.withColumns({"set": F.lit(S.WHOLE), "validating": F.lit(False)})
    (found,) = S.fit_logistic(sets, [S.Point()]).collect()
    assert found.coefficients == [0.0, 0.0]
    assert S.fit_logistic(sets.limit(0), [S.Point()]).collect() == []


@pytest.mark.parametrize("kind", ["gaussian", "multinomial"])
def test_naive_bayes_agrees_with_mllib(featured, kind):
    models = {r.site: r for r in S.naive_bayes(S.class_statistics(featured), kind).collect()}
    for site in "AB":
        own = as_vectors(featured, site)
        theirs = NaiveBayes(modelType=kind).fit(own)
        ours = models[site]
        assert np.allclose(ours.priors, theirs.pi.toArray(), atol=1e-12)
        assert np.allclose(ours.theta, theirs.theta.toArray(), atol=1e-12)
        if kind == "gaussian":
            assert np.allclose(ours.sigma, theirs.sigma.toArray(), atol=1e-12)


def test_statistics_without_a_fold_are_those_of_the_rest(featured):
    folded = featured.withColumn("fold", F.pmod(F.xxhash64("pid"), F.lit(4)).cast("int"))
    rest = S.without_folds(S.class_statistics(folded, ("site", "fold")))
    for fold in (S.WHOLE, 0, 3):
        direct = {(r.site, r.label): r for r in S.class_statistics(folded.filter(F.col("fold") != fold)).collect()}
        found = {(r.site, r.label): r for r in rest.filter(F.col("set") == fold).collect()}
        assert found.keys() == direct.keys()
        for k, r in direct.items():
            assert r.n == found[k].n and np.allclose(r.sums, found[k].sums) and np.allclose(r.squares, found[k].squares)


def test_models_as_rows_predict_as_mllib_does(rows, stages, whole, featured):
    _, fitted = whole
    algorithms = [T.LOGISTIC_REGRESSION, T.SVM, T.DECISION_TREE, T.RANDOM_FOREST, T.GBT, T.NAIVE_BAYES]
    table, theirs = None, {}
    for site in "AB":
        own = as_vectors(featured, site)
        scored = stages[site].transform(rows)
        for name in algorithms:
            a = T.Algorithm(name, {T.GBT: {"max_iter": 5}, T.RANDOM_FOREST: {"num_trees": 5}}.get(name, {}))
            model = a.estimator().fit(own)
            for r in T.add_prediction(scored.select("pid", "features"), model, "m").select("pid", "m.*").collect():
                theirs[r.pid, site, name] = (r.prediction, r.positive)
            if name == T.NAIVE_BAYES:
                row = S.naive_bayes(S.class_statistics(of_site(featured, site))).withColumn("algorithm", F.lit(name))
                row = S.model_rows(row)
            else:
                row = S.fitted_row(model, site, name)
            table = row if table is None else table.unionByName(row)
    found = S.predict(rows, fitted, materialize(table), FEATURES)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    found = found.collect()
    assert len(found) == len(theirs) == 600 * 2 * 6
    for r in found:
        prediction, positive = theirs[r.pid, r.model_site, r.algorithm]
        assert abs(r.positive - positive) < 1e-6, r
        assert r.prediction == prediction or abs(positive - 0.5) < 1e-6, r


def test_curves_agree_with_mllib(spark):
    rnd = random.Random(9)
    data = []
    for k in range(3000):
        y = float(rnd.random() < 0.3)
        data.append(("AB"[k % 2], round(min(1.0, max(0.0, rnd.gauss(0.3 + 0.3 * y, 0.2))), 2), y))
    data += [("A", None, 1.0), ("B", 0.5, None)]
    df = spark.createDataFrame(data, "site string, score double, label double").repartition(6)
    areas = {r.site: r for r in E.curve_areas(E.score_curve(df, ["site"]), ["site"]).collect()}
    for site in "AB":
        own = df.filter((F.col("site") == site) & F.col("score").isNotNull() & F.col("label").isNotNull())
        for name, metric in (("auroc", "areaUnderROC"), ("aupr", "areaUnderPR")):
            judge = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName=metric, numBins=0)
            assert math.isclose(areas[site][name], judge.evaluate(own), abs_tol=1e-9)
    points = E.score_curve(df).orderBy(F.desc("threshold")).collect()
    known = [(s, y) for _, s, y in data if s is not None and y is not None]
    assert len(points) == len({s for s, _ in known})
    for p in points:
        assert p.tp == sum(s >= p.threshold and y == 1 for s, y in known)
        assert p.fp_before == sum(s > p.threshold and y == 0 for s, y in known)


def test_curves_of_one_class_and_of_nothing(spark):
    df = spark.createDataFrame([("p", 0.5, 1.0), ("p", 0.7, 1.0), ("n", 0.5, 0.0)], "g string, score double, label double")
    areas = {r.g: (r.auroc, r.aupr) for r in E.curve_areas(E.score_curve(df, ["g"]), ["g"]).collect()}
    assert areas == {"p": (1.0, 1.0), "n": (0.0, 0.0)}
    assert E.curve_areas(E.score_curve(df.limit(0), ["g"]), ["g"]).collect() == []


def test_own_models_only(whole, featured):
    """Asked for the models of a row's own site, those of others do not score it."""
    sets, fitted = whole
    training = featured.filter((F.col("set") == S.WHOLE) & ~F.col("validating"))
    models = S.model_rows(S.naive_bayes(S.class_statistics(training)).withColumn("algorithm", F.lit("bayes")))
    plain = sets.filter(F.col("set") == S.WHOLE).drop("set", "validating")
    every = S.predict(plain, fitted, models, FEATURES).filter("site = model_site")
    own = S.predict(plain, fitted, models, FEATURES, own=True)
    assert own.count() == every.count() > 0
    assert own.exceptAll(every).count() == every.exceptAll(own).count() == 0


def test_keys_are_numbered_once_a_batch():
    names = {("a", -1): 0, ("a", 2): 1, ("b", -1): 2, (None, 0): 3}
    sites, sets = pa.array(["b", "a", None, "a", "b"]), np.array([-1, 2, 0, -1, -1], np.int32)
    assert S._key_numbers(sites, sets, names).tolist() == [2, 1, 3, 0, 2]
    assert S._key_numbers(sites[:0], sets[:0], names).tolist() == []


def test_all_trees_at_once_reach_the_leaves_that_a_walk_reaches():
    rng = np.random.default_rng(5)

    def grow(depth, nodes):
        at = len(nodes)
        nodes.append(None)
        if depth == 0 or rng.random() < 0.1:
            nodes[at] = (-1, 0.0, -1, -1, rng.random())
        else:
            left = grow(depth - 1, nodes)
            nodes[at] = (int(rng.integers(4)), float(rng.integers(10)) / 10, left, grow(depth - 1, nodes), 0.0)
        return at

    trees = []
    for depth in (0, 1, 3, 5, 5, 6):
        nodes = []
        grow(depth, nodes)
        trees.append({k: np.array([n[i] for n in nodes]) for i, k in enumerate(("feature", "threshold", "left", "right", "value"))})
    x = np.round(rng.random((500, 4)), 1)  # many equal to a threshold
    x[0] = np.nan
    x[1], x[2] = np.inf, -np.inf
    for tree, reached in zip(trees, S._Forest(trees).leaves(x), strict=True):
        assert (reached == S._leaves(tree, x, 6)).all()


def test_packed_features_are_those_of_the_rows(rows, featured):
    """Rows of every set, packed by the task, are the vectors that SQL makes; unpacked they are whole again."""
    sets = S.training_sets(rows, folds=2)
    fitted = materialize(S.fit_features(sets, FEATURES))
    packed = materialize(S.packed_features(rows, fitted, FEATURES, folds=2), partition_by=["part"])
    assert packed.columns == ["site", "set", "validating", "part", "n", "width", "rows"]
    slow = sets.join(fitted, ["site", "set"]).select("site", "set", "validating", S.feature_vector(FEATURES).alias("features"), "label")
    parts = {(r.site, r.set): r.part for r in packed.select("site", "set", "part").distinct().collect()}
    assert len(parts) == len(set(parts.values())) == 2 * 3
    for (site, n), part in parts.items():
        ours = sorted(map(tuple, S.unpack(packed.filter(F.col("part") == part)).select("validating", "features", "label").collect()))
        theirs = slow.filter((F.col("site") == site) & (F.col("set") == n)).select("validating", "features", "label").collect()
        assert ours == sorted(map(tuple, theirs))
    again = S.unpack(S.pack(slow.filter("site = 'A'"))).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, slow.filter("site = 'A'").drop("site").collect()))


def test_packed_rows_give_the_same_bayes(rows, whole, featured):
    packed = S.packed_features(rows, whole[1], FEATURES)
    ours = {(r.site, r.label): r for r in S.class_statistics(packed).collect()}
    theirs = {(r.site, r.label): r for r in S.class_statistics(featured).collect()}
    assert ours.keys() == theirs.keys() and all(ours[k].n == theirs[k].n for k in ours)
    assert all(np.allclose(ours[k].sums, theirs[k].sums) and np.allclose(ours[k].squares, theirs[k].squares) for k in ours)


def test_outcomes_are_counted_where_rows_are_scored(rows, whole, featured):
    models = S.model_rows(S.naive_bayes(S.class_statistics(featured)).withColumn("algorithm", F.lit("bayes")))
    by = ("site", "model_site", "algorithm")
    for own in (False, True):
        long = S.predict(rows, whole[1], models, FEATURES, own=own, keep=("site", "label"))
        assert long.columns == ["site", "label", "model_site", "algorithm", "prediction", "negative", "positive"]
        counted = S.outcomes(rows, whole[1], models, FEATURES, own=own)
        assert counted.count() <= rows.rdd.getNumPartitions() * (2 if own else 4)  # not a row for each record and model
        statistics = [E.counted_statistics(E.added_counts(counted, by)), E.binary_statistics(long, by)]
        found = [sorted(map(tuple, s.select(*by, *E.COUNTS, "accuracy", "f_measure").collect())) for s in statistics]
        assert found[0] == found[1] and len(found[0]) == (2 if own else 4)


def test_rows_of_all_sets_are_gathered_at_once(spark):
    """Equal rows are one with a weight, also those that validate; what is moved goes the way of what it stands for."""
    df = spark.range(9_000).select(
        F.element_at(F.array(F.lit("A"), F.lit("B")), (F.col("id") % 2 + 1).cast("int")).alias("site"), F.lit(0).alias("set"), (F.col("id") % 3 == 0).alias("validating"),
        F.array((F.col("id") % 1000).cast("double"), (F.col("id") % 5).cast("double")).alias("features"), (F.col("id") % 1000 > 612).cast("double").alias("label"),
    )
    found = S.gathered_sets(materialize(S.pack(df)), 32).collect()
    assert len(found) <= 2 * 2 * 2 * 32 * 5
    weights = {}
    for r in found:
        weights[r.site, r.validating] = weights.get((r.site, r.validating), 0) + r.weight
        assert r.features[1] in range(5)
    assert weights == {(s, v): (1500.0 if v else 3000.0) for s in "AB" for v in (False, True)}
    for v in (False, True):
        assert len({r.features[0] for r in found if r.site == "A" and r.validating == v}) <= 32
    own = spark.createDataFrame([r for r in found if r.site == "A"], "site string, set int, validating boolean, features array<double>, label double, weight double")
    own = own.select("set", "validating", array_to_vector("features").alias("features"), "label", "weight")
    whole_set = own.unionByName(own.filter("not validating").withColumn("set", F.lit(-1)))
    model = T.fit_best(whole_set, T.Algorithm(T.DECISION_TREE, {"max_depth": "1,3", "num_folds": 1}))
    right = model.transform(own).filter(F.col("prediction") == F.col("label")).agg(F.sum("weight")).first()[0]
    assert right > 0.97 * 4500


def test_sets_without_a_fold_start_from_all_rows(featured, rows):
    sets = S.training_sets(rows, folds=3)
    packed = materialize(S.packed_features(rows, materialize(S.fit_features(sets, FEATURES)), FEATURES, folds=3))
    both = S.fit_logistic(packed, POINTS[1:2]).collect()
    alone = {(r.site, r.set): r for r in S.fit_logistic(packed.filter("`set` >= 0"), POINTS[1:2]).collect()}
    assert len(both) == 8 and len(alone) == 6
    for r in both:
        if r.set != S.WHOLE:
            other = alone[r.site, r.set]
            assert abs(r.objective - other.objective) < 1e-9 and np.allclose(r.coefficients, other.coefficients, atol=1e-6)
    assert sum(r.iterations for r in both if r.set >= 0) < sum(r.iterations for r in alone.values())
