"""Classifiers of one site: feature pipeline, parameter grid, cross-validation.

Training should read a stored table, since every fit passes over it several times.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, MinMaxScaler, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.functions.expressions import SPLIT_SEED, in_training_split
from cohortweave.operators.encode import drop_invalid
from cohortweave.spec import Featureset, SpecError

# Algorithm names, parameter names, and defaults.
LOGISTIC_REGRESSION = "classification_logistic_regression"
DECISION_TREE = "classification_decision_tree"
RANDOM_FOREST = "classification_random_forest"
GBT = "classification_gbt"
SVM = "classification_svm"
NAIVE_BAYES = "classification_naive_bayes"

TUNING_DEFAULTS = {
    "num_folds": 3,
    "max_parallelism": 2,
    "metric": "areaUnderROC",
    "handle_invalid": "keep",
    "imputation_strategy": "median",
}

# Classifier, and its parameters: name in a request -> (name in MLlib, default).
CLASSIFIERS = {
    LOGISTIC_REGRESSION: (
        LogisticRegression,
        {
            "threshold": ("threshold", 0.5),
            "max_iter": ("maxIter", 100),
            "reg_param": ("regParam", 0.0),
            "elasticnet_param": ("elasticNetParam", 0.0),
        },
    ),
    DECISION_TREE: (
        DecisionTreeClassifier,
        {
            "max_depth": ("maxDepth", 5),
            "min_info_gain": ("minInfoGain", 0.0),
            "impurity": ("impurity", "gini"),
        },
    ),
    RANDOM_FOREST: (
        RandomForestClassifier,
        {
            "max_depth": ("maxDepth", 5),
            "min_info_gain": ("minInfoGain", 0.0),
            "impurity": ("impurity", "gini"),
            "num_trees": ("numTrees", 50),
            "feature_subset_strategy": ("featureSubsetStrategy", "auto"),
        },
    ),
    GBT: (
        GBTClassifier,
        {
            "max_iter": ("maxIter", 100),
            "max_depth": ("maxDepth", 5),
            "min_info_gain": ("minInfoGain", 0.0),
            "feature_subset_strategy": ("featureSubsetStrategy", "auto"),
        },
    ),
    SVM: (LinearSVC, {"max_iter": ("maxIter", 100), "reg_param": ("regParam", 0.0)}),
    NAIVE_BAYES: (NaiveBayes, {}),
}

# Scaled features of unseen rows may be negative, which the multinomial model rejects.
SETTINGS = {NAIVE_BAYES: {"modelType": "gaussian"}}


def parse_values(value: object) -> list:
    """The values of a parameter; text may hold several, separated by commas."""
    if isinstance(value, str):
        return [_number(part.strip()) for part in value.split(",")]
    return list(value) if isinstance(value, Iterable) else [value]


def _number(text: str) -> object:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


@dataclass(frozen=True)
class Algorithm:
    """A classifier by name with its parameters; several values of one span a grid."""

    name: str
    parameters: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self):
        if self.name not in CLASSIFIERS:
            raise SpecError(f"unknown algorithm: {self.name!r}")
        known = {*TUNING_DEFAULTS, *CLASSIFIERS[self.name][1]}
        unknown = set(self.parameters) - known
        if unknown:
            raise SpecError(f"{self.name} has no parameters {sorted(unknown)}")

    def tuning(self, name: str) -> object:
        return self.parameters.get(name, TUNING_DEFAULTS[name])

    def estimator(self, seed: int = SPLIT_SEED):
        kind, known = CLASSIFIERS[self.name]
        settings = {**dict(known.values()), **SETTINGS.get(self.name, {})}
        if self.name in (RANDOM_FOREST, GBT, DECISION_TREE):
            settings["seed"] = seed
        return kind(featuresCol="features", labelCol="label", **settings)

    def grid(self, estimator) -> list[dict]:
        known = CLASSIFIERS[self.name][1]
        axes = [
            [(estimator.getParam(known[name][0]), value) for value in parse_values(values)]
            for name, values in self.parameters.items()
            if name in known
        ]
        return [dict(point) for point in product(*axes)]


def label_order(dataset: DataFrame, featureset: Featureset) -> list:
    """The two classes by falling frequency over all sites, ties in order of value.

    Only counts are needed from a site, and all sites then number classes alike.
    """
    column = _dependent(featureset)
    counts = dataset.filter(F.col(column).isNotNull()).groupBy(column).count()
    top = counts.orderBy(F.col("count").desc(), F.col(column).asc()).limit(3).collect()
    if len(top) > 2:
        raise SpecError(f"{column!r} has more than two classes")
    return [row[0] for row in top]


def _dependent(featureset: Featureset) -> str:
    if featureset.dependent is None:
        raise SpecError("the featureset has no dependent variable")
    return featureset.dependent.column


def label_fill(training: DataFrame, featureset: Featureset, algorithm: Algorithm) -> float | None:
    """What stands for a null label, from training rows: of a numeric label its median or mean.

    One value for all rows that are labelled later, be they of one site, of all, or held out.
    """
    column = _dependent(featureset)
    if algorithm.tuning("handle_invalid") != "keep" or featureset.dependent.is_categorical:
        return None
    known = training.select(column).na.drop()
    if known.isEmpty():
        return None
    imputer = Imputer(inputCols=[column], outputCols=["filled"], strategy=algorithm.tuning("imputation_strategy"))
    return imputer.fit(known).surrogateDF.first()[column]


def with_label(
    dataset: DataFrame, featureset: Featureset, labels: Sequence, algorithm: Algorithm, fill: float | None = None
) -> DataFrame:
    """Add ``label``, the number of the row's class, after the row policy for nulls.

    ``fill`` is the :func:`label_fill` of the training rows; without it, that of ``dataset``'s own.
    """
    column = _dependent(featureset)
    rows = drop_invalid(dataset, [v.column for v in featureset.variables], algorithm.tuning("handle_invalid"))
    if fill is None and not dataset.filter(F.col(column).isNull()).isEmpty():
        fill = label_fill(training_split(dataset), featureset, algorithm)
    number = add_label(rows, column, labels)
    if fill is not None:
        filled = next((float(i) for i, v in enumerate(labels) if v == fill), None)
        number = number.withColumn("label", F.when(F.col(column).isNull(), F.lit(filled)).otherwise(F.col("label")))
    return number.filter("label is not null")


def add_label(rows: DataFrame, column: str, labels: Sequence) -> DataFrame:
    number = F.lit(None).cast("double")
    for i, value in reversed(list(enumerate(labels))):
        number = F.when(F.col(column) == F.lit(value), F.lit(float(i))).otherwise(number)
    return rows.withColumn("label", number)


def feature_stages(featureset: Featureset, algorithm: Algorithm) -> list:
    """Impute, index, one-hot, assemble and scale the independent variables.

    One stage of each kind for all columns; stages without columns are left out.
    """
    policy = algorithm.tuning("handle_invalid")
    numeric = [v.column for v in featureset.independent if not v.is_categorical]
    categorical = [v.column for v in featureset.independent if v.is_categorical]
    keep = policy == "keep"
    stages = []
    if keep and numeric:
        stages.append(
            Imputer(
                inputCols=numeric,
                outputCols=[f"{c}_NUM" for c in numeric],
                strategy=algorithm.tuning("imputation_strategy"),
            )
        )
    if categorical:
        indexed = [f"{c}_INDEX" for c in categorical]
        stages.append(
            StringIndexer(
                inputCols=categorical, outputCols=indexed, stringOrderType="alphabetAsc", handleInvalid=policy
            )
        )
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_VEC" for c in categorical]))
    inputs = [
        f"{v.column}_VEC" if v.is_categorical else f"{v.column}_NUM" if keep else v.column
        for v in featureset.independent
    ]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="nonScaledFeatures", handleInvalid=policy))
    stages.append(MinMaxScaler(inputCol="nonScaledFeatures", outputCol="features"))
    return stages


def _evaluator(algorithm: Algorithm) -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(
        labelCol="label", rawPredictionCol="rawPrediction", metricName=algorithm.tuning("metric")
    )


# Rows that one task of a fit passes over; a fit makes hundreds of passes.
ROWS_PER_TASK = 50_000
# The same for linear models, whose passes are so short that starting a task costs as much as 50,000 rows.
LINEAR_ROWS_PER_TASK = 200_000


# Most rows of a task of a linear fit, where there are more such tasks than may run at once.
MOST_LINEAR_ROWS = 2_000_000


def in_few_tasks(rows: DataFrame, estimator=None) -> DataFrame:
    """Cached rows in as few partitions as their number asks for, by joining neighbours."""
    n, each = rows.count(), ROWS_PER_TASK
    if isinstance(estimator, (LogisticRegression, LinearSVC)):
        at_once = rows.sparkSession.sparkContext.defaultParallelism
        each = max(LINEAR_ROWS_PER_TASK, min(-(-n // at_once), MOST_LINEAR_ROWS))
    return rows.coalesce(max(1, -(-n // each)))


def held(labelled: DataFrame, featureset: Featureset) -> DataFrame:
    """What training reads of labelled rows, cached: the stages of every fold pass over them."""
    used = dict.fromkeys(["pid", *[v.column for v in featureset.independent], "label"])
    return labelled.select(*[F.col(f"`{c}`") for c in used]).persist()


def _prepared(features: PipelineModel, rows: DataFrame) -> DataFrame:
    """What a classifier reads, cached for its passes: two columns, not the whole row."""
    return features.transform(rows).select("features", "label").persist()


#: Longest feature vector whose equal rows are gathered.
WIDEST_GATHERED = 512


def _bins(rows: DataFrame, size: int, most: int) -> list[list[float]]:
    """For each feature at most ``most`` values that stand for all: its own if they are that few, else quantiles."""
    if rows.isEmpty():
        return [[] for _ in range(size)]
    value = [F.get("x", F.lit(j)) for j in range(size)]
    shares = F.array(*[F.lit((k + 0.5) / most) for k in range(most)])
    told = rows.agg(
        *[F.percentile_approx(v, shares, 10000).alias(f"q{j}") for j, v in enumerate(value)],
        *[F.approx_count_distinct(v).alias(f"n{j}") for j, v in enumerate(value)],
    ).first()
    few = [j for j in range(size) if told[f"n{j}"] <= 2 * most]  # the count is approximate
    own = rows.agg(F.lit(0).alias("_"), *[F.collect_set(value[j]).alias(f"v{j}") for j in few]).first()
    return [
        sorted(own[f"v{j}"]) if j in few and len(own[f"v{j}"]) <= most else sorted(set(told[f"q{j}"])) for j in range(size)
    ]  # one list of at most ``most`` numbers per feature


def gathered(rows: DataFrame, most: int) -> DataFrame:
    """``rows(features, label)`` in the bins of trees, with equal ones as one: ``features, label, weight``.

    A tree tells at most ``most`` values of a feature apart. Each value moves to the nearest of those that
    :func:`_bins` gives, so the splits that MLlib then considers, midway between them, send a value and what
    stands for it the same way, in training and in prediction. The passes of a fit go over as many rows as
    there are distinct ones, however many rows there are.
    """
    long = rows.select(vector_to_array("features").alias("x"), "label")
    first = long.first()
    if first is None or len(first["x"]) > WIDEST_GATHERED:
        return rows.withColumn("weight", F.lit(1.0))
    values = _bins(long, len(first["x"]), most)

    def nearest(j: int, kept: list[float]) -> Column:
        x = F.get("x", F.lit(j))
        edges = [F.lit((low + high) / 2) for low, high in zip(kept, kept[1:])]
        return F.get(F.array(*[F.lit(v) for v in kept]), F.size(F.filter(F.array(*edges), lambda e: e < x)) if edges else F.lit(0))

    moved = [nearest(j, kept) for j, kept in enumerate(values)]
    equal = long.select(F.array(*moved).alias("x"), "label").groupBy("x", "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return equal.select(array_to_vector("x").alias("features"), "label", "weight")


#: Whose fit on weighted rows is that on the rows themselves; a forest draws rows one by one.
GATHERED = (DecisionTreeClassifier, GBTClassifier)


def fit_points(estimator, rows: DataFrame, points: Sequence[dict]) -> list:
    """The classifier fitted on ``rows(features, label)``, in few tasks, at each of the points.

    Trees of more rows than one task passes over are fitted on :func:`gathered` rows.
    """
    if not isinstance(estimator, GATHERED) or rows.count() <= ROWS_PER_TASK:
        return [estimator.fit(rows, point) for point in points]
    weighted = gathered(rows, estimator.getMaxBins()).persist()
    try:
        passes = in_few_tasks(weighted)
        weighing = estimator.copy().setWeightCol("weight")
        return [weighing.fit(passes, point) for point in points]
    finally:
        weighted.unpersist()


def shares_features(a: Algorithm, b: Algorithm) -> bool:
    """Whether two algorithms see the same features and folds."""
    return all(a.tuning(name) == b.tuning(name) for name in ("handle_invalid", "imputation_strategy", "num_folds"))


def cross_validate(
    training: DataFrame, featureset: Featureset, algorithms: Sequence[Algorithm]
) -> list[list[tuple[dict, float]]]:
    """For each algorithm the points of its grid with their metric, averaged over the folds.

    The feature stages belong to the validated pipeline: they are fitted on the
    training part of a fold, once for all points of all algorithms. Folds are drawn
    by a hash of the id, so neither the file layout nor a lost executor changes them.
    """
    if not all(shares_features(a, algorithms[0]) for a in algorithms):
        raise SpecError("these algorithms need different features or folds")
    estimators = [a.estimator() for a in algorithms]
    grids = [a.grid(e) for a, e in zip(algorithms, estimators, strict=True)]
    points = [(i, point) for i, grid in enumerate(grids) for point in grid]
    # Points are fitted side by side, but for trees, which share their gathered rows.
    tasks = [
        task
        for i, (e, grid) in enumerate(zip(estimators, grids, strict=True))
        for task in ([(i, grid)] if isinstance(e, GATHERED) else [(i, [point]) for point in grid])
    ]
    folds = int(algorithms[0].tuning("num_folds"))
    fold = F.pmod(F.xxhash64("pid", F.lit(SPLIT_SEED)), F.lit(folds))
    metrics = [0.0] * len(points)
    for n in range(folds):
        inside, outside = training.filter(fold != n), training.filter(fold == n)
        features = Pipeline(stages=feature_stages(featureset, algorithms[0])).fit(inside)
        fitting, validating = _prepared(features, inside), _prepared(features, outside)

        try:
            passes, judged = [in_few_tasks(fitting, e) for e in estimators], in_few_tasks(validating)

            def score(task: tuple[int, list[dict]], passes=passes, judged=judged) -> list[float]:
                i, grid = task
                models = fit_points(estimators[i], passes[i], grid)
                return [_evaluator(algorithms[i]).evaluate(model.transform(judged)) for model in models]

            with ThreadPoolExecutor(max(int(a.tuning("max_parallelism")) for a in algorithms)) as pool:
                found = [metric for each in pool.map(score, tasks) for metric in each]
            metrics = [total + metric / folds for total, metric in zip(metrics, found, strict=True)]
        finally:
            fitting.unpersist()
            validating.unpersist()
    results: list[list[tuple[dict, float]]] = [[] for _ in algorithms]
    for (i, point), metric in zip(points, metrics, strict=True):
        results[i].append(({param.name: value for param, value in point.items()}, metric))
    return results


def train(training: DataFrame, featureset: Featureset, algorithms: Sequence[Algorithm]) -> list[PipelineModel]:
    """For each algorithm the pipeline with the best point of its grid, fitted on all rows.

    ``training`` has ``pid``, the columns of the featureset and ``label``; unless it is cached, what
    is read of it is, meanwhile. The feature stages are fitted once for all algorithms. A grid of one point has nothing to
    choose from and is not cross-validated.
    """
    estimators = [a.estimator() for a in algorithms]
    best = [a.grid(e)[0] for a, e in zip(algorithms, estimators, strict=True)]
    chosen = [i for i, a in enumerate(algorithms) if len(a.grid(estimators[i])) > 1]
    rows = training if training.is_cached else held(training, featureset)
    try:
        if chosen:
            for i, results in zip(chosen, cross_validate(rows, featureset, [algorithms[i] for i in chosen]), strict=True):
                metrics = [metric for _, metric in results]
                best[i] = algorithms[i].grid(estimators[i])[metrics.index(max(metrics))]
        features = Pipeline(stages=feature_stages(featureset, algorithms[0])).fit(rows)
        prepared = _prepared(features, rows)
        try:
            with ThreadPoolExecutor(max(int(a.tuning("max_parallelism")) for a in algorithms)) as pool:
                passes = [in_few_tasks(prepared, e) for e in estimators]
                models = list(pool.map(lambda i: fit_points(estimators[i], passes[i], [best[i]])[0], range(len(algorithms))))
        finally:
            prepared.unpersist()
    finally:
        if rows is not training:
            rows.unpersist()
    return [PipelineModel(stages=[*features.stages, model]) for model in models]


def fit_best(sets: DataFrame, algorithm: Algorithm):
    """The classifier of the best point of the grid, from features that are there already.

    ``sets(set, validating, features, label)`` holds one site's training rows (set -1) and, for a grid
    of several points, those of each fold. With a column ``weight`` equal rows are one already.
    """
    estimator = algorithm.estimator()
    if "weight" in sets.columns:
        return _fit_best_gathered(sets, algorithm, estimator.setWeightCol("weight"))
    grid = algorithm.grid(estimator)
    best = grid[0]
    if len(grid) > 1:
        metrics = [0.0] * len(grid)
        for n in range(int(algorithm.tuning("num_folds"))):
            fold = sets.filter(F.col("set") == n).persist()
            inside, outside = (in_few_tasks(fold.filter(c).select("features", "label").persist(), estimator) for c in ("not validating", "validating"))
            for k, model in enumerate(fit_points(estimator, inside, grid)):
                metrics[k] += _evaluator(algorithm).evaluate(model.transform(outside))
            for held in (fold, inside, outside):
                held.unpersist()
        best = grid[metrics.index(max(metrics))]
    whole = sets.filter("set = -1 and not validating").select("features", "label").persist()
    try:
        return fit_points(estimator, in_few_tasks(whole, estimator), [best])[0]
    finally:
        whole.unpersist()


def _fit_best_gathered(sets: DataFrame, algorithm: Algorithm, estimator):
    """:func:`fit_best` on rows with a weight: few enough to be read again for each fold."""
    grid = algorithm.grid(estimator)
    best, few = grid[0], sets.persist()
    chosen = lambda n, validating: few.filter((F.col("set") == n) & (F.col("validating") == validating)).select("features", "label", "weight")
    try:
        if len(grid) > 1:
            metrics = [0.0] * len(grid)
            for n in range(int(algorithm.tuning("num_folds"))):
                inside, outside = in_few_tasks(chosen(n, False)), in_few_tasks(chosen(n, True))
                for k, point in enumerate(grid):
                    metrics[k] += _evaluator(algorithm).setWeightCol("weight").evaluate(estimator.fit(inside, point).transform(outside))
            best = grid[metrics.index(max(metrics))]
        return estimator.fit(in_few_tasks(chosen(-1, False)), best)
    finally:
        few.unpersist()


def training_split(dataset: DataFrame) -> DataFrame:
    return dataset.filter(in_training_split(F.col("pid")))


def test_split(dataset: DataFrame) -> DataFrame:
    return dataset.filter(~in_training_split(F.col("pid")))


test_split.__test__ = False  # not a test, whatever its name


def _scores(scored: DataFrame) -> tuple[Column, Column]:
    """Probabilities of the negative and the positive class.

    A linear SVM gives none; the logistic function of its margin stands in, which
    orders records alike but is not calibrated.
    """
    if "probability" in scored.columns:
        p = vector_to_array("probability")
        return p[0], p[1]
    positive = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return 1 - positive, positive


def add_prediction(rows: DataFrame, model: Transformer, name: str) -> DataFrame:
    """``rows`` with a struct ``name(prediction, negative, positive)``. No shuffle."""
    before = rows.columns
    scored = model.transform(rows)
    negative, positive = _scores(scored)
    struct = F.struct(F.col("prediction"), negative.alias("negative"), positive.alias("positive"))
    return scored.select(*[F.col(f"`{c}`") for c in before], struct.alias(name))


def save_model(model: PipelineModel, path: str) -> None:
    """Store a fitted pipeline where another site can load it."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
