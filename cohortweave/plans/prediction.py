"""Federated prediction: train per site, validate across sites, weight, test, score.

Scoring adds one struct column per model to the rows, so any number of models costs
one scan and no shuffle; only counts of outcomes are aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.operators import site_models as M
from cohortweave.operators import training as T
from cohortweave.operators.ensemble import ensemble_weights, vote_class
from cohortweave.operators.evaluate import added_counts, binary_statistics, combine_statistics, counted_statistics, curve_areas, score_curve
from cohortweave.session import materialize
from cohortweave.spec import Featureset, SpecError


# What a fit may raise: errors of Spark and its JVM side, and of the request.
FIT_ERRORS = (PySparkException, Py4JError, ValueError)


class TrainingError(ValueError):
    """Some sites gave no model; the message holds all their errors."""

    def __init__(self, errors: Sequence[str]):
        super().__init__("; ".join(sorted(errors)) or "no models")


@dataclass(frozen=True)
class SiteModel:
    """A model trained at one site, or the reason why there is none."""

    site: str
    algorithm: T.Algorithm
    model: PipelineModel | None
    error: str | None = None


def train_per_site(
    dataset: DataFrame,
    featureset: Featureset,
    algorithms: Sequence[T.Algorithm],
    sites: Sequence[str],
    labels: Sequence,
    parallel_fits: int = 8,
) -> list[SiteModel]:
    """One model per site and algorithm, from the training split of the site.

    ``dataset`` should be stored by site, so that a fit reads only its own files.
    Fits are independent Spark jobs; a few run side by side.
    """

    # Algorithms with the same features and folds are fitted together.
    groups: list[list[T.Algorithm]] = []
    for algorithm in algorithms:
        group = next((g for g in groups if T.shares_features(g[0], algorithm)), None)
        if group is None:
            groups.append([algorithm])
        else:
            group.append(algorithm)

    # A null label is filled alike at all sites.
    training = T.training_split(dataset)
    unknown = not training.filter(F.col(f"`{featureset.dependent.column}`").isNull()).isEmpty()
    fills = [T.label_fill(training, featureset, group[0]) if unknown else None for group in groups]

    def fit(site: str, group: list[T.Algorithm], fill: float | None) -> list[SiteModel]:
        rows = T.training_split(dataset.filter(F.col("site") == site))
        try:
            labelled = T.held(T.with_label(rows, featureset, labels, group[0], fill), featureset)
            try:
                if labelled.select("label").distinct().count() < 2:
                    return [SiteModel(site, a, None, f"{site}: only one class to train on") for a in group]
                models = T.train(labelled, featureset, group)
            finally:
                labelled.unpersist()
            return [SiteModel(site, a, m) for a, m in zip(group, models, strict=True)]
        except FIT_ERRORS as error:  # one site must not stop the others
            if len(group) > 1:  # nor one algorithm the others
                return [m for a in group for m in fit(site, [a], fill)]
            return [SiteModel(site, group[0], None, f"{site}: {error}")]

    tasks = [(site, group, fill) for group, fill in zip(groups, fills, strict=True) for site in sites]
    with ThreadPoolExecutor(parallel_fits) as pool:
        return [model for models in pool.map(lambda task: fit(*task), tasks) for model in models]


@dataclass(frozen=True)
class ModelTable:
    """Models of all sites as rows, the features they read, and the errors of those that there are not."""

    featureset: Featureset
    policy: str
    features: DataFrame
    models: DataFrame
    errors: Sequence[tuple[str, str, str]]  # site, algorithm, message

    def predictions(self, rows: DataFrame, own: bool = False, keep: Sequence[str] = ("pid",)) -> DataFrame:
        """The long prediction table of all models on labelled rows, in one plan; see :func:`model_predictions`.

        With ``own`` rows are scored only by the models of their own site. ``keep``: which columns of the rows are
        wanted beside site and label; none of a row is copied for its models but those.
        """
        long = M.predict(rows, self.features, self.models, self.featureset, self.policy, own, ("site", *keep, "label"))
        return long.select(
            "site", "model_site", "algorithm", *keep, "label", "prediction", "negative", "positive",
            (F.col("site") == F.col("model_site")).alias("own"),
        )

    def statistics(self, labelled: DataFrame, own: bool = False) -> DataFrame:
        """As :func:`site_statistics`; outcomes are counted where the rows are scored."""
        counts = M.outcomes(labelled, self.features, self.models, self.featureset, self.policy, own)
        counts = counts.withColumn("own", F.col("site") == F.col("model_site"))
        statistics = counted_statistics(added_counts(counts, ("algorithm", "model_site", "site", "own")))
        return statistics.withColumn("step", F.when(F.col("own"), "train").otherwise("validate")).drop("own")


def train_models(
    dataset: DataFrame,
    featureset: Featureset,
    algorithms: Sequence[T.Algorithm],
    sites: Sequence[str],
    labels: Sequence,
    parallel_fits: int = 8,
) -> ModelTable:
    """One model per site and algorithm, as rows; the algorithms must share their features and folds.

    Features of all sites and folds come from one plan. So do the logistic regressions of all sites,
    folds and grid points, and naive Bayes; the other algorithms are fitted by MLlib, a site at a time,
    on the stored features. A site or an algorithm that cannot train gives an error, not a failure.
    """
    lead = algorithms[0]
    if not all(T.shares_features(lead, a) for a in algorithms):
        raise SpecError("these algorithms need different features or folds")
    rows = T.training_split(dataset.filter(F.col("site").isin(list(sites))))
    labelled = T.with_label(rows, featureset, labels, lead, T.label_fill(T.training_split(dataset), featureset, lead))
    told = labelled.groupBy("site").agg(F.count_distinct("label").alias("classes"), F.count(F.lit(1)).alias("n")).collect()
    classes, sizes = ({r["site"]: r[c] for r in told} for c in ("classes", "n"))
    ready = [site for site in sites if classes.get(site, 0) > 1]
    errors = [(s, a.name, f"{s}: only one class to train on") for s in sites if s not in ready for a in algorithms]
    grids = [[{p.name: v for p, v in point.items()} for point in a.grid(a.estimator())] for a in algorithms]
    folds = int(lead.tuning("num_folds")) if any(len(g) > 1 for g in grids) else 0
    policy = lead.tuning("handle_invalid")
    used = labelled.filter(F.col("site").isin(ready))
    sets = M.training_sets(used, folds)
    fitted = materialize(M.fit_features(sets, featureset, policy, lead.tuning("imputation_strategy")))
    # Stored by site and set, so that a fit reads only its own rows.
    packed = materialize(M.packed_features(used, fitted, featureset, policy, folds), partition_by=["part"])
    parts, rest = [], []
    for a, points in zip(algorithms, grids, strict=True):
        plain = all(set(p) <= {"regParam", "elasticNetParam", "threshold"} for p in points) and "metric" not in a.parameters
        if a.name == T.LOGISTIC_REGRESSION and plain and ready:
            parts.append(_logistic(packed, a, points))
        elif a.name == T.NAIVE_BAYES and ready:
            whole = packed.filter((F.col("set") == M.WHOLE) & ~F.col("validating"))
            kind = T.SETTINGS[T.NAIVE_BAYES]["modelType"]
            bayes = M.naive_bayes(M.class_statistics(whole), kind)
            parts.append(M.model_rows(bayes.withColumn("algorithm", F.lit(a.name))))
        else:
            rest.append(a)

    # The rows of all large sites are gathered at once for the trees that are fitted on gathered rows.
    kept = {(r["site"], r["set"]): r["part"] for r in packed.select("site", "set", "part").distinct().collect()}
    large = [site for site in ready if sizes[site] > T.ROWS_PER_TASK and (site, M.WHOLE) in kept]
    trees = [a for a in rest if isinstance(a.estimator(), T.GATHERED)]
    widest = packed.agg(F.max("width")).first()[0] if large and trees else 0
    gathered = None
    if large and trees and widest <= T.WIDEST_GATHERED:
        used = packed.filter(F.col("part").isin([p for (site, _), p in kept.items() if site in large]))
        if all(len(a.grid(a.estimator())) == 1 for a in trees):
            used = used.filter(F.col("set") == M.WHOLE)
        gathered = materialize(M.gathered_sets(used, max(a.estimator().getMaxBins() for a in trees)))

    def fit(task: tuple[T.Algorithm, str]) -> DataFrame | tuple[str, str, str]:
        a, site = task
        if gathered is not None and a in trees and site in large:
            own = gathered.filter(F.col("site") == site)
            own = own.select("set", "validating", array_to_vector("features").alias("features"), "label", "weight")
        else:
            needed = [p for (s, n), p in kept.items() if s == site and (n == M.WHOLE or len(a.grid(a.estimator())) > 1)]
            own = M.unpack(packed.filter(F.col("part").isin(needed)))
            own = own.select("set", "validating", array_to_vector("features").alias("features"), "label")
        try:
            return M.fitted_row(T.fit_best(own, a), site, a.name)
        except FIT_ERRORS as error:  # neither one site nor one algorithm must stop the others
            return (site, a.name, f"{site}: {error}")

    with ThreadPoolExecutor(parallel_fits) as pool:
        for made in pool.map(fit, [(a, site) for a in rest for site in ready]):
            (parts if isinstance(made, DataFrame) else errors).append(made)
    if not parts:
        raise TrainingError([message for _, _, message in errors])
    models = materialize(reduce(DataFrame.unionByName, parts))
    return ModelTable(featureset, policy, fitted, models, errors)


def _logistic(packed: DataFrame, algorithm: T.Algorithm, grid: Sequence[dict]) -> DataFrame:
    """The best point of every site, by the area under ROC averaged over its folds."""
    defaults = {mllib: value for mllib, value in T.CLASSIFIERS[algorithm.name][1].values()}
    full = [{**defaults, **point} for point in grid]
    points = [M.Point(float(p["regParam"]), float(p["elasticNetParam"])) for p in full]
    used = packed if len(points) > 1 else packed.filter(F.col("set") == M.WHOLE)
    fits = materialize(M.fit_logistic(used, points, int(defaults["maxIter"])))
    best = fits.filter(F.col("set") == M.WHOLE)
    if len(points) > 1:
        keys = ["site", "set", "point"]
        areas = curve_areas(score_curve(M.logistic_scores(packed, fits.filter(F.col("set") != M.WHOLE)), keys), keys)
        judged = areas.groupBy("site", "point").agg(F.avg("auroc").alias("area"))
        # Of equal ones the first point of the grid.
        chosen = judged.groupBy("site").agg(F.max_by("point", F.struct("area", -F.col("point"))).alias("point"))
        best = best.join(chosen, ["site", "point"], "left_semi")
    thresholds = F.array(*[F.lit(float(p["threshold"])) for p in full])
    return M.model_rows(
        best.withColumns(
            {"algorithm": F.lit(algorithm.name), "kind": F.lit("linear"), "threshold": F.get(thresholds, F.col("point"))}
        )
    )


def training_results(spark: SparkSession, models: Sequence[SiteModel], model_id: str) -> DataFrame:
    """``(model_id, algorithm, site, error_message)``, one row per model or failure; for ``error_rollup``."""
    rows = [(model_id, m.algorithm.name, m.site, m.error) for m in models]
    return spark.createDataFrame(rows, "model_id string, algorithm string, site string, error_message string")


def model_predictions(models: Sequence[SiteModel], rows: DataFrame, own: bool = False) -> DataFrame:
    """The long prediction table of all models on labelled rows ``(site, pid, label, ...)``.

    ``own`` tells the rows of the site that trained the model from those of others. If it is asked for,
    each model scores only the rows of its own site, of a stored dataset only those files.
    """
    fitted = [m for m in models if m.model is not None]
    if not fitted:
        raise TrainingError([m.error for m in models])
    if own:
        return reduce(DataFrame.unionByName, [_long([m], rows.filter(F.col("site") == m.site)) for m in fitted])
    return _long(fitted, rows)


def _long(fitted: Sequence[SiteModel], rows: DataFrame) -> DataFrame:
    scored = rows
    for i, m in enumerate(fitted):
        scored = T.add_prediction(scored, m.model, f"_m{i}")
    entries = [
        F.struct(
            F.lit(m.site).alias("model_site"), F.lit(m.algorithm.name).alias("algorithm"), F.col(f"_m{i}").alias("p")
        )
        for i, m in enumerate(fitted)
    ]
    long = scored.select("site", "pid", "label", F.explode(F.array(*entries)).alias("e"))
    return long.select(
        "site", "e.model_site", "e.algorithm", "pid", "label", "e.p.*",
        (F.col("site") == F.col("e.model_site")).alias("own"),
    )


def site_statistics(models: Sequence[SiteModel], labelled: DataFrame, own: bool = False) -> DataFrame:
    """Statistics of every model at every site: ``train`` at its own, ``validate`` elsewhere.

    With ``own`` only those at its own; see :func:`model_predictions`.
    """
    predictions = model_predictions(models, labelled, own)
    statistics = binary_statistics(predictions, ("algorithm", "model_site", "site", "own"))
    return statistics.withColumn("step", F.when(F.col("own"), "train").otherwise("validate")).drop("own")


@dataclass(frozen=True)
class Ensemble:
    """The site models of one algorithm and their weights."""

    algorithm: str
    members: Sequence[tuple[float, PipelineModel]]

    def score(self, rows: DataFrame, keep: Sequence[str] = ("pid",)) -> DataFrame:
        """``keep`` columns with prediction, negative and positive of the weighted vote.

        A stateless row-by-row transform: no shuffle, and it runs on a stream.
        """
        scored = rows
        for i, (_, model) in enumerate(self.members):
            scored = T.add_prediction(scored, model, f"_m{i}")
        single = len(self.members) == 1
        vote, negative, positive = F.lit(0.0), F.lit(0.0), F.lit(0.0)
        for i, (weight, _) in enumerate(self.members):
            w = F.lit(1.0 if single else float(weight))
            p = F.col(f"_m{i}")
            vote = vote + F.when(p["prediction"] == 0.0, -w).otherwise(w)
            negative = negative + w * p["negative"]
            positive = positive + w * p["positive"]
        prediction = vote_class(vote)
        return scored.select(
            *keep, prediction.alias("prediction"), negative.alias("negative"), positive.alias("positive")
        )


def build_ensembles(
    models: Sequence[SiteModel], statistics: DataFrame, without_failed: bool = False
) -> dict[str, Ensemble]:
    """Ensembles by algorithm, weighted by the combined statistics of their models.

    A model that failed makes this a :class:`TrainingError`, unless ``without_failed`` asks for
    ensembles of the others.
    """
    errors = [m.error for m in models if m.model is None]
    if errors and not without_failed:
        raise TrainingError(errors)
    rows = ensemble_weights(statistics).select("algorithm", "model_site", "weight").collect()
    weights = {(r["algorithm"], r["model_site"]): r["weight"] for r in rows}
    ensembles: dict[str, list] = {}
    for m in models:
        if m.model is not None:
            ensembles.setdefault(m.algorithm.name, []).append((weights[m.algorithm.name, m.site], m.model))
    return {name: Ensemble(name, members) for name, members in ensembles.items()}


def test_ensembles(ensembles: dict[str, Ensemble], labelled: DataFrame) -> DataFrame:
    """Statistics of each ensemble at each site on held-out rows."""
    parts = None
    for name, ensemble in ensembles.items():
        scored = ensemble.score(labelled, keep=("site", "pid", "label")).withColumn("algorithm", F.lit(name))
        parts = scored if parts is None else parts.unionByName(scored)
    return binary_statistics(parts, ("algorithm", "site"))


test_ensembles.__test__ = False  # not a test, whatever its name


def combined_test_statistics(statistics: DataFrame) -> DataFrame:
    """Statistics of each ensemble over all sites."""
    return combine_statistics(statistics, ("algorithm",))
