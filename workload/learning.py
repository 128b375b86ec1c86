"""Training, cross-site validation, ensembles and scoring.

No SQL gives the same models, but for naive Bayes, whose parameters are compared. The queries show what holds whatever the fit: how many rows and
positives each model was judged on, that its outcomes add up, and that its accuracy is above a
floor. The figures themselves come from the library's functions that the queries call. The
prepared dataset is stored by site first; a fit reads the files of its own site.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortweave.operators import site_models as M
from cohortweave.operators import training as T
from cohortweave.operators.ensemble import ensemble_weights, weighted_vote
from cohortweave.operators.evaluate import binary_statistics, combine_statistics, curve_areas, score_curve
from cohortweave.operators.features import prepare_features
from cohortweave.operators.federation import error_rollup
from cohortweave.plans import prediction as P
from cohortweave.session import materialize, shared_dir
from cohortweave.sources.store import DatasetStore
from cohortweave.spec import CATEGORICAL, DEPENDENT, Featureset, Variable
from cohortweave.streaming.scoring import score_stream
from workload import tables
from workload.registry import query
from workload.tables import ENC, PAT, with_sql

# One row per encounter: was it a readmission, going by what is known of it and of its patient?
# The site is a column of the dataset but neither a feature nor the label.
LEARNED = Featureset(
    (
        Variable("site", "/Patient", "value:site", CATEGORICAL, role="site"),
        Variable("kind", "/Encounter", "value:kind", CATEGORICAL),
        Variable("segment", "/Patient", "value:nullif(segment, 'BUILDING')", CATEGORICAL),
        Variable("age", "/Patient", "value:age"),
        Variable("balance", "/Patient", "value:case when balance >= 0 then balance end"),
        Variable("stays", "/Encounter", "value:hospitalization:6"),
        Variable("lines", "/MedicationStatement", "aggr:count", group_by="encounter"),
        Variable("readmitted", "/Encounter", "value:readmission:2:180", role=DEPENDENT),
    )
)

# Default folds, iterations and trees; grids of two where a choice is shown.
ALGORITHMS = {
    T.LOGISTIC_REGRESSION: {"reg_param": "0.01,0.1", "elasticnet_param": 1.0},
    T.DECISION_TREE: {"max_depth": "3,5", "impurity": "entropy"},
    T.RANDOM_FOREST: {"feature_subset_strategy": "sqrt"},
    T.GBT: {},
    T.SVM: {"reg_param": 0.01},
    T.NAIVE_BAYES: {},
}
# No model may be worse than this on the rows it is judged on.
ACCURACY_FLOOR = 0.5
# Nor rank its training rows worse than this; a constant score has an area of 0.5.
RANKING_FLOOR = 0.52

LEARNED_SQL = """learned as (
  select c.enc as pid, site, max(case when c.ty = 'unplanned' and p.en < c.st and p.en > c.st - interval '180' day
    then 1 else 0 end) as y
  from enc c join enc p on p.subj = c.subj join pat on pat.pid = c.subj group by 1, 2),
numbered as (
  select pid, site, cast(y <> (select y from learned group by y order by count(*) desc, y limit 1) as integer) as label,
    (cast('0x' || substr(md5(pid || ':11'), 1, 8) as bigint) % 100) < 80 as training
  from learned),
algorithms as (select unnest([""" + ", ".join(f"'{name}'" for name in ALGORITHMS) + """]) as algorithm)"""
LEARNED_WITH = with_sql(PAT, ENC, LEARNED_SQL)
JUDGED_SQL = "count(*) as total, cast(sum(label) as bigint) as positives, true as adds_up, true as accurate"


def _judged(statistics, *keys):
    """What does not depend on the fit, and whether the rest is as it should be."""
    outcomes = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return statistics.select(
        *keys,
        F.col("total").cast("long").alias("total"),
        (F.col("tp") + F.col("fn")).cast("long").alias("positives"),
        (outcomes == F.col("total")).alias("adds_up"),
        (F.col("accuracy") >= ACCURACY_FLOOR).alias("accurate"),
    )


def _algorithm(name: str, **more) -> T.Algorithm:
    return T.Algorithm(name, {**ALGORITHMS[name], **more})


def stored(spark, sf_dir):
    """The prepared dataset, stored by site.

    It is prepared once per application and data folder; like every user of a
    dataset store, each training reads what is stored.
    """
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{sf_dir.strip('/').replace('/', '-')}"
    store = DatasetStore(spark, folder)
    if store.dataset("learned") is None:
        dataset = prepare_features(tables.resources(spark, sf_dir), LEARNED, as_of=tables.as_of())
        store.save_dataset("learned", dataset, partition_by=["site"])
    return store.dataset("learned")


def _site_names(dataset):
    return [row["site"] for row in dataset.select("site").distinct().orderBy("site").collect()]


def _trained(spark, sf_dir, name, **more):
    """Statistics on training and held-out rows of one model over all sites' rows."""
    algorithm = _algorithm(name, **more)
    dataset = stored(spark, sf_dir)
    labels = T.label_order(dataset, LEARNED)
    labelled = T.with_label(dataset, LEARNED, labels, algorithm)
    model = T.train(T.training_split(labelled), LEARNED, [algorithm])[0]
    scored = T.add_prediction(labelled, model, "m").select(
        F.when(T.in_training_split(F.col("pid")), "train").otherwise("test").alias("split"), "label", "m.prediction"
    )
    statistics = binary_statistics(scored, ["split"]).withColumn("algorithm", F.lit(name))
    return _judged(statistics, "algorithm", "split")


def _trained_sql(name):
    return LEARNED_WITH + (
        f"select '{name}' as algorithm, case when training then 'train' else 'test' end as split, {JUDGED_SQL} "
        "from numbered group by 1, 2"
    )


@query("train_logistic_regression", _trained_sql(T.LOGISTIC_REGRESSION))
def train_logistic_regression(spark, sf_dir):
    return _trained(spark, sf_dir, T.LOGISTIC_REGRESSION)


@query("train_decision_tree", _trained_sql(T.DECISION_TREE))
def train_decision_tree(spark, sf_dir):
    return _trained(spark, sf_dir, T.DECISION_TREE)


@query("train_random_forest", _trained_sql(T.RANDOM_FOREST))
def train_random_forest(spark, sf_dir):
    return _trained(spark, sf_dir, T.RANDOM_FOREST)


@query("train_gbt", _trained_sql(T.GBT))
def train_gbt(spark, sf_dir):
    return _trained(spark, sf_dir, T.GBT)


@query("train_linear_svm", _trained_sql(T.SVM))
def train_linear_svm(spark, sf_dir):
    return _trained(spark, sf_dir, T.SVM)


@query("train_naive_bayes", _trained_sql(T.NAIVE_BAYES))
def train_naive_bayes(spark, sf_dir):
    return _trained(spark, sf_dir, T.NAIVE_BAYES)


@query(
    "cross_validate",
    """select cast(d as integer) as max_depth, i as impurity, true as plausible
    from (select unnest([2, 4]) as d), (select unnest(['gini', 'entropy']) as i)""",
)
def cross_validate(spark, sf_dir):
    """Three folds over a grid of four, judged by the area under precision-recall."""
    more = {"metric": "areaUnderPR", "max_depth": "2,4", "impurity": "gini,entropy"}
    algorithm = _algorithm(T.DECISION_TREE, **more)
    dataset = stored(spark, sf_dir)
    labelled = T.with_label(dataset, LEARNED, T.label_order(dataset, LEARNED), algorithm)
    results = T.cross_validate(T.training_split(labelled), LEARNED, [algorithm])[0]
    rows = [(p["maxDepth"], p["impurity"], 0.0 < metric <= 1.0) for p, metric in results]  # one per point of the grid
    return spark.createDataFrame(rows, "max_depth int, impurity string, plausible boolean")


@query("model_persist", LEARNED_WITH + "select site, pid, true as same from numbered")
def model_persist(spark, sf_dir):
    """Predictions before and after a model is stored and loaded again."""
    algorithm = _algorithm(T.LOGISTIC_REGRESSION)
    dataset = stored(spark, sf_dir)
    labelled = T.with_label(dataset, LEARNED, T.label_order(dataset, LEARNED), algorithm)
    model = T.train(T.training_split(labelled), LEARNED, [algorithm])[0]
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}/model"
    T.save_model(model, path)
    both = T.add_prediction(T.add_prediction(labelled, model, "a"), T.load_model(path), "b")
    return both.select("site", "pid", (F.col("a.positive") == F.col("b.positive")).alias("same"))


def _site_models(spark, sf_dir):
    """All algorithms at all sites, as a table of models, and the labelled rows."""
    dataset = stored(spark, sf_dir)
    labels = T.label_order(dataset, LEARNED)
    algorithms = [_algorithm(name) for name in ALGORITHMS]
    models = P.train_models(dataset, LEARNED, algorithms, _site_names(dataset), labels)
    if models.errors:
        raise P.TrainingError([message for _, _, message in models.errors])
    return models, T.with_label(dataset, LEARNED, labels, algorithms[0])


def _with_ranking(judged, predictions, *keys):
    """Whether the scores rank positives above negatives; those of a constant classifier do not."""
    areas = curve_areas(score_curve(predictions, keys, score="positive"), keys)
    return judged.join(areas.select(*keys, (F.col("auroc") > RANKING_FLOOR).alias("ranks")), list(keys))


@query(
    "train_per_site",
    LEARNED_WITH
    + f"""select algorithm, site as model_site, site, {JUDGED_SQL}, true as ranks
    from numbered, algorithms where training group by 1, 2, 3""",
)
def train_per_site(spark, sf_dir):
    """One model per site and algorithm, with statistics on its own training rows."""
    models, labelled = _site_models(spark, sf_dir)
    predictions = materialize(models.predictions(T.training_split(labelled), own=True, keep=()))
    keys = ("algorithm", "model_site", "site")
    return _with_ranking(_judged(binary_statistics(predictions, keys), *keys), predictions, *keys)


@query(
    "cross_site_validate_models",
    LEARNED_WITH
    + f"""select algorithm, m.site as model_site, numbered.site, {JUDGED_SQL} from numbered, algorithms,
    (select distinct site from pat) m where training and m.site <> numbered.site group by 1, 2, 3""",
)
def cross_site_validate_models(spark, sf_dir):
    models, labelled = _site_models(spark, sf_dir)
    statistics = models.statistics(T.training_split(labelled)).filter("step = 'validate'")
    return _judged(statistics, "algorithm", "model_site", "site")


@query(
    "ensemble_test_models",
    LEARNED_WITH + f"select algorithm, {JUDGED_SQL} from numbered, algorithms where not training group by 1",
)
def ensemble_test_models(spark, sf_dir):
    """Train, validate, weight and test end to end, over all sites."""
    models, labelled = _site_models(spark, sf_dir)
    weights = ensemble_weights(models.statistics(T.training_split(labelled)))
    votes = weighted_vote(models.predictions(T.test_split(labelled)), weights)
    tested = combine_statistics(binary_statistics(votes, ("algorithm", "site")), ("algorithm",))
    return _judged(tested, "algorithm")


@query(
    "training_errors",
    LEARNED_WITH
    + f"""select 'run' as model_id, 'error' as state, 'ASIA: only one class to train on' as error_message, total
    from (select count(*) as total from numbered where training and site <> 'ASIA')""",
)
def training_errors(spark, sf_dir):
    """A site whose rows are all of one class gives an error; the others train, nothing is hidden."""
    dataset = stored(spark, sf_dir)
    labels = T.label_order(dataset, LEARNED)
    algorithm = _algorithm(T.NAIVE_BAYES)
    one_class = dataset.filter((F.col("site") != "ASIA") | (F.col("readmitted") == labels[0]))
    models = P.train_per_site(one_class, LEARNED, [algorithm], _site_names(dataset), labels)
    labelled = T.training_split(T.with_label(one_class, LEARNED, labels, algorithm))
    judged = P.site_statistics(models, labelled, own=True).filter("step = 'train'").agg(F.sum("total").cast("long").alias("total"))
    return error_rollup(P.training_results(spark, models, "run")).select(
        "model_id", "state", "error_message", judged.scalar().alias("total")
    )


def _ensemble(spark, sf_dir, name):
    """Trained for the query that asks; as pipelines, which also score a stream."""
    dataset = stored(spark, sf_dir)
    algorithm, labels = _algorithm(name), T.label_order(dataset, LEARNED)
    models = P.train_per_site(dataset, LEARNED, [algorithm], _site_names(dataset), labels)
    statistics = P.site_statistics(models, T.training_split(T.with_label(dataset, LEARNED, labels, algorithm)))
    return P.build_ensembles(models, statistics)[name], dataset


HELD_OUT = LEARNED_WITH + "select pid, true as sound from numbered where not training"


@query("score_new_records", HELD_OUT)
def score_new_records(spark, sf_dir):
    """All held-out records, without their label, through one ensemble."""
    ensemble, dataset = _ensemble(spark, sf_dir, T.LOGISTIC_REGRESSION)
    records = T.test_split(dataset).drop("readmitted")
    whole = F.abs(F.col("positive") + F.col("negative") - F.col("weights")) < 1e-6
    total = sum(weight for weight, _ in ensemble.members)
    scored = ensemble.score(records).withColumn("weights", F.lit(float(total)))
    return scored.select("pid", (F.col("prediction").isin(0.0, 1.0) & whole).alias("sound"))


@query("score_new_records_stream", HELD_OUT)
def score_new_records_stream(spark, sf_dir):
    """The same records as a stream of files give the same scores."""
    ensemble, dataset = _ensemble(spark, sf_dir, T.LOGISTIC_REGRESSION)
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    T.test_split(dataset).drop("readmitted").write.parquet(f"{folder}/arriving")
    arriving = spark.read.parquet(f"{folder}/arriving")
    stream = spark.readStream.schema(arriving.schema).parquet(f"{folder}/arriving")
    score_stream(ensemble, stream, f"{folder}/scores", f"{folder}/checkpoint").awaitTermination()
    streamed = spark.read.parquet(f"{folder}/scores")
    batch = ensemble.score(arriving).withColumnsRenamed({"prediction": "p", "positive": "q"})
    same = (F.col("prediction") == F.col("p")) & (F.col("positive") == F.col("q"))
    return streamed.join(batch.select("pid", "p", "q"), "pid").select("pid", same.alias("sound"))


# --- fits of all sites in one plan ---------------------------------------------

# Orders of a region: is an order dear or urgent, by its price, its customer's balance and its year?
PLAIN_SQL = """plain as (
  select r_name as site, o_orderkey as id, case when o_totalprice > 150000 and o_orderstatus <> 'P' or o_orderpriority = '1-URGENT'
    then 1.0::double else 0.0::double end as label,
    [o_totalprice::double / 500000, (c_acctbal::double + 1000) / 11000, (year(o_orderdate) - 1990)::double / 10] as features
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def _plain(spark, sf_dir):
    orders, customer, nation, region = (tables.table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    wanted = (F.col("o_totalprice") > 150000) & (F.col("o_orderstatus") != "P") | (F.col("o_orderpriority") == "1-URGENT")
    features = F.array(
        F.col("o_totalprice").cast("double") / 500000,
        (F.col("c_acctbal").cast("double") + 1000) / 11000,
        (F.year("o_orderdate") - 1990).cast("double") / 10,
    )
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("site"), F.col("o_orderkey").alias("id"),
            F.when(wanted, 1.0).otherwise(0.0).alias("label"), features.alias("features"),
        )
    )


POINTS = (M.Point(0.01, 0.0), M.Point(0.02, 1.0))


@query(
    "site_logistic_regressions",
    with_sql(PLAIN_SQL)
    + """, points as (select unnest([0, 1])::int as point), folds as (select unnest([-1, 0, 1, 2])::int as "set")
    select site, "set", point, count(*) as total, true as optimal, true as informed
    from plain, points, folds where id % 3 <> "set" group by 1, 2, 3""",
)
def site_logistic_regressions(spark, sf_dir):
    """All sites, folds and points in one plan. Optimal: no direction lowers the penalized loss."""
    rows = _plain(spark, sf_dir).withColumn("set", F.explode(F.array(*[F.lit(k) for k in (M.WHOLE, 0, 1, 2)])))
    sets = materialize(rows.withColumn("validating", F.pmod("id", F.lit(3)) == F.col("set")))
    fits = materialize(M.fit_logistic(sets, POINTS))
    training = sets.filter("not validating").join(fits, ["site", "set"])
    margin = F.aggregate(
        F.zip_with("features", "coefficients", lambda x, b: x * b), F.col("intercept"), lambda s, x: s + x
    )
    p = 1 / (1 + F.exp(-margin))
    n, size = F.count(F.lit(1)), 3
    slopes = [F.avg((p - F.col("label")) * F.get("features", F.lit(j))).alias(f"g{j}") for j in range(size)]
    spreads = [F.stddev_samp(F.get("features", F.lit(j))).alias(f"s{j}") for j in range(size)]
    loss = F.avg(F.log1p(F.exp(-F.abs(margin))) + F.greatest(margin, F.lit(0.0)) - F.col("label") * margin)
    share = F.avg("label")
    told = training.groupBy("site", "set", "point").agg(
        n.alias("total"), F.first("coefficients").alias("b"), F.avg(p - F.col("label")).alias("g"), *slopes, *spreads,
        loss.alias("loss"), (-share * F.log(share) - (1 - share) * F.log(1 - share)).alias("prior"),
    )
    reg = F.get(F.array(*[F.lit(x.reg_param) for x in POINTS]), F.col("point"))
    alpha = F.get(F.array(*[F.lit(x.elasticnet_param) for x in POINTS]), F.col("point"))
    optimal = F.abs("g") < 1e-5
    for j in range(size):
        b, s = F.get("b", F.lit(j)), F.col(f"s{j}")
        slope, pull = F.col(f"g{j}") + reg * (1 - alpha) * s * s * b, reg * alpha * s
        inside = F.when(b == 0, F.abs(slope) <= pull + 1e-5).otherwise(F.abs(slope + pull * F.signum(b)) < 1e-5)
        optimal = optimal & inside
    return told.select("site", "set", "point", "total", optimal.alias("optimal"), (F.col("loss") < F.col("prior")).alias("informed"))


@query(
    "site_naive_bayes",
    with_sql(PLAIN_SQL)
    + """, folds as (select unnest([-1, 0, 1, 2])::int as "set"),
    sums as (select site, "set", label, i - 1 as place, count(*)::double as n, sum(features[i]) as s,
        sum(features[i] * features[i]) as q
      from plain, folds, range(1, 4) t(i) where id % 3 <> "set" group by all),
    whole as (select site, "set", place, sum(n) as total, sum(q) / sum(n) - (sum(s) / sum(n)) ** 2 as spread from sums group by all),
    widest as (select site, "set", max(total) as total, max(spread) as spread from whole group by all),
    shares as (select site, "set", label, sum(s) as mass from sums group by all)
    select 'gaussian' as kind, site, "set", label::int as label, place::int as place, round(ln(n / total), 6) as prior,
      round(s / n, 6) as theta, round(1e-9 * spread + q / n - (s / n) ** 2, 6) as sigma
    from sums join widest using (site, "set")
    union all
    select 'multinomial', site, "set", label::int, place::int, round(ln(n + 1) - ln(total + 2), 6), round(ln(s + 1) - ln(mass + 3), 6), null
    from sums join widest using (site, "set") join shares using (site, "set", label)""",
)
def site_naive_bayes(spark, sf_dir):
    """Both kinds at all sites, on all rows and without each fold, from one pass over the rows."""
    rows = _plain(spark, sf_dir).withColumn("fold", F.pmod("id", F.lit(3)).cast("int"))
    statistics = materialize(M.class_statistics(rows, ("site", "fold")))
    sets = materialize(M.without_folds(statistics))
    by = ("site", "set")
    both = M.naive_bayes(sets, "gaussian", by=by).unionByName(M.naive_bayes(sets, "multinomial", by=by))
    classes = both.select("kind", *by, F.posexplode(F.arrays_zip("priors", "theta", "sigma")).alias("label", "m"))
    each = classes.select("kind", *by, "label", "m.priors", "m.sigma", F.posexplode("m.theta").alias("place", "theta"))
    rounded = lambda c: F.round(c, 6)
    return each.select(
        "kind", *by, "label", "place", rounded("priors").alias("prior"), rounded("theta").alias("theta"),
        rounded(F.get("sigma", F.col("place"))).alias("sigma"),
    )


@query(
    "score_curves",
    with_sql(PLAIN_SQL)
    + """, scored as (select site, round(features[1], 2) as score, label from plain),
    counted as (select site, score, count(*) filter (label = 1) as p, count(*) filter (label = 0) as n from scored group by all),
    running as (select *, sum(p) over w as tp, sum(n) over w as fp, sum(p) over (partition by site) as ps, sum(n) over (partition by site) as ns
      from counted window w as (partition by site order by score desc)),
    steps as (select *, tp / (tp + fp) as pr, lag(tp, 1, 0) over w as tp0, lag(fp, 1, 0) over w as fp0,
        coalesce(lag(tp / (tp + fp)) over w, tp / (tp + fp)) as pr0
      from running window w as (partition by site order by score desc))
    select site, count(*) as points, round(sum((fp - fp0) / ns * (tp + tp0) / (2 * ps)), 9) as auroc,
      round(sum((tp - tp0) / ps * (pr + pr0) / 2), 9) as aupr
    from steps group by 1""",
)
def score_curves(spark, sf_dir):
    """Areas under the curves of a score with ties."""
    scored = _plain(spark, sf_dir).select("site", F.round(F.get("features", F.lit(0)), 2).alias("score"), "label")
    areas = curve_areas(score_curve(scored, ["site"]), ["site"])
    return areas.withColumns({c: F.round(c, 9) for c in ("auroc", "aupr")})
