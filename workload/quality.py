"""Evaluation and ensembles, over predictions of one-threshold models made at each site.

A threshold model says 1 where a patient's value lies above the mean at the site that
made it. Its parameters are a handful of numbers, so SQL can repeat every step.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortweave.functions.expressions import in_training_split
from cohortweave.operators import cohort as C
from cohortweave.operators import encounters as E
from cohortweave.operators import ensemble, evaluate
from cohortweave.session import materialize
from workload import tables
from workload.extraction import READMISSION_2_SQL
from workload.preparation import SPLIT_SQL
from workload.registry import query
from workload.tables import ENC, PAT, with_sql

# Value a model looks at, and the distance from the threshold that makes it certain.
THRESHOLD_MODELS = {"by_balance": ("balance", 10000.0), "by_encounters": ("n_enc", 20.0)}


def _labelled(spark, sf_dir):
    """``(pid, site, balance, n_enc, label)``, stored; label 1 for a patient ever readmitted."""
    table = tables.encounters(spark, sf_dir)
    rows = C.encounter_items(table, table.rows, tables.as_of()).select(*C.ENCOUNTER_COLUMNS)
    per_patient = (
        E.readmission(rows, 30)
        .groupBy(F.col("subject").alias("pid"))
        .agg(F.max("value").alias("label"), F.count(F.lit(1)).cast("double").alias("n_enc"))
    )
    patients = tables.patients(spark, sf_dir).df.select(F.col("ref").alias("pid"), "site", "balance")
    return materialize(patients.join(per_patient, "pid", "left").na.fill(0.0, ["label", "n_enc"]))


def predictions(spark, sf_dir):
    """The long prediction table: every patient by every model, ``own`` for the model's own site."""
    rows = _labelled(spark, sf_dir)
    means = [F.round(F.avg(x), 4).alias(name) for name, (x, _) in THRESHOLD_MODELS.items()]
    fitted = rows.groupBy("site").agg(*means).orderBy("site").collect()  # one row per site
    entries = []
    for name, (x, scale) in THRESHOLD_MODELS.items():
        for row in fitted:
            over = F.col(x) - F.lit(row[name])
            positive = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + over / scale)), 6)
            entries.append(
                F.struct(
                    F.lit(name).alias("algorithm"),
                    F.lit(row["site"]).alias("model_site"),
                    F.when(over > 0, 1.0).otherwise(0.0).alias("prediction"),
                    F.round(1 - positive, 6).alias("negative"),
                    positive.alias("positive"),
                )
            )
    long = rows.select("site", "pid", "label", F.explode(F.array(*entries)).alias("e"))
    return long.select("site", "pid", "label", "e.*", (F.col("site") == F.col("e.model_site")).alias("own"))


PRED = (
    f"""readm as ({READMISSION_2_SQL}),
labelled as (
  select pid, site, balance, coalesce(n_enc, 0.0) as n_enc, coalesce(label, 0.0) as label
  from pat left join (select subj, max(value) as label, cast(count(*) as double) as n_enc
                      from readm join enc on enc.enc = encounter group by 1) on subj = pid),
models as (
  select 'by_balance' as algorithm, site as model_site, round(avg(balance), 4) as thr, 10000.0 as scale from labelled group by 2
  union all select 'by_encounters', site, round(avg(n_enc), 4), 20.0 from labelled group by 2),
scored as (
  select site, pid, label, algorithm, model_site, thr, scale,
         case when algorithm = 'by_balance' then balance else n_enc end - thr as over
  from labelled, models),
pred as (
  select site, pid, label, algorithm, model_site, site = model_site as own,
         case when over > 0 then 1.0 else 0.0 end as prediction,
         round(1 - round(least(1.0, greatest(0.0, 0.5 + over / scale)), 6), 6) as negative,
         round(least(1.0, greatest(0.0, 0.5 + over / scale)), 6) as positive
  from scored)"""
)

GROUP = "algorithm, model_site, site"


def _counts(source: str, group: str) -> str:
    group_by = f"group by {group}" if group else ""
    prefix = f"{group}, " if group else ""
    return f"""(select *, cast(tp + tn + fp + fn as bigint) as total from (select {prefix}
      count(*) filter (prediction = 1 and label = 1) as tp, count(*) filter (prediction = 0 and label = 0) as tn,
      count(*) filter (prediction = 1 and label = 0) as fp, count(*) filter (prediction = 0 and label = 1) as fn
      from {source} {group_by}))"""


def div(a: str, b: str, undefined: str = "null") -> str:
    return f"coalesce(cast({a} as double) / nullif({b}, 0), {undefined})"


ACCURACY = div("tp + tn", "total")
PRECISION_1, RECALL_1 = div("tp", "tp + fp", "1.0"), div("tp", "tp + fn", "1.0")
SPECIFICITY_1 = div("tn", "tn + fp", "1.0")
F_1 = f"coalesce(2 * {PRECISION_1} * {RECALL_1} / nullif({PRECISION_1} + {RECALL_1}, 0), 1.0)"

T_PRECISION = f"case when tp + fp = 0 then {div('tp + fn', 'total')} else {div('tp', 'tp + fp')} end"
T_RECALL = f"case when tp + fn = 0 then 0.0 when tp + fp = 0 then 1.0 else {div('tp', 'tp + fn')} end"
T_F = f"2 * ({T_PRECISION}) * ({T_RECALL}) / nullif(({T_PRECISION}) + ({T_RECALL}), 0)"
AUROC = f"""case when tp + fn = 0 then 0.0 when tn + fp = 0 then 1.0
  else (1 + {div('tp', 'tp + fn')} - {div('fp', 'tn + fp')}) / 2 end"""
AUPR = f"""case when tp + fn = 0 then 0.0 when tp + fp = 0 then {div('tp + fn', 'total')}
  else {div('tp', 'tp + fn')} * {div('tp', 'tp + fp')}
    + (1 - {div('tp', 'tp + fn')}) * ({div('tp', 'tp + fp')} + {div('tp + fn', 'total')}) / 2 end"""

PRED_WITH = with_sql(PAT, ENC, PRED)


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) as {name}"


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


BY = ("algorithm", "model_site", "site")


@query("confusion_matrix", PRED_WITH + f"select * from {_counts('pred', GROUP)}")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(predictions(spark, sf_dir), BY)


@query("accuracy", PRED_WITH + f"select {GROUP}, {r6(ACCURACY, 'accuracy')} from {_counts('pred', GROUP)}")
def accuracy(spark, sf_dir):
    counts = evaluate.confusion_matrix(predictions(spark, sf_dir), BY)
    return rounded(counts.select(*BY, evaluate.accuracy().alias("accuracy")), "accuracy")


@query(
    "metrics_by_threshold",
    PRED_WITH
    + f"""select {GROUP}, {r6(T_PRECISION, 'precision')}, {r6(T_RECALL, 'recall')}, {r6(T_F, 'f_measure')}
    from {_counts('pred', GROUP)}""",
)
def metrics_by_threshold(spark, sf_dir):
    counts = evaluate.confusion_matrix(predictions(spark, sf_dir), BY)
    metrics = evaluate.with_threshold_metrics(counts).select(*BY, "precision", "recall", "f_measure")
    return rounded(metrics, "precision", "recall", "f_measure")


@query("auroc", PRED_WITH + f"select {GROUP}, {r6(AUROC, 'auroc')} from {_counts('pred', GROUP)}")
def auroc(spark, sf_dir):
    counts = evaluate.confusion_matrix(predictions(spark, sf_dir), BY)
    return rounded(counts.select(*BY, evaluate.auroc().alias("auroc")), "auroc")


@query("aupr", PRED_WITH + f"select {GROUP}, {r6(AUPR, 'aupr')} from {_counts('pred', GROUP)}")
def aupr(spark, sf_dir):
    counts = evaluate.confusion_matrix(predictions(spark, sf_dir), BY)
    return rounded(counts.select(*BY, evaluate.aupr().alias("aupr")), "aupr")


BINARY = f"""{r6(ACCURACY, 'accuracy')}, {r6(AUROC, 'auroc')}, {r6(AUPR, 'aupr')},
    {r6(T_PRECISION, 'precision')}, {r6(T_RECALL, 'recall')}, {r6(T_F, 'f_measure')}"""
BINARY_COLUMNS = ("accuracy", "auroc", "aupr", "precision", "recall", "f_measure")


@query(
    "binary_statistics",
    PRED_WITH + f"select {GROUP}, tp, tn, fp, fn, total, {BINARY} from {_counts('pred', GROUP)}",
)
def binary_statistics(spark, sf_dir):
    return rounded(evaluate.binary_statistics(predictions(spark, sf_dir), BY), *BINARY_COLUMNS)


@query(
    "multiclass_statistics",
    """with pairs as (select o_orderstatus as status, cast(substr(o_orderpriority, 1, 1) as double) - 1 as label,
        floor(o_totalprice / 100001) as prediction from orders),
    totals as (select status, count(*) as total, sum(cast(label = prediction as integer)) as hits from pairs group by 1),
    labelled as (select status, label as c, count(*) as n, sum(cast(label = prediction as integer)) as tp from pairs group by 1, 2),
    predicted as (select status, prediction as c, count(*) as p from pairs group by 1, 2),
    classes as (select l.status, n, tp, coalesce(p, 0) as p, total, hits,
        coalesce(cast(tp as double) / nullif(coalesce(p, 0), 0), 0) as pre, cast(tp as double) / n as rec,
        cast(coalesce(p, 0) - tp as double) / (total - n) as fpr
      from labelled l left join predicted using (status, c) join totals using (status))
    select status, round(cast(max(hits) as double) / max(total), 6) as accuracy,
      round(sum(pre * n / total), 6) as precision, round(sum(rec * n / total), 6) as recall,
      round(sum(fpr * n / total), 6) as fpr, round(sum(rec * n / total), 6) as tpr,
      round(sum(coalesce(2 * pre * rec / nullif(pre + rec, 0), 0) * n / total), 6) as f_measure
    from classes group by status""",
)
def multiclass_statistics(spark, sf_dir):
    """Priority guessed from the price, by order status."""
    orders = tables.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("status"),
        (F.substring("o_orderpriority", 1, 1).cast("double") - 1).alias("label"),
        F.floor(F.col("o_totalprice") / 100001).cast("double").alias("prediction"),
    )
    statistics = evaluate.multiclass_statistics(orders, ["status"])
    return rounded(statistics, "accuracy", "precision", "recall", "fpr", "tpr", "f_measure")


RATIOS = f"""{r6(PRECISION_1, 'precision')}, {r6(RECALL_1, 'recall')},
    {r6(SPECIFICITY_1, 'specificity')}, {r6(F_1, 'f_measure')}"""
RATIO_COLUMNS = ("precision", "recall", "specificity", "f_measure")


@query(
    "combine_statistics",
    PRED_WITH
    + f"""select algorithm, model_site, tp, tn, fp, fn, total, {r6(ACCURACY, 'accuracy')}, {RATIOS}
    from {_counts('pred', 'algorithm, model_site')}""",
)
def combine_statistics(spark, sf_dir):
    statistics = evaluate.binary_statistics(predictions(spark, sf_dir), BY)
    combined = evaluate.combine_statistics(statistics, ("algorithm", "model_site"))
    return rounded(combined, "accuracy", *RATIO_COLUMNS)


@query(
    "ratio_metrics",
    PRED_WITH
    + f"""select certainty, ever, tp, tn, fp, fn, total, {RATIOS}
    from {_counts("(select *, case when positive >= 0.9 then 'high' when positive <= 0.1 then 'low' else 'middle' end as certainty, label = 1 as ever from pred)", 'certainty, ever')}""",
)
def ratio_metrics(spark, sf_dir):
    """By certainty and true class, so that several denominators are 0."""
    certainty = F.when(F.col("positive") >= 0.9, "high").when(F.col("positive") <= 0.1, "low").otherwise("middle")
    rows = predictions(spark, sf_dir).withColumns({"certainty": certainty, "ever": F.col("label") == 1})
    counts = evaluate.confusion_matrix(rows, ("certainty", "ever"))
    return rounded(evaluate.with_ratio_metrics(counts), *RATIO_COLUMNS)


TRAINING_PRED = f"(select * from pred where {SPLIT_SQL})"
TEST_PRED = f"(select * from pred where not ({SPLIT_SQL}))"


@query(
    "cross_site_validate",
    PRED_WITH
    + f"""select {GROUP}, tp, tn, fp, fn, total, {BINARY}
    from {_counts(f"(select * from {TRAINING_PRED} where not own)", GROUP)}""",
)
def cross_site_validate(spark, sf_dir):
    """Every model on the training split of every other site."""
    rows = predictions(spark, sf_dir).filter(in_training_split(F.col("pid")) & ~F.col("own"))
    return rounded(evaluate.binary_statistics(rows, BY), *BINARY_COLUMNS)


WEIGHTS = f"""combined as (select *, {F_1} as f from {_counts(TRAINING_PRED, 'algorithm, model_site')}),
weights as (
  select algorithm, model_site, f, count(*) over (partition by algorithm) as models,
         case when coalesce(f / nullif(sum(f) over (partition by algorithm), 0), 0) = 0
              then 1.0 / count(*) over (partition by algorithm)
              else f / sum(f) over (partition by algorithm) end as weight
  from combined)"""


def weights(spark, sf_dir, rows=None):
    rows = predictions(spark, sf_dir) if rows is None else rows
    training = rows.filter(in_training_split(F.col("pid")))
    return ensemble.ensemble_weights(evaluate.confusion_matrix(training, BY))


@query(
    "ensemble_weights",
    with_sql(PAT, ENC, PRED, WEIGHTS)
    + f"select algorithm, model_site, {r6('f', 'f_measure')}, {r6('weight', 'weight')}, models from weights",
)
def ensemble_weights(spark, sf_dir):
    result = weights(spark, sf_dir).select("algorithm", "model_site", "f_measure", "weight", "models")
    return rounded(result, "f_measure", "weight")


VOTES = f"""votes as (
  select site, algorithm, pid, label, round(sum(weight * case when prediction = 0 then -1 else 1 end), 9) as wp,
         sum(case when prediction = 0 then cast(-1 as double) else 1 end) as signed,
         round(sum(weight * negative), 9) as neg, round(sum(weight * positive), 9) as pos
  from {TEST_PRED} join weights using (algorithm, model_site)
  group by 1, 2, 3, 4 having count(*) = max(models))"""

VOTES_WITH = with_sql(PAT, ENC, PRED, WEIGHTS, VOTES)


def _test_rows(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return rows.filter(~in_training_split(F.col("pid"))), weights(spark, sf_dir, rows)


@query(
    "weighted_vote",
    VOTES_WITH
    + f"""select site, algorithm, pid, label, {r6('wp', 'weighted_prediction')}, {r6('neg', 'negative')},
    {r6('pos', 'positive')}, cast(case when wp <= 0 then 0 else 1 end as double) as prediction from votes""",
)
def weighted_vote(spark, sf_dir):
    return rounded(
        ensemble.weighted_vote(*_test_rows(spark, sf_dir)), "weighted_prediction", "negative", "positive"
    )


@query(
    "weighted_probability",
    VOTES_WITH
    + f"""select site, algorithm, pid, label, {r6('neg', 'negative')}, {r6('pos', 'positive')},
    cast(case when neg >= pos then 0 else 1 end as double) as prediction from votes""",
)
def weighted_probability(spark, sf_dir):
    return rounded(ensemble.weighted_probability(*_test_rows(spark, sf_dir)), "negative", "positive")


@query(
    "majority_vote",
    VOTES_WITH
    + """select site, algorithm, pid, label, signed as signed_votes,
    cast(case when signed <= 0 then 0 else 1 end as double) as prediction from votes""",
)
def majority_vote(spark, sf_dir):
    return ensemble.majority_vote(*_test_rows(spark, sf_dir))


@query(
    "ensemble_test",
    VOTES_WITH
    + f"""select algorithm, tp, tn, fp, fn, total, {r6(ACCURACY, 'accuracy')}, {RATIOS}
    from {_counts("(select algorithm, label, case when wp <= 0 then 0 else 1 end as prediction from votes)", 'algorithm')}""",
)
def ensemble_test(spark, sf_dir):
    """The ensembles on the held-out rows of each site, then over all sites."""
    voted = ensemble.weighted_vote(*_test_rows(spark, sf_dir))
    per_site = evaluate.binary_statistics(voted, ("algorithm", "site"))
    combined = evaluate.combine_statistics(per_site, ("algorithm",))
    return rounded(combined, "accuracy", *RATIO_COLUMNS)
