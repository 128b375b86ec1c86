import pytest

from cohortweave.operators import federation as J


def test_dataset_states(spark):
    rows = [
        ("failed", "error", "selected"), ("failed", "final", None),
        ("chosen", "final", "selected"), ("chosen", "executing", None),
        ("done", "final", None), ("done", "final", "discarded"),
        ("open", "final", None), ("open", None, None),
    ]
    states = J.dataset_state(spark.createDataFrame(rows, "dataset_id string, state string, selection string"))
    assert {r["dataset_id"]: r["state"] for r in states.collect()} == {
        "failed": "error", "chosen": "final", "done": "ready", "open": "executing"
    }


def test_newer_results_replace_whole_rows(spark):
    schema = "d string, site string, state string, error string"
    sources = spark.createDataFrame([("d", "A", "executing", "old"), ("d", "B", "executing", None)], schema)
    results = spark.createDataFrame([("d", "A", "final", None)], schema)
    merged = {tuple(r) for r in J.merge_source_results(sources, results, ["d", "site"]).collect()}
    assert merged == {("d", "A", "final", None), ("d", "B", "executing", None)}


def test_no_selected_site_is_an_error(spark):
    sources = spark.createDataFrame([("A", "discarded"), ("B", None)], "site string, selection string")
    with pytest.raises(ValueError, match="selected"):
        J.selected_sites(sources)


def test_waiting_and_pairs(spark):
    sites = spark.createDataFrame([("m", "A"), ("m", "B"), ("m", "C")], "model_id string, site string")
    received = spark.createDataFrame([("m", "B"), ("m", "B")], "model_id string, site string")
    assert {r["site"] for r in J.waiting_sites(sites, received, ["model_id", "site"]).collect()} == {"A", "C"}
    models = spark.createDataFrame([("m", "lr", "A"), ("m", "lr", "B"), ("n", "lr", "A")], "model_id string, algorithm string, model_site string")
    pairs = {(r["site"], r["model_site"]) for r in J.validation_pairs(sites, models).collect()}
    assert pairs == {("B", "A"), ("C", "A"), ("A", "B"), ("C", "B")}


def test_integrity(spark):
    algorithms = spark.createDataFrame([("m", "lr"), ("m", "dt")], "model_id string, algorithm string")
    models = spark.createDataFrame(
        [("m", "lr", "A"), ("m", "lr", "B"), ("m", "dt", "A"), ("m", "dt", "B")],
        "model_id string, algorithm string, model_site string",
    )
    statistics = spark.createDataFrame(
        [("m", "lr", "A", "B"), ("m", "lr", "B", "A"), ("m", "dt", "A", "B"), ("m", "dt", "B", "A")],
        "model_id string, algorithm string, model_site string, site string",
    )
    assert J.integrity_violations(algorithms, models, statistics).count() == 0
    broken = J.integrity_violations(
        algorithms.union(algorithms.limit(1)),
        models.filter("not (algorithm = 'dt' and model_site = 'B')"),
        statistics.union(statistics.filter("algorithm = 'dt'")).union(
            spark.createDataFrame([("m", "lr", "A", "A")], statistics.schema)
        ),
    )
    assert dict(broken.groupBy("check").count().collect()) == {
        "duplicate algorithm": 1, "site missing from ensemble": 1, "duplicate statistics": 2, "validated at its own site": 1
    }


def test_errors_and_states(spark):
    results = spark.createDataFrame(
        [("m", "B: failed"), ("m", "A: failed"), ("m", None), ("n", None)], "model_id string, error_message string"
    )
    assert [tuple(r) for r in J.error_rollup(results).collect()] == [("m", "error", "A: failed\nB: failed")]
    columns = ["model_id", "selected", "trained", "validated", "tested", "errors", "chosen"]
    rows = [
        ("training", 2, 1, 0, 0, 0, 0), ("validating", 2, 2, 1, 0, 0, 0), ("testing", 2, 2, 2, 1, 0, 0),
        ("ready", 2, 2, 2, 2, 0, 0), ("final", 2, 2, 2, 2, 0, 1), ("error", 2, 2, 2, 2, 1, 1), ("testing", 1, 1, 0, 0, 0, 0),
    ]
    for r in J.model_state(spark.createDataFrame(rows, columns)).collect():
        assert r["state"] == r["model_id"]
