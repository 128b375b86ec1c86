"""Every order takes part in the bookkeeping queries."""

from workload import bookkeeping as B


def test_every_order_belongs_to_a_run_that_has_sources(spark, sf_dir):
    sources, results = B._sources(spark, sf_dir), B._results(spark, sf_dir)
    n = B.table(spark, sf_dir, "orders").count()
    runs = sources.select("model_id").distinct()
    assert results.join(runs, "model_id", "left_semi").count() == results.count() == n
    # So each one counts for its run and site, and some sites have none.
    assert results.join(sources, ["model_id", "site"], "left_semi").count() == n
    assert sources.join(results, ["model_id", "site"], "left_anti").count() > 0


def test_bookkeeping_queries_show_their_variety(spark, sf_dir):
    from workload import QUERIES

    merged = QUERIES["merge_source_results"](spark, sf_dir)
    assert {r["state"] for r in merged.select("state").distinct().collect()} >= {"final", "error"}
    states = {r["state"] for r in QUERIES["model_state_rollup"](spark, sf_dir).select("state").distinct().collect()}
    assert len(states) >= 3
    assert QUERIES["waiting_sites"](spark, sf_dir).count() > 0
    assert QUERIES["validation_pairs"](spark, sf_dir).count() > 0
