import json

from pyspark.sql import functions as F

from cohortweave.sources import pages as P
from cohortweave.sources import resources as S
from workload import bundles as B


def test_rows_are_gathered_by_page_before_they_become_text(spark):
    rows = spark.createDataFrame([("1", 1), ("1", 1), ("25", 25), (None, None)], "id string, number long").repartition(3)
    searches = {"Patient": lambda r: [B._entry("Patient", r["id"])], "Patient?twice": lambda r: [B._entry("Patient", r["id"], "DELETE"), B._entry("Patient", None)]}
    filled = B._filled(rows, F.col("number"), searches)
    found = {(r["search"], r["page"]): (json.loads(r["entries"]), r["n"]) for r in filled.collect()}
    assert {key: n for key, (_, n) in found.items()} == {
        (search, page): n * k for search, k in (("Patient", 1), ("Patient?twice", 2)) for page, n in ((0, 2), (1, 1), (None, 1))
    }
    entries = {key: e for key, (e, _) in found.items()}
    assert entries["Patient", 0] == [{"resource": {"resourceType": "Patient", "id": "1"}, "request": {"method": "PUT", "url": "Patient/1"}}] * 2
    assert entries["Patient?twice", 1][1] == {"resource": {"resourceType": "Patient"}, "request": {"method": "PUT", "url": "Patient/"}}
    plan = filled._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Aggregate")  # text is made above the only one
    assert "tojson" in above.lower().replace("_", "") and "tojson" not in below.lower().replace("_", "")


def test_entries_that_are_no_objects_are_counted(spark):
    link = '"link":[{"relation":"self","url":"%s"}]'
    texts = ['{"entry":["x",[1],{"a":1},null],%s}' % (link % "a"), '{"entry":[{"a":1},{"request":7}],%s}' % (link % "b"), '{"entry":[],%s}' % (link % "c")]
    chains = P.page_chains(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert {r["page"]: r["entries"] for r in chains.collect()} == {"a": 4, "b": 2, "c": 0}


def test_rejects_come_from_one_pass(spark):
    patient = {"resourceType": "Patient", "id": "a"}
    sound = json.dumps({"entry": [{"resource": patient}, {"resource": {"id": 1}, "request": {"method": "DELETE"}}]})
    odd = json.dumps({"entry": [{"resource": "Patient"}, {"resource": patient, "request": 3}, {"resource": {"resourceType": "Patient"}}]})
    rejects = S.bundle_rejects(spark.createDataFrame([(t,) for t in (sound, odd, "no json", None)], "value string"))
    assert sorted((r["reason"], r["line"]) for r in rejects.collect() if r["line"]) == [
        ("no id", '{"resourceType":"Patient"}'), ("not a bundle", "no json"), ("unknown kind of resource", "Patient"),
    ]
    assert rejects.count() == 4  # a bundle that is null has no line
    assert rejects._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
