import json

import clinic
import pytest
from pyspark.sql import functions as F

from cohortweave.sources import resources as S
from cohortweave.sources.store import ResourceStore
from cohortweave.spec import SpecError


@pytest.fixture(scope="module")
def resources(spark):
    return clinic.resources(spark)


@pytest.mark.parametrize(
    ("search", "count"),
    [
        ("/Patient", 12),
        ("/Patient?address-country=Norvania", 12),
        ("/Patient?address-country=Norvania&gender=female", 6),
        ("/Patient?identifier=nr-99", 0),
        ("/Patient?birthdate=gt1960-01-01", 6),
        ("/Observation?code=lab-glucose", 12),
        ("/Observation?code:sw=lab,99", 12),
        ("/Observation?code:sw=99", 0),
        ("/Observation?date=gt2022-07-01", 6),
        ("/Observation?subject=Patient/p1,Patient/p2", 2),
        ("/MedicationStatement?code=rx-17,B01", 5),
        ("/MedicationStatement?context=Encounter/e6", 1),
        ("/Encounter?type=emergency", 1),
        ("/Condition", 2),
    ],
)
def test_search(resources, search, count):
    assert S.resource_count(resources, search).first()["total"] == count


@pytest.mark.parametrize("search", ["/Patient?shoe=42", "/Observation?_count=1", "/Observation?code:above=1", "/Shoe"])
def test_unknown_search(resources, search):
    with pytest.raises(SpecError):
        resources.search(search)


def test_pages_cover_everything_once(resources):
    seen = [
        row["id"] for page in (1, 2, 3, 4, 5) for row in S.resource_page(resources, "/Patient", page, 3).collect()
    ]
    assert len(seen) == len(set(seen)) == 12


def test_pages_by_the_last_reference(resources):
    seen, last = [], ""
    while page := [r["id"] for r in S.resource_page(resources, "/Patient", 1, 5, after=last).collect()]:
        seen += page
        last = f"Patient/{page[-1]}"
    assert len(seen) == 12 and seen == sorted(seen)


def test_latest(resources):
    latest = {r["subject"]: r["ref"] for r in S.latest_resource(resources, "/Encounter").collect()}
    assert latest == {f"Patient/p{n}": f"Encounter/e{n}" for n in (2, 6, 11)}


def test_bundle_files(spark, tmp_path):
    for i, text in enumerate(clinic.bundles()):
        (tmp_path / f"{i}.json").write_text(json.dumps(json.loads(text), indent=2))
    entries = S.flatten_bundles(S.read_bundle_files(spark, str(tmp_path)))
    assert dict(entries.groupBy("kind").count().collect()) == {
        "Patient": 12, "Observation": 12, "MedicationStatement": 5, "Encounter": 3, "Condition": 2
    }
    assert entries.filter("method <> 'PUT'").count() == 0


def test_bundles_without_use_are_reported(spark):
    def bundle(*entries):
        return json.dumps({"resourceType": "Bundle", "entry": [{"resource": r, "request": {"method": m}} for r, m in entries]})

    good, other = {"resourceType": "Patient", "id": "a"}, {"resourceType": "Patient", "id": "b"}
    texts = [
        bundle((good, "PUT"), (other, "DELETE"), ({"resourceType": "Patient"}, "PUT")),
        bundle(({"resourceType": "Spaceship", "id": "c"}, "PUT")),
        "{not a bundle",
        "{}",
    ]
    bundles = spark.createDataFrame([(t,) for t in texts], "value string")
    tables = S.resources_from_bundles(S.flatten_bundles(bundles))
    assert [r["id"] for r in tables["Patient"].rows.collect()] == ["a"]
    reasons = sorted(r["reason"] for r in S.bundle_rejects(bundles).collect())
    assert reasons == ["no id", "not a bundle", "not a bundle", "unknown kind of resource"]


def test_malformed_lines_are_set_aside(spark, tmp_path):
    good = {"resourceType": "Patient", "id": "p1", "gender": "male"}
    (tmp_path / "p.ndjson").write_text(json.dumps(good) + "\n{not json\n" + json.dumps({"gender": "x"}) + "\n")
    table, rejects = S.read_resource_lines(spark, str(tmp_path), "Patient")
    assert [r["id"] for r in table.search("/Patient?gender=male").collect()] == ["p1"]
    assert rejects.count() == 2


def test_upsert(spark):
    store = spark.createDataFrame([("a", 1, 10), ("b", 1, 20), ("c", 1, 30)], "id string, version int, x int")
    batch = spark.createDataFrame(
        [("a", 2, 11, "PUT"), ("a", 3, 12, "PUT"), ("b", 2, 0, "DELETE"), ("d", 1, 40, "PUT"),
         ("e", 1, 50, "PUT"), ("e", 1, 50, "DELETE"), ("f", 1, 1, "DELETE"), ("f", 2, 60, "PUT"),
         ("c", 1, 30, "DELETE")],
        "id string, version int, x int, method string",
    )
    state = {r["id"]: r["x"] for r in S.upsert(store, batch, "id", "version").collect()}
    assert state == {"a": 12, "d": 40, "f": 60}


def test_upsert_and_delete_of_a_bundle(spark):
    def batch(method):
        df = spark.createDataFrame([(b,) for b in clinic.bundles(method)], "value string")
        return S.flatten_bundles(df).select(
            F.col("url").alias("id"), "resource", F.lit(1 if method == "PUT" else 2).alias("version"), "method"
        )

    empty = batch("PUT").drop("method").limit(0)
    stored = S.upsert(empty, batch("PUT"), "id", "version")
    assert stored.count() == 34
    assert S.upsert(stored, batch("DELETE"), "id", "version").count() == 0


def test_upsert_has_a_total_order(spark):
    rows = [("a", 1, 5, "PUT"), ("a", 1, 6, "PUT"), ("b", 2, None, "PUT"), ("b", 2, 1, "PUT"), ("c", 1, 9, "PUT"),
            ("d", 1, 1, "PUT"), ("d", 1, 2, "DELETE"), (None, 1, 1, "PUT"), ("e", None, 1, "PUT"), ("e", 0, 0, "PUT")]
    store = spark.createDataFrame([("c", 1, 99), ("f", 1, 7)], "id string, version int, x int")
    for order in (rows, rows[::-1]):
        for parts in (1, 5):
            batch = spark.createDataFrame(order, "id string, version int, x int, method string").repartition(parts)
            state = {r["id"]: r["x"] for r in S.upsert(store.repartition(parts), batch, "id", "version").collect()}
            # Of one version the batch comes after the store, and the larger row after the smaller.
            assert state == {"a": 6, "b": 1, "c": 9, "e": 0, "f": 7}


def files_below(folder):
    return {p: (p.stat().st_mtime_ns, p.stat().st_size) for p in folder.rglob("*.parquet") if p.is_file()}


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    schema = "id string, version int, x int, method string"
    store = ResourceStore(spark, str(tmp_path), "id", "version", buckets=8)
    assert store.read() is None
    store.apply(spark.createDataFrame([(f"k{i}", 1, i, "PUT") for i in range(100)], schema))
    before = files_below(tmp_path / "rows")
    assert len(before) == 8
    store.apply(spark.createDataFrame([("k7", 2, 70, "PUT"), ("k7", 3, 0, "DELETE"), ("new", 1, 1, "PUT")], schema))
    after = files_below(tmp_path / "rows")
    assert {p: after[p] for p in before} == before and 1 <= len(after) - len(before) <= 2
    state = {r["id"]: r["x"] for r in store.read().collect()}
    assert state == {**{f"k{i}": i for i in range(100) if i != 7}, "new": 1}
    assert store.read().columns == ["id", "version", "x"]
    # An older PUT that comes late does not bring a deleted key back; a newer one does.
    store.apply(spark.createDataFrame([("k7", 2, 71, "PUT")], schema))
    assert store.read().filter("id = 'k7'").count() == 0
    store.apply(spark.createDataFrame([("k7", 4, 72, "PUT"), (None, 1, 1, "PUT")], schema))
    assert store.read().filter("id = 'k7'").first()["x"] == 72
    store.apply(spark.createDataFrame([], schema))
    assert store.read().count() == 101


def test_a_failed_batch_leaves_the_store_and_can_be_repeated(spark, tmp_path):
    schema = "id string, version int, x int, method string"
    store = ResourceStore(spark, str(tmp_path), "id", "version", buckets=4)
    store.apply(spark.createDataFrame([("a", 1, 1, "PUT")], schema))
    batch = spark.createDataFrame([("a", 2, 2, "PUT"), ("b", 1, 3, "PUT")], schema)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        store.apply(batch.withColumn("x", F.concat("id", F.lit("?")).cast("int")))
    assert [tuple(r) for r in store.read().collect()] == [("a", 1, 1)]
    store.apply(batch)
    assert sorted(tuple(r) for r in store.read().collect()) == [("a", 2, 2), ("b", 1, 3)]


def test_resources_parsed_with_their_bundle_are_those_of_the_text(spark):
    """Also where a field, an entry or a bundle is not what it should be; and each text is parsed once."""
    def entry(resource, method="PUT"):
        return {"resource": resource, "request": {"method": method, "url": f"{resource.get('resourceType')}/x" if isinstance(resource, dict) else None}}

    good = {"resourceType": "Observation", "id": "o", "code": {"coding": [{"code": "age"}]}, "valueQuantity": {"value": 7}}
    odd = [
        {"resourceType": "Observation", "id": "bad value", "valueQuantity": {"value": "much"}, "status": "final"},
        {"resourceType": "Patient", "id": "other's field", "valueQuantity": 3, "gender": "male"},
        {"resourceType": "Observation", "id": 5, "status": 6}, {"resourceType": "Patient"}, {"resourceType": "Spaceship", "id": "s"}, {"id": "no kind"}, "text", None,
    ]
    texts = [json.dumps({"entry": [entry(good), entry(r), entry({"resourceType": "Patient", "id": "p", "address": [{"country": "N"}]}), entry(good, "DELETE")]}) for r in odd]
    texts += ["{not a bundle", "{}", "", None, json.dumps({"entry": [None, entry(good)]}), json.dumps({"entry": [7, entry(good)]}), json.dumps({"entry": entry(good)})]
    bundles = spark.createDataFrame([(t,) for t in texts + clinic.bundles("PUT")], "value string")
    text, parsed = S.flatten_bundles(bundles), S.flatten_bundles(bundles, parsed=True)
    assert parsed.columns == [*text.columns, "fields"]
    told = lambda df: sorted(map(repr, df.select("kind", "method", "url").collect()))
    assert told(text) == told(parsed)
    whole = parsed.filter("fields is not null")
    assert whole.count() > 34 and whole.filter("resource is not null").isEmpty() and not parsed.filter("resource is not null").isEmpty()
    before, now = S.resources_from_bundles(text), S.resources_from_bundles(parsed)
    assert before.keys() == now.keys()
    for name in before:
        assert before[name].df.schema.simpleString() == now[name].df.schema.simpleString()
        assert sorted(map(repr, before[name].df.collect())) == sorted(map(repr, now[name].df.collect())), name
