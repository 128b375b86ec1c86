import datetime as dt

import clinic
import pytest
from pyspark.sql import functions as F

from cohortweave.operators import cohort as C
from cohortweave.operators.features import known_columns, prepare_features
from cohortweave.plans.prepare import FAILURES, prepare_dataset
from cohortweave.sources.resources import Resources, nested_table, with_rows
from cohortweave.sources.store import DatasetStore
from cohortweave.spec import CATEGORICAL, DEPENDENT, Criterion, Featureset, SpecError, Variable, from_request

AS_OF = "timestamp'2022-07-01'"
AGE = f"value:floor(months_between({AS_OF}, to_date(Patient.birthDate)) / 12)"

CLINIC = Featureset(
    (
        Variable("sex", "/Patient", "value:Patient.gender", CATEGORICAL),
        Variable("years", "/Patient", AGE),
        Variable("glucose level", f"/Observation?code={clinic.LAB}", "value:Observation.valueQuantity.value"),
        Variable("prescribed", f"/MedicationStatement?code={clinic.DRUG}", "value:exists", role=DEPENDENT),
    )
)
IN_COUNTRY = [Criterion(f"/Patient?address-country={clinic.COUNTRY}")]
AGES = clinic.AGES


@pytest.fixture(scope="module")
def resources(spark):
    return clinic.resources(spark)


def as_of():
    return F.expr(AS_OF)


def rows(df):
    return {r["pid"]: tuple(r)[1:] for r in df.collect()}


def test_golden_dataset(resources):
    dataset = prepare_features(resources, CLINIC, IN_COUNTRY)
    assert dataset.schema.simpleString() == (
        "struct<pid:string,sex:string,years:double,glucoselevel:double,prescribed:double>"
    )
    assert rows(dataset) == {
        f"Patient/p{n}": (gender, float(AGES[n - 1]), float(value), float(drug))
        for n, gender, _, value, drug in clinic.PATIENTS
    }


def test_three_way_default(spark, resources):
    """Nothing found, found but empty, and a value."""
    observations = spark.createDataFrame(
        [("1", ("Patient/p1",), (None,), "2020-01-01"), ("2", ("Patient/p2",), (7.0,), "2020-01-02"),
         ("3", ("Patient/p2",), (8.0,), "2020-01-01")],
        "id string, subject struct<reference string>, valueQuantity struct<value double>, effectiveDateTime string",
    ).withColumn("code", F.expr("named_struct('coding', array(named_struct('code', 'x')))"))
    changed = Resources(resources)
    changed["Observation"] = nested_table("Observation", observations)
    numeric = Variable("n", "/Observation?code=x", "value:valueQuantity.value")
    text = Variable("t", "/Observation?code=x", "value:cast(valueQuantity.value as string)", CATEGORICAL)
    result = rows(prepare_features(changed, Featureset((numeric, text))))
    assert result["Patient/p1"] == (None, None)
    assert result["Patient/p2"] == (8.0, "8.0")  # the earliest
    assert result["Patient/p3"] == (0.0, None)


def test_criteria_are_anded(resources):
    criteria = [
        Criterion("/Patient", "satisfy:gender = 'male'"),
        Criterion(f"/MedicationStatement?code={clinic.DRUG}"),
        Criterion("/Observation", "satisfy:valueQuantity.value >= 1"),
        Criterion("/Observation", "aggr:max(valueQuantity.value) > 5"),
        Criterion("/Encounter?type=emergency"),
    ]
    assert [r["pid"] for r in C.eligible_patients(resources, criteria).collect()] == ["Patient/p6"]


def test_predicate_that_gives_null_is_false(resources):
    kept = C.satisfying(resources["Patient"].rows, "try_cast(gender as int) > 0")
    assert kept.count() == 0


def test_malformed_values_are_false_in_predicates_and_null_in_paths(spark, resources):
    assert C.satisfying(resources["Patient"].rows, "cast(gender as int) > 0").count() == 0
    assert C.satisfying(resources["Patient"].rows, "cast(substr(id, 2) as int) > 10 or cast(gender as int) > 0").count() == 2
    criteria = [Criterion("/Patient", "satisfy:cast(gender as int) is null and cast(substr(id, 2) as int) < 3")]
    path = "value:cast(if(id = 'p1', gender, substr(id, 2)) as int)"
    made = prepare_features(resources, Featureset((Variable("n", "/Patient", path),)), criteria)
    assert rows(made) == {"Patient/p1": (None,), "Patient/p2": (2.0,)}
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_encounter_criterion_with_a_predicate(resources):
    featureset = Featureset((ENCOUNTERS.variables[0],))
    criteria = [Criterion("/Encounter", "satisfy:id <> 'e6'"), Criterion("/Encounter", "satisfy:cast(id as int) is null")]
    assert set(rows(prepare_features(resources, featureset, criteria, as_of()))) == {"Encounter/e2", "Encounter/e11"}


def test_encounter_items_fill_open_periods(resources):
    table = resources["Encounter"]
    items = C.encounter_items(table, table.rows, as_of())
    found = {r["encounter"]: (r["end"], r["type"]) for r in items.collect()}
    assert found["Encounter/e11"] == (dt.datetime(2022, 7, 1), None)
    assert found["Encounter/e2"] == (dt.datetime(2022, 4, 9, 15), "elective")


ENCOUNTERS = Featureset(
    (
        Variable("kind", "/Encounter", "value:get(get(type, 0).coding, 0).code", CATEGORICAL),
        Variable("gender", "/Patient", "value:gender", CATEGORICAL),
        Variable("prescribed", f"/MedicationStatement?code={clinic.DRUG}", "value:exists"),
        Variable("statement", "/MedicationStatement", "value:id", CATEGORICAL),
        Variable("statements", "/MedicationStatement", "aggr:count"),
        Variable("statements here", "/MedicationStatement", "aggr:count", group_by="encounter"),
        Variable("deceased", f"/Observation?code={clinic.LAB}", "value:mortality:1"),
    )
)


def test_encounter_grain(resources):
    result = rows(prepare_features(resources, ENCOUNTERS, (), as_of()))
    # The statements are dated 2022-04-20: after the end of e2, before those of e6 and e11. Only the
    # stay of p2 begins later than a month before the patient's lab value.
    assert result == {
        "Encounter/e2": ("elective", "male", 0.0, "m2", 1.0, 1.0, 1.0),
        "Encounter/e6": ("emergency", "male", 1.0, "m6", 1.0, 1.0, 0.0),
        "Encounter/e11": (None, "male", 1.0, "m11", 1.0, 1.0, 0.0),
    }


def test_encounter_criteria_choose_encounters(resources):
    featureset = Featureset((ENCOUNTERS.variables[0],))
    criteria = [Criterion("/Encounter?type=emergency"), Criterion("/Patient?gender=male")]
    assert rows(prepare_features(resources, featureset, criteria, as_of())) == {"Encounter/e6": ("emergency",)}
    patients = C.eligible_patients(resources, criteria)
    assert patients.count() == 6


def test_undated_resource_exists_at_every_encounter(resources):
    changed = Resources(resources)
    table = resources["MedicationStatement"]
    undated = table.df.withColumn("effectiveDateTime", F.lit(None).cast("string"))
    changed["MedicationStatement"] = with_rows(table, undated)
    result = rows(prepare_features(changed, ENCOUNTERS, (), as_of()))
    assert [result[f"Encounter/e{n}"][2] for n in (2, 6, 11)] == [1.0, 1.0, 1.0]


def test_encounter_grain_needs_as_of(resources):
    with pytest.raises(ValueError, match="as_of"):
        prepare_features(resources, ENCOUNTERS)


def test_request_document(resources):
    def variable(name, query, path, kind="numeric", role="independent"):
        return {
            "name": name, "fhir_query": query, "fhir_path": path, "variable_data_type": kind, "variable_type": role
        }

    request = {
        "featureset": {
            "variables": [
                variable("sex", "/Patient", "value:Patient.gender", "categorical"),
                variable("statements", "/MedicationStatement", "aggr:groupBy(MedicationStatement.subject.reference,count())"),
                variable("most", f"/Observation?code={clinic.LAB}", "aggr:groupBy(Observation.subject.reference, max(valueQuantity.value))"),
                variable("prescribed", f"/MedicationStatement?code={clinic.DRUG}", "value:exists", role="dependent"),
            ]
        },
        "eligibility_criteria": [
            {"fhir_query": f"/Patient?address-country={clinic.COUNTRY}"},
            {"fhir_query": "/Observation", "fhir_path": "satisfy:valueQuantity.value > 4"},
        ],
    }
    featureset, criteria = from_request(request)
    assert featureset.dependent.column == "prescribed"
    assert rows(prepare_features(resources, featureset, criteria)) == {
        "Patient/p3": ("male", 0.0, 6.0, 0.0),
        "Patient/p6": ("male", 1.0, 7.0, 1.0),
        "Patient/p11": ("male", 1.0, 5.0, 1.0),
    }
    by_encounter = Variable("n", "/MedicationStatement", "aggr:groupBy(MedicationStatement.context.reference,count())")
    wide = prepare_features(resources, Featureset((ENCOUNTERS.variables[0], by_encounter)), (), as_of())
    assert {pid: r[1] for pid, r in rows(wide).items()} == {"Encounter/e2": 1.0, "Encounter/e6": 1.0, "Encounter/e11": 1.0}


def test_known_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert known_columns(df, ["b", "nowhere"]).columns == ["b"]
    with pytest.raises(ValueError, match="none of the requested"):
        known_columns(df, ["x"])


def test_prepare_stores_dataset_and_statistics(spark, resources, tmp_path):
    store = DatasetStore(spark, str(tmp_path))
    first = prepare_dataset(spark, resources, CLINIC, IN_COUNTRY, store, "d1")
    assert first.dataset.count() == 12
    ages = first.statistics.filter("variable = 'years'").first()
    assert (ages["records"], ages["nulls"], ages["min"], ages["max"]) == (12, 0, 32.0, 85.0)
    # A dataset that is there already is not prepared again.
    again = prepare_dataset(spark, Resources(), CLINIC, IN_COUNTRY, store, "d1")
    assert again.dataset.count() == 12


def test_empty_cohort_gives_an_empty_dataset(spark, resources, tmp_path):
    store = DatasetStore(spark, str(tmp_path))
    nobody = [Criterion("/Patient?identifier=nr-99")]
    prepared = prepare_dataset(spark, resources, CLINIC, nobody, store, "none")
    assert prepared.dataset.count() == 0
    assert {r["records"] for r in prepared.statistics.collect()} == {0}
    assert {r["null_percentage"] for r in prepared.statistics.collect()} == {None}


def test_failure_is_stored_and_the_next_call_prepares_anew(spark, resources, tmp_path):
    store = DatasetStore(spark, str(tmp_path))
    # Fails while the table is written: raise_error is evaluated by a task.
    broken = Featureset((Variable("x", "/Patient", "value:if(id = 'p3', raise_error('broken'), 1)"),))
    for _ in range(2):
        with pytest.raises(Exception, match="broken"):
            prepare_dataset(spark, resources, broken, [], store, "d")
        assert "broken" in store.document(FAILURES, "d", "exception string").first()["exception"]
        assert store.dataset("d") is None
    right = prepare_dataset(spark, resources, CLINIC, IN_COUNTRY, store, "d")
    assert right.dataset.count() == 12
    assert {r["variable"] for r in right.statistics.collect()} == {"sex", "years", "glucoselevel", "prescribed"}


def test_failure_before_any_job(spark, resources, tmp_path):
    store = DatasetStore(spark, str(tmp_path))
    broken = Featureset((Variable("x", "/Patient", "value:no_such_column"),))
    with pytest.raises(Exception, match="no_such_column"):
        prepare_dataset(spark, resources, broken, [], store, "broken")
    assert "no_such_column" in store.document(FAILURES, "broken", "exception string").first()["exception"]
    with pytest.raises(SpecError):
        prepare_dataset(spark, resources, Featureset(()), [], store, "empty")
