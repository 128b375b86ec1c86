"""Twelve invented patients with a lab value each, some prescriptions, and a few encounters."""

import json

from cohortweave.sources import resources as S

LAB, DRUG, COUNTRY = "lab-glucose", "rx-17", "Norvania"

# number, gender, birth date, lab value, has the prescription
PATIENTS = [
    (1, "female", "1961-02-03", 4, False),
    (2, "male", "1948-11-30", 0, True),
    (3, "male", "1979-08-08", 6, False),
    (4, "female", "1952-05-17", 3, True),
    (5, "female", "1990-01-25", 0, False),
    (6, "male", "1936-09-12", 7, True),
    (7, "female", "1944-04-04", 2, True),
    (8, "male", "1967-12-19", 0, False),
    (9, "male", "1957-10-02", 4, False),
    (10, "female", "1985-03-28", 1, False),
    (11, "male", "1940-07-21", 5, True),
    (12, "female", "1973-06-14", 2, False),
]
#: Completed years on 2022-07-01.
AGES = [61, 73, 42, 70, 32, 85, 78, 54, 64, 37, 81, 49]
WITH_DRUG = [n for n, _, _, _, drug in PATIENTS if drug]


def coded(code):
    return {"coding": [{"code": code}]}


def _resources():
    for n, gender, birth, value, drug in PATIENTS:
        subject = {"reference": f"Patient/p{n}"}
        yield {
            "resourceType": "Patient", "id": f"p{n}", "gender": gender, "birthDate": birth,
            "address": [{"country": COUNTRY}], "identifier": [{"value": f"nr-{n}"}],
        }
        yield {
            "resourceType": "Observation", "id": f"o{n}", "code": coded(LAB), "subject": subject,
            "effectiveDateTime": f"2022-{n:02}-11T07:30:00Z", "valueQuantity": {"value": value},
        }
        if drug:
            yield {
                "resourceType": "MedicationStatement", "id": f"m{n}", "medicationCodeableConcept": coded(DRUG),
                "subject": subject, "context": {"reference": f"Encounter/e{n}"}, "effectiveDateTime": "2022-04-20",
            }
        if n in (3, 9):
            yield {
                "resourceType": "Condition", "id": f"c{n}", "code": coded("dx-5"), "subject": subject,
                "onsetDateTime": "2021-02-02",
            }
    for n, start, end, kind in (
        (2, "2022-04-02T09:00:00Z", "2022-04-09T15:00:00Z", "elective"),
        (6, "2022-04-18T22:00:00Z", "2022-04-25T11:00:00Z", "emergency"),
        (11, "2022-06-03T10:00:00Z", None, None),
    ):
        period = {"start": start, **({"end": end} if end else {})}
        yield {
            "resourceType": "Encounter", "id": f"e{n}", "subject": {"reference": f"Patient/p{n}"}, "period": period,
            "type": [coded(kind)] if kind else [],
        }


def bundles(method="PUT", size=9):
    entries = [
        {"resource": r, "request": {"method": method, "url": f"{r['resourceType']}/{r['id']}"}} for r in _resources()
    ]
    return [
        json.dumps({"resourceType": "Bundle", "entry": entries[i : i + size], "total": len(entries)})
        for i in range(0, len(entries), size)
    ]


def resources(spark):
    df = spark.createDataFrame([(b,) for b in bundles()], "value string")
    return S.resources_from_bundles(S.flatten_bundles(df))
