import pytest

from cohortweave.spec import CATEGORICAL, Criterion, Featureset, Readmission, SpecError, Variable, sanitize, validate


def test_names_lose_invalid_characters():
    assert sanitize(" number of medications ") == "numberofmedications"
    assert sanitize("a`b*c{d}e[f](g)>h#i+j:k~l'm%n^o&p@q<r?s;t,u\"v!w$x=y|z.") == "abcdefghijklmnopqrstuvwxyz"


@pytest.mark.parametrize(
    ("path", "kind", "rest"),
    [
        ("value:exists", "exists", "exists"),
        ("value:Patient.gender", "value", "Patient.gender"),
        ("value:readmission:30", "readmission", "30"),
        ("value:hospitalization:12", "hospitalization", "12"),
        ("value:mortality:6", "mortality", "6"),
        ("aggr:count", "aggr", "count"),
        ("aggr:exists:count(1) > 2", "aggr_exists", "count(1) > 2"),
    ],
)
def test_path_kinds(path, kind, rest):
    v = Variable("v", "/Encounter", path)
    assert (v.kind, v.expression) == (kind, rest)


def test_readmission_forms():
    assert Readmission.parse("30") == Readmission(30, 2)
    assert Readmission.parse("1:30") == Readmission(30, 1)
    assert Readmission.parse("7:30") == Readmission(30, 2)
    with pytest.raises(SpecError):
        Readmission.parse("soon")


def test_mortality_months_default_to_six():
    assert Variable("v", "/Observation", "value:mortality:soon").months == 6
    assert Variable("v", "/Observation", "value:mortality:9").months == 9
    with pytest.raises(SpecError):
        _ = Variable("v", "/Encounter", "value:hospitalization:soon").months


@pytest.mark.parametrize(
    ("variable", "encounters"),
    [
        (Variable("v", "/Patient", "value:gender"), False),
        (Variable("v", "/Observation", "value:mortality:6"), False),
        (Variable("v", "/Encounter", "value:exists"), True),
        (Variable("v", "/Encounter?type=x", "value:hospitalization:3"), True),
    ],
)
def test_grain(variable, encounters):
    assert Featureset([variable]).encounter_grain is encounters


@pytest.mark.parametrize(
    ("variables", "criteria"),
    [
        ([], []),
        ([Variable("v", "/Patient", "erroneous-path")], []),
        ([Variable("a b", "/Patient", "value:x"), Variable("ab", "/Patient", "value:y")], []),
        ([Variable("pid", "/Patient", "value:x")], []),
        ([Variable("v", "/Patient", "value:exists", CATEGORICAL)], []),
        ([Variable("v", "/Observation", "aggr:count", CATEGORICAL)], []),
        ([Variable("v", "/Observation", "aggr:median:x")], []),
        ([Variable("v", "/Patient", "value:readmission:30")], []),
        ([Variable("v", "/Patient", "value:mortality:6")], []),
        ([Variable("v", "/Patient", "value:x")], [Criterion("/Patient"), Criterion("/Patient?gender=male")]),
        ([Variable("v", "/Patient", "value:x")], [Criterion("/Condition", "value:exists")]),
    ],
)
def test_rejected(variables, criteria):
    with pytest.raises(SpecError):
        validate(Featureset(variables), criteria)
        [c.kind for c in criteria]
