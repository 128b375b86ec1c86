import json

import pytest

from cohortweave.sources import pages as P


def page(kind, n, last, total, size=2, **more):
    links = [{"relation": "self", "url": f"{kind}?page={n}"}]
    if n < last:
        links.append({"relation": "next", "url": f"{kind}?page={n + 1}"})
    return json.dumps({"resourceType": "Bundle", "link": links, "total": total, "entry": [{"n": i} for i in range(size)]} | more)


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value string").repartition(3)


def outcome(spark, texts):
    chains = P.page_chains(frame(spark, texts))
    problems = {tuple(r) for r in P.chain_problems(chains).collect()}
    return chains, problems, P.sound_bundles(frame(spark, texts), chains).count()


def test_chains_of_any_length(spark):
    texts = [page("a", n, 36, 74) for n in range(37)] + [page("b", 0, 0, 2)] + [page("c", n, 1, 4) for n in range(2)]
    chains, problems, sound = outcome(spark, texts)
    assert problems == set() and sound == 40
    found = {r["page"]: (r["chain"], r["position"]) for r in chains.collect()}
    assert found == {
        f"{k}?page={n}": (f"{k}?page=0", n) for k, m in (("a", 37), ("b", 1), ("c", 2)) for n in range(m)
    }


def test_broken_chains(spark):
    sound = [page("a", n, 2, 6) for n in range(3)]
    gap = [page("b", n, 4, 10) for n in range(5) if n != 2]
    twice = [page("c", n, 1, 4) for n in (0, 1, 1)]
    short = [page("d", n, 1, 5) for n in range(2)]
    unequal = [page("e", 0, 1, 4), page("e", 1, 1, 3)]
    circle = [page("f", 1, 2, 4), json.dumps({"link": [{"relation": "self", "url": "f?page=2"}, {"relation": "next", "url": "f?page=1"}], "entry": []})]
    _, problems, left = outcome(spark, sound + gap + twice + short + unequal + circle)
    assert problems == {
        ("b?page=0", "next page is missing"), ("b?page=0", "total differs"), ("b?page=3", "total differs"),
        ("c?page=0", "page given twice"), ("c?page=0", "total differs"), ("d?page=0", "total differs"),
        ("e?page=0", "total differs"), (None, "pages in a circle"),
    }
    assert left == 3


def test_what_is_no_page(spark):
    single = json.dumps({"entry": [{}, {}], "total": 9})
    empty = page("g", 0, 0, 0, size=0)
    no_total = page("h", 0, 0, None)
    chains, problems, left = outcome(spark, [single, "no json", None, "", empty, no_total])
    assert problems == set() and left == 6
    assert {r["page"] for r in chains.collect()} == {"g?page=0", "h?page=0"}


@pytest.mark.parametrize("texts", [[], [None]])
def test_nothing(spark, texts):
    chains, problems, left = outcome(spark, texts)
    assert chains.collect() == [] and problems == set() and left == len(texts)


def test_no_text_is_parsed_for_its_address_where_nothing_is_left_out(spark):
    bundles = spark.createDataFrame([('{"entry":[],"link":[{"relation":"self","url":"a"}],"total":0}',)], "value string")
    sound = P.sound_bundles(bundles, P.page_chains(bundles))
    assert sound.collect() == bundles.collect()
    assert "from_json" not in sound._jdf.queryExecution().optimizedPlan().toString()
