from collections import Counter
from itertools import combinations

import clinic
import pytest
from pyspark.sql import functions as F

from cohortweave.operators import rules as R
from cohortweave.operators.encode import items_array
from cohortweave.plans.association import federated_rules


def site_of(n):
    return "A" if n <= 6 else "B"


@pytest.fixture(scope="module")
def patients(spark):
    rows = [
        (site_of(n), f"p{n}", sex, float(clinic.AGES[n - 1]), float(value), float(drug))
        for n, sex, _, value, drug in clinic.PATIENTS
    ]
    return spark.createDataFrame(
        rows, "site string, pid string, sex string, age double, glucoselevel double, prescribed double"
    ).cache()


def items_of(n, sex, value, drug):
    age = clinic.AGES[n - 1]
    band = "age_80+" if age >= 80 else f"age_{age // 10 * 10}-{age // 10 * 10 + 10}"
    return {f"sex_{sex}", band} | ({"glucoselevel"} if value else set()) | ({"prescribed"} if drug else set())


TRANSACTIONS = [(site_of(n), items_of(n, sex, value, drug)) for n, sex, _, value, drug in clinic.PATIENTS]


def brute_itemsets(transactions, items, least=lambda site: 1):
    """(site, itemset) -> count, of every set that reaches the bound of some site."""
    counts = Counter()
    for site, own in transactions:
        own = sorted(own & items)
        for size in range(1, len(own) + 1):
            counts.update((site, c) for c in combinations(own, size))
    found = {c for (site, c), n in counts.items() if n >= least(site)}
    return {(s, c): n for (s, c), n in counts.items() if c in found}


def brute_rules(transactions, items, confidence, least=lambda site: 1):
    """Rules of each site, and the merged ones with confidence and lift."""
    counts = brute_itemsets(transactions, items, least)
    records = Counter(site for site, _ in transactions)
    total = Counter()
    for (_, c), n in counts.items():
        total[c] += n
    rules = {}
    for (site, c), n in counts.items():
        for y in c if len(c) > 1 and n >= least(site) else ():
            x = tuple(i for i in c if i != y)
            if n / counts[site, x] >= confidence:
                rules[site, x, y] = (n / counts[site, x], n / counts[site, x] / (counts[site, (y,)] / records[site]))
    merged = {}
    for _, x, y in rules:
        both = total[tuple(sorted((*x, y)))] / total[x]
        merged[x, y] = (both, both / (total[y,] / sum(records.values())))
    return rules, merged


def as_rules(df):
    return {
        (tuple(r["antecedent"]), r["consequent"][0]): (pytest.approx(r["confidence"]), pytest.approx(r["lift"]))
        for r in df.collect()
    }


@pytest.fixture(scope="module")
def mined(patients):
    return federated_rules(patients)


def frequent_of(transactions, support):
    counts = Counter(i for _, own in transactions for i in own)
    return {i: n for i, n in counts.items() if n / len(transactions) >= support}


def test_item_frequencies(mined):
    expected = Counter((site, i) for site, own in TRANSACTIONS for i in own)
    assert {(r["site"], r["item"]): r["freq"] for r in mined.frequencies.collect()} == expected


def test_frequent_items(mined):
    assert {r["item"]: r["freq"] for r in mined.frequent_items.collect()} == frequent_of(TRANSACTIONS, 0.3)


@pytest.mark.parametrize("local", [0.0, 0.3, 0.5])
def test_itemsets_and_rules(patients, local):
    mined = federated_rules(patients, min_support=0.1, local_support=local)
    items = set(frequent_of(TRANSACTIONS, 0.1))
    bound = lambda site: max(1, -(-6 * local // 1))
    sets = brute_itemsets(TRANSACTIONS, items, bound)
    assert {(r["site"], tuple(r["items"])): r["freq"] for r in mined.itemsets.collect()} == sets
    assert all(r["local"] == (r["freq"] >= bound(r["site"])) for r in mined.itemsets.collect())
    rules, merged = brute_rules(TRANSACTIONS, items, 0.8, bound)
    assert len(rules) == mined.site_rules.count()
    assert as_rules(mined.rules) == merged


def test_counts_below_a_local_bound_are_merged(spark):
    """y in 8 and 3 of 10 records: the merged confidence of x -> y is 0.55 at any local support."""
    rows = [(s, f"{s}{k}", 1.0, float(k < n)) for s, n in (("A", 8), ("B", 3)) for k in range(10)]
    df = spark.createDataFrame(rows, "site string, pid string, x double, y double")
    for local in (0.0, 0.5):
        found = as_rules(federated_rules(df, 0.1, 0.8, local).rules)
        assert found[("x",), "y"][0] == 0.55


def test_any_number_of_items_at_default_settings(spark):
    rows = [("A" if i % 2 else "B", f"p{i}", *[float((i * j) % 5 > 1) for j in range(1, 17)]) for i in range(40)]
    names = [f"v{j:02}" for j in range(1, 17)]
    df = spark.createDataFrame(rows, "site string, pid string, " + ", ".join(f"{n} double" for n in names))
    mined = federated_rules(df)
    transactions = [(r[0], {n for n, x in zip(names, r[2:], strict=True) if x}) for r in rows]
    frequent = set(frequent_of(transactions, 0.3))
    assert len(frequent) >= 12
    _, merged = brute_rules(transactions, frequent, 0.8)
    assert as_rules(mined.rules) == merged


def test_one_site_keeps_its_own_figures(patients):
    alone = federated_rules(patients.filter("site = 'A'"))
    assert alone.rules.columns == ["antecedent", "consequent", "confidence", "lift"]
    assert alone.rules.filter("confidence < 0.8").count() == 0
    assert alone.rules.count() == alone.site_rules.count()


def test_counts_and_rules_agree_with_fp_growth(patients):
    transactions = items_array(patients, keep=("site", "pid"))
    names = ["age_80+", "glucoselevel", "sex_male", "sex_female", "prescribed"]
    items = patients.sparkSession.createDataFrame([(n,) for n in names], "item string")
    kept = R.keep_items(transactions, items)

    def as_set(df):
        return {(r["site"], tuple(r["items"]), r["freq"]) for r in df.select("site", "items", "freq").collect()}

    counted = R.frequent_itemsets(transactions, items)
    assert as_set(counted) == as_set(R.fp_growth_itemsets(kept, ["A", "B"]))

    model = R.fp_growth(kept.filter("site = 'A'"))
    theirs = {
        (tuple(sorted(r["antecedent"])), tuple(r["consequent"]), round(r["confidence"], 9), round(r["lift"], 9))
        for r in model.associationRules.collect()
    }
    ours = R.association_rules(counted, R.record_counts(kept)).filter("site = 'A'")
    assert theirs == {
        (tuple(r["antecedent"]), tuple(r["consequent"]), round(r["confidence"], 9), round(r["lift"], 9))
        for r in ours.collect()
    }


def test_rows_without_items_count_as_records(spark):
    rows = [("A", "p1", ["x"]), ("A", "p2", []), ("A", "p3", ["y"])]
    transactions = spark.createDataFrame(rows, "site string, pid string, items array<string>")
    items = spark.createDataFrame([("x",)], "item string")
    assert R.record_counts(R.keep_items(transactions, items)).first()["records"] == 3
    assert [(r["items"], r["freq"]) for r in R.frequent_itemsets(transactions, items).collect()] == [(["x"], 1)]
    none = items.limit(0)
    assert R.frequent_itemsets(transactions, none).collect() == []


def test_item_order_does_not_matter(spark):
    itemsets = spark.createDataFrame([("A", ["b", "a"], 2), ("B", ["a", "b"], 3)], "site string, items array<string>, freq long")
    assert [(r["items"], r["freq"]) for r in R.merge_itemset_counts(itemsets).collect()] == [(["a", "b"], 5)]
    rules = spark.createDataFrame([(["b", "a"], ["c"]), (["a", "b"], ["c"])], "antecedent array<string>, consequent array<string>")
    assert R.merge_rules(rules).count() == 1


def test_items_may_hold_any_character(spark):
    rows = [("A", "p1", ["a|b", "c"]), ("A", "p2", ["a", "b|c"]), ("A", "p3", ["a", "b|c"])]
    transactions = spark.createDataFrame(rows, "site string, pid string, items array<string>")
    items = transactions.select(F.explode("items").alias("item")).distinct()
    itemsets = R.frequent_itemsets(transactions, items)
    rules = R.association_rules(itemsets, R.record_counts(transactions), 0.5)
    assert {(r["antecedent"][0], r["consequent"][0], r["confidence"]) for r in rules.collect()} == {
        ("a|b", "c", 1.0), ("c", "a|b", 1.0), ("a", "b|c", 1.0), ("b|c", "a", 1.0)
    }


def test_many_items_in_a_row_do_not_become_subsets(spark, monkeypatch):
    """25 items per row: words and counts grow with items and candidates, not with 2^25."""
    rows = [(("A", "B")[i % 2], f"p{i}", [f"i{(7 * i + 11 * j + i * j) % 55:02}" for j in range(25)]) for i in range(300)]
    transactions = spark.createDataFrame(rows, "site string, pid string, items array<string>")
    own = [(site, set(i)) for site, _, i in rows]
    frequent = frequent_of(own, 0.3)
    assert len(frequent) > 20
    items = spark.createDataFrame([(i,) for i in frequent], "item string")
    bound = lambda site: -(-150 * 0.3 // 1)
    found = {}
    level = {(i,) for i in frequent}
    while level:
        counts = Counter((s, c) for s, t in own for c in level if t.issuperset(c))
        kept = {c for (s, c), n in counts.items() if n >= bound(s)}
        found |= {(s, c): n for (s, c), n in counts.items() if c in kept}
        level = {tuple(sorted({*a, *b})) for a in kept for b in kept if a[:-1] == b[:-1] and a < b}
    for most in (R.CANDIDATES, 50):
        monkeypatch.setattr(R, "CANDIDATES", most)
        mined = R.frequent_itemsets(transactions, items, 0.3).collect()
        assert {(r["site"], tuple(r["items"])): r["freq"] for r in mined} == found
    numbers = R.item_numbers(items)
    words = R.vertical_words(transactions, numbers, len(frequent))
    assert words.count() <= 2 * (300 // 64 + 2 * transactions.rdd.getNumPartitions())
    bits = words.agg(F.sum(F.aggregate("bits", F.lit(0).cast("long"), lambda n, b: n + F.bit_count(b)))).first()[0]
    assert bits == sum(len(t & set(frequent)) for _, t in own)


def test_null_and_repeated_items(spark):
    rows = [("A", "p1", ["x", "x", None, "y"]), ("A", "p2", ["x"]), ("B", "p3", None), ("B", "p4", [None])]
    transactions = spark.createDataFrame(rows, "site string, pid string, items array<string>")
    items = spark.createDataFrame([("x",), ("y",), (None,), ("x",)], "item string")
    found = {(r["site"], tuple(r["items"])): r["freq"] for r in R.frequent_itemsets(transactions, items).collect()}
    assert found == {("A", ("x",)): 2, ("A", ("y",)): 1, ("A", ("x", "y")): 1}
