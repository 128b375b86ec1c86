import random

import pytest

from cohortweave.llm.queries import ready


@pytest.fixture(autouse=True, scope="session")
def workers(spark):
    ready(spark)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): copies, near copies, shared passages, short, empty, null, odd and long ones."""
    rnd = random.Random(5)
    make = lambda n: " ".join(rnd.choice(WORDS) + str(rnd.randrange(30)) for _ in range(n))
    passage = make(60)
    out = [None, "", " \t\n", "one", "One", "one two", "a\x0bb\x0cc", "é\u00a0ü ß\u2003x", "x " * 400, "y" * 5000]
    for _ in range(30):
        base = make(rnd.randrange(20, 200))
        out += [base, base, base.upper()]
        words = base.split()
        words[rnd.randrange(len(words))] = "changed"
        out.append(" ".join(words))
        out.append(base + " " + passage + " " + make(10))
    hot = make(80).split()
    for _ in range(60):
        words = list(hot)
        for _ in range(rnd.randrange(1, 5)):
            words[rnd.randrange(80)] = make(1)
        out.append("\n".join([" ".join(words[:40]), " ".join(words[40:])]))
    out.append(make(20_000))
    rnd.shuffle(out)
    return list(enumerate(out))


SCHEMA = "doc_id long, text string, score string, node int, lang string, source string, n_chars long, chunk string"


@pytest.fixture(scope="session")
def documents(spark, texts):
    """With columns whose names the operators use themselves."""
    rows = [(i, t, "s", 1, ["en", "de", None][i % 3], "src", len(t) if t else None, "c") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
