import hashlib
import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "über", "ñandú", "the", "of", "and", "A", "B", "x1", "—", "日本"]


@pytest.fixture
def prose():
    """Random texts: nulls, empty and blank ones, copies, near copies, shared passages, one very long text."""
    rng = random.Random(3)

    def text(n):
        return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))

    passage = text(40)
    made = [None, "", " \t\n", "one", "two words", "a b c", text(9000)]
    for _ in range(25):
        base = text(rng.randrange(20, 120))
        words = base.split(" ")
        changed = words[:]
        changed[rng.randrange(len(words))] = "changed"
        made += [base, base, base.replace(" ", "\n\t ", 3), " ".join(changed), base + "\x0b"]
        if rng.random() < 0.5:
            made.append(text(15) + " " + passage + " " + text(10))
        made.append(text(rng.randrange(1, 60)))
    made += [made[-1]] * 30
    rng.shuffle(made)
    return list(enumerate(made))


@pytest.fixture
def documents(spark, prose):
    """``prose`` as a table with extra columns whose names the operators use themselves."""
    rows = [(i, t, None if i % 11 == 0 else ("en" if i % 2 else "fr"), f"s{i % 3}" if i % 7 else None, i, 1.5, "k") for i, t in prose]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, rank long, score double, part string"
    ).repartition(3)


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture
def sha():
    return lambda text: hashlib.sha256(text.encode()).hexdigest()
