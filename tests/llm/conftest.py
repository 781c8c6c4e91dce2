import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, size int, component_id string, kept string, copies int, row string, copy int"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(("ba", "ti", "ko", "re", "mun", "ösi")) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def changed(rng: random.Random, base: list[str], share: float) -> list[str]:
    return [rng.choice(words(rng, 1)) if rng.random() < share else w for w in base]


@pytest.fixture(scope="session")
def texts():
    """Texts with nulls, empty ones, copies, near copies, shared passages, runs of one word, odd white space and one very long text."""
    rng = random.Random(5)
    base = words(rng, 120)
    passage = words(rng, 60)
    out = [None, "", " \t\n", "one", "one two three", "One  two\nthree", "a " * 90, "a " * 45 + "b", "ab " * 60, "x y " * 40]
    out += [" ".join(base)] * 4 + [" ".join(changed(rng, base, s)) for s in (0.003, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2) for _ in range(6)]
    out += [" ".join([*words(rng, 30), *passage, *words(rng, 20)]) for _ in range(6)]
    out += [" ".join(passage[10:40] + words(rng, 40) + passage[10:40]), " ".join(words(rng, 6000)), "  ".join(base[:19]), "\n".join(base[:20])]
    out += [" ".join(words(rng, rng.randint(1, 80))) for _ in range(40)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts under ids in no order, with columns whose names operators might use, one row repeated as it is, and two rows without an id."""
    ids = list(range(len(texts)))
    random.Random(7).shuffle(ids)
    sources = ["hot", "hot", "b", "ü", None]
    rows = [(i, t, "en", sources[i % 5], len(t or ""), "x", 1, "c", "k", 2, "r", 3) for i, t in zip(ids, texts)]
    rows += [rows[12], (None, " ".join(["lost"] * 30), None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
