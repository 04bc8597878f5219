import random

import pytest

WORDS = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, ties, blanks, nulls and one that is very long."""
    rng = random.Random(11)
    base = [prose(rng, rng.choice((3, 12, 40, 150, 400))) for _ in range(40)]
    near = []
    for t in base[:25]:
        words = t.split()
        for _ in range(rng.randint(0, 6)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            near.append(" ".join(copy))
    passage = prose(rng, 60)
    shared = [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(12)]
    odd = [None, "", "   \t\n", "a", "A b", "a b c", base[0].upper(), base[0], base[0], prose(rng, 30_000), "é ß 日本", "x\x01y\x02 z", "one  two   three\n\n four \n five"]
    return base + near + shared + odd


COLUMNS = "doc_id long, text string, source string, lang string, n_chars long, row long, _t string, label int, kind string, g long, fp binary, _id long, _n long"


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents with columns whose names operators might use themselves, a repeated row, and a null id."""
    rows = [(i, t, f"s{i % 5}" if i % 11 else None, "en", 0, 7, "t", 3, "k", 1, b"x", 9, 2) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[1], "s1", "en", 0, 7, "t", 3, "k", 1, b"x", 9, 2), (5, "another text under a used id", "s1", "en", 0, 7, "t", 3, "k", 1, b"x", 9, 2)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
