import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture_rows(n=160, seed=3):
    """Documents with near and exact copies, shared lines, nulls, blanks, ties and one long text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.25 and texts:
            words = rng.choice(texts).split(" ")
            words[rng.randrange(len(words))] = rng.choice(vocab)
            text = " ".join(words)
        elif kind < 0.35 and texts:
            text = rng.choice(texts)
        else:
            lines = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 25))) for _ in range(rng.randint(1, 9))]
            lines += rng.sample(["Shared Line one", "  shared line ONE\t", "another shared line", "x", ""], rng.randint(0, 3))
            text = "\n".join(lines)
        texts.append(text)
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]), len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, " \n\t\n", "en", None, 4), (n + 3, "one", "en", "a", 3), (n + 4, "one", None, "b", 3)]
    rows.append((n + 5, "\n".join(" ".join(rng.choice(vocab) for _ in range(40)) for _ in range(300)), "en", "c", 0))
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
