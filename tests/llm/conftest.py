import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def corpus():
    """A few hundred texts with copies, near copies, shared passages, odd characters and nulls."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    draw = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [draw(70) for _ in range(3)]
    base = draw(120)
    texts = [None, "", " \t\n ", "one", "two words", "A b C\x0bd", "K İ under the MIT license", "x " * 400, "y" * 3000]
    texts += [draw(rng.randrange(1, 150)) for _ in range(60)]
    texts += [draw(5) + "\n" + rng.choice(shared) + "  " + draw(9) for _ in range(20)]
    for _ in range(30):
        copy = base.split()
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += [texts[15]] * 12 + [texts[20].upper()] + [base] * 3
    rng.shuffle(texts)
    langs, sources = ["en", "de", None], ["s1", "s2", "s2", "s2", "é", None]
    return [(i, t, langs[i % 3], sources[i % 6], None, 0.5) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, repeated rows."""
    return spark.createDataFrame(
        [(None, "a b c", None, None, None, None), (None, "a b c", "en", "s", 1, 1.0), (5, "a b c", None, None, None, None), (5, "a b c", None, None, None, None), (5, "d", None, "s", None, None), (6, None, None, None, None, None), (7, "", None, None, None, None)],
        SCHEMA,
    )
