import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, held_out string, score string, fp string, kind string, spans string, part string, shard string, key string"


def made_up(draw, words):
    return " ".join(draw.choice(["the", "of", "and", "Alpha", "beta", "gamma", "delta7", "épsilon", "zeta,", "eta."]) + draw.choice(["", "", "x", "yy", "zzz"]) for _ in range(words))


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank, short, long, repeated and near-repeated texts."""
    draw = random.Random(3)
    base = [made_up(draw, draw.randint(1, 80)) for _ in range(60)]
    odd = [None, "", "  \n\t ", "one", "one two", base[0], base[0], f"{base[1]} extra", "\n".join(base[2:6]), made_up(draw, 30_000), "x" * 50_000, "\x00 nul   sep \U0001f600 emoji", "A@b.cd " * 3]
    return base + odd


@pytest.fixture(scope="session")
def rows(texts):
    out = [(i, t, ["en", "de", None][i % 3], [None, "a", "b", "é"][i % 4], None, 1, "h", "s", "f", "k", "p", "q", "r", "y") for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, "without an id, but some words to go by here", None, None, *out[0][4:])]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def trees(spark):
    from grove.llm.html import train_trees

    return train_trees(spark)
