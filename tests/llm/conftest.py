import random

import pytest

WORDS = ["alpha", "Beta", "gamma,", "d\u00e9lta", "eps", "zeta.", "eta", "theta", "iota", "kappa", "lambda", "mu!", "nu", "xi", "\u65e5\u672c\u8a9e", "rho"]
SCHEMA = "doc_id long, text string, lang string, id long, part long, n long, label int, score double, h string, w string, place long, rep long, words string, slot int"


def edge_texts():
    """Null, empty, white space, one word, long, equal up to case, near copies, shared passages, odd characters."""
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))
    base, passage = some(60), some(20)
    near = base.split()
    near[30] = "changed"
    texts = [None, "", " \n\t ", "one", "One", base, base.upper(), base, " ".join(near), some(30) + "\n" + passage + "\n" + some(25), passage + " " + some(40), some(5000), some(4)]
    texts += ["a\u00a0b\u2003c  d", "it's we'll\x1c x", "tail   ", "\n\n lead", "x" * 3000, "same line\nsame line\nother", "<|endoftext|> !! ## $$", "e\u0301 \u00e9 \u0130 \u1e9e"]
    texts += [some(rng.randrange(10, 90)) for _ in range(30)]
    return texts


@pytest.fixture(scope="session")
def texts():
    return {i * 3 + 1: t for i, t in enumerate(edge_texts())}


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", 7, 1, 2, 1, 0.5, "h", "w", 3, 4, "words", 9) for i, t in texts.items()]
    return spark.createDataFrame(rows + [(None, "no id here", "en", 7, 1, 2, 1, 0.5, "h", "w", 3, 4, "words", 9)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, texts):
    return spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in texts] + [(None, 1, 1), (99999, None, None), (4, 5, 7)], "doc_id long, quality int, toxic int")
