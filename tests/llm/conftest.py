import random

import pytest

WORDS = "ab cd efg hij klm nop qrs tuv wxy zab cde fgh".split()


def prose(draw: random.Random, low: int, high: int) -> str:
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 40)) for _ in range(draw.randint(low, high)))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source, n_chars): copies, near copies, shared lines, odd texts."""
    draw = random.Random(3)
    texts = ["\n".join(prose(draw, 3, 40) for _ in range(draw.randint(1, 5))) for _ in range(60)]
    shared = prose(draw, 60, 60)
    for i in range(0, 20, 4):
        texts[i] += "\n" + shared + "\n" + prose(draw, 5, 9)
    near = texts[30].split(" ")
    for i in (31, 32, 33, 34):
        copy = list(near)
        for _ in range(i - 30):
            copy[draw.randrange(len(copy))] = "odd"
        texts[i] = " ".join(copy)
    texts[40] = texts[41] = texts[42]
    texts[50:] = ["", "   \n", "one", "One", "one two", "ONE\ttwo", "é" * 300, "ab " * 4000, "a\x00b c", texts[42].upper()]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rows += [(60, None, None, None, None), (None, texts[3], "en", "s1", 5), (7, texts[7], "en", "s3", 9), (7, "other text", "de", None, 3)]
    return rows


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with a column whose name operators use themselves."""
    return spark.createDataFrame([(*r, "x") for r in corpus], f"{DOCUMENTS}, `key` string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
