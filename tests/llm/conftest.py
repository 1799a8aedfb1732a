import random

import pytest

WORDS = [a + b for a in ("th", "on", "er", "in", "re", "st") for b in ("an", "or", "ea", "ble", "ou", "ti", "ha")]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, id string, block string, tokens string, label string, word string, gram int, size int, name string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng: random.Random, text: str, changes: int) -> str:
    ws = text.split(" ")
    for _ in range(changes):
        ws[rng.randrange(len(ws))] = "changed" + str(rng.randrange(1000))
    return " ".join(ws)


def texts() -> list:
    """Copies, near copies, groups, nulls, empties, white space, a very long text, junk and repeated rows."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(20, 200)) for _ in range(60)]
    out = [*base, None, "", "   ", " \t\n", "one", "One two three", "one  two\tthree", "one two three", None, prose(rng, 30_000), "*** 123 !!!", "\x00\x01 odd \x7f", "naïve Ünï çà 中文 текст"]
    for b in base[:20]:
        out += [b, b.replace(" ", "  ", 3), b.upper(), edited(rng, b, 1), edited(rng, b, 2)]
    hot = prose(rng, 120)
    out += [edited(rng, hot, 2) for _ in range(90)] + [hot] * 60
    return out


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, ("en", "fr")[i % 2], "s", 0, 1, "x", "b", "t", "l", "w", 1, 2, "n") for i, t in enumerate(texts())]
    rows += [rows[3], rows[3], (None, "a text without id that has a few words", "en", *rows[0][3:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
