import random

import pytest

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, kept string, size int, source_size int, row string, bucket int, "
           "line string, fp string, key string, place int")


def words(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(n))


def nasty_rows():
    """Nulls in every column, empty, tiny and very long texts, copies, near copies, repeated lines and rows, repeated ids."""
    rng = random.Random(3)
    base = [words(rng, rng.randint(20, 120)) for _ in range(30)]
    texts = list(base)
    texts += [base[0], base[0], base[1], base[2] + " more", base[3].replace(" ", "\n"), base[4].upper(), base[5] + "\n" + base[6]]
    texts += [None, "", None, "", " \n\t ", "one", "two words", "ONE", "#$% *** |", "é" * 150, "a" * 500, "a b " * 300, words(rng, 8) * 40]
    footer = "Printed at %d by the office of records number %d today"
    texts += [f"{words(rng, 30)}\n{footer % (i, 7 * i)}\n{words(rng, 5)}" for i in range(12)]
    texts += [" ".join(base[i % 30] for i in range(400)), "x" * 20000]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "s10", None][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[7], None, None, None), (None, None, "en", "s1", None), (5, base[8], "en", "s2", 1)]
    return [(*r, "x", 1, 2, "r", 3, "l", "f", "k", 4) for r in rows]


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame(nasty_rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
