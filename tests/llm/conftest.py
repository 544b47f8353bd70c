import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, bucket int, label string"


def make_texts():
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(150)]

    def prose(n):
        return " ".join(r.choices(words, k=n)).capitalize() + "."

    base = prose(120)
    near = base.split(" ")
    near[60] = "changed"
    shared = prose(40)
    texts = [base, base, " ".join(near), None, "", " \n\t ", "one", "one two", prose(30) + "\n" + shared + "\n" + prose(30), shared + " " + prose(20), "x" * 5000 + " " + "y" * 5000, "ab " * 4000, "é ÀÉ 漢字 " * 20]
    texts += [prose(r.randint(5, 200)) for _ in range(25)]
    return texts


def rows_of(texts):
    return [(i, t, "en", f"src{i % 3}", None if t is None else len(t), 7, 1, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Small documents with nulls, blanks, copies, a repeated row, a null id and clashing extra columns."""
    rows = rows_of(texts)
    extra = [rows[0], (None, "a text without id that is long enough to count as one", "en", None, 10, 1, 1, "y")]
    return spark.createDataFrame(rows + extra, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"
