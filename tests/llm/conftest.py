import random

import pytest


def words(n: int, seed: int, size: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    rows = []
    for k in range(60):
        text = words(30 + k * 3, k)
        rows.append((k, text, "en" if k % 2 else "de", f"s{k % 4}" if k % 7 else None, len(text)))
    rows += [
        (100, rows[3][1], "en", "s0", 5), (101, rows[3][1], None, "s1", 5), (102, None, "en", "s0", None), (103, "", "de", None, 0), (104, "", "de", "s3", 0),
        (105, "one", "en", "s1", 3), (106, "one two", "en", "s1", 7), (107, "12 34 !!", "en", "s2", 8), (None, "no id here", "en", "s2", 10), (None, rows[3][1], "en", "s2", 10),
        (108, words(9000, 5), "en", "s0", 1), (109, words(60, 77, 10**6), "en", "s0", 1), (110, words(5, 1) + " " + words(60, 77, 10**6) + " " + words(9, 2), "en", "s0", 1),
        (111, rows[20][1], "en", "s0", 1), (111, rows[20][1], "en", "s0", 1), (112, rows[30][1] + " tail", "en", "s0", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return _rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    extra = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as digest", "1L as fp", "2L as component_id", "'y' as key", "3L as size", "4L as n", "true as kept", "5 as piece")
    return extra


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
