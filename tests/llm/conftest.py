import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, row long, n long, token string, digest long, size long, copies long, label int, block int, score double, x string"


def messy_rows(seed: int = 1, n: int = 60):
    """Random words, copies, near copies, nulls, empty and white texts, a very long text, repeated rows and ids."""
    rng = random.Random(seed)
    words = [a + b for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("n", "r", "s", "t", "l", "da")]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.4:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))))
    texts += [None, "", "  \n\t ", "One", "one two three", "One two  three", " ".join(words * 400), "Ünï cödé «x» ….  y", "a\x0bb\x0cc\x1cd",
              "x <|endoftext|> y<|startoftext|>", "All rights reserved. CC BY 4.0\nReleased under the MIT License.", "### ### ### ###", "a\n\n b  c\n"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s1", None])) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here at all", "en", "s1"), (None, None, None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "t", 4, 5, 6, 1, 7, 0.5, "y") for r in rows], KIND)


@pytest.fixture(scope="module")
def rows():
    return messy_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def framed(spark):
    return lambda rows: frame(spark, rows)
