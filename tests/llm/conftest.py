import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _n int, fp string, key double, size string, _score string, _row string, slot int"


def prose(r, n, words=None):
    words = words or ["".join(r.choice("abcdefghi") for _ in range(r.randint(2, 9))) for _ in range(400)]
    out = []
    while len(out) < n:
        k = r.randint(5, 14)
        s = r.choices(words, k=k)
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out[:n])


def hard_rows(seed=3):
    """Nulls in every column, empty and very long texts, ties, copies, repeated rows; the columns behind
    n_chars have names that operators may use inside."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghi") for _ in range(r.randint(2, 9))) for _ in range(400)]
    passage = prose(r, 70, words)
    texts = [prose(r, r.randint(20, 120), words) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1].upper(), texts[2] + " end", passage + " " + texts[3], texts[4] + " " + passage, prose(r, 3000, words)]
    texts += ["", None, " \t\n", "one", "Ünï côdé 漢字 \x00 x", "a" * 5000, "same " * 500, "x\n\n\ny", "# * $ % & | < > " * 30]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", "B", None, ""][i % 5], len(t or ""), "x", i, None, 0.5, "s", "t", "u", 1) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[6], None, None, None, *[None] * 8), (None, None, None, None, None, *[None] * 8)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
