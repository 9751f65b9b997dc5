"""The pipeline's stages over awkward rows, over none, and against brute force on planted cases."""

import random
import zlib

import pytest

import corpus_pipeline as cp
from tests.llm.conftest import prose
from tests.llm.test_brute import words
from tests.llm.test_near_copies import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with labels for the awkward rows."""
    path = str(tmp_path_factory.mktemp("labels"))
    rows = [(i, 1, int(i % 4 == 0)) for i in range(70)] + [(None, None, None), (3, None, 7)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES[:-1]])
def test_awkward_rows(spark, hard, empty, folder, name):
    stage = dict(cp.STAGES)[name]
    out = stage(spark, hard, folder)
    assert out.columns == hard.columns and out.dtypes == hard.dtypes
    assert 0 < out.count()
    assert stage(spark, empty, folder).count() == 0


def test_packing_of_awkward_rows(spark, hard, empty, folder):
    pieces = dict(cp.STAGES)["packing"](spark, hard, folder).collect()
    assert sum(p.start == 0 for p in pieces) == hard.count()
    assert dict(cp.STAGES)["packing"](spark, empty, folder).count() == 0


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(500):
        t = prose(r, 80).split()
        if i % 5 == 0:
            for _ in range(4):
                t.insert(r.randrange(len(t)), r.choice(["grobword", "vilestem", "grobwords"]))
        rows.append((i, " ".join(t), len(" ".join(t))))
        labels.append((i, 1, int(i % 5 == 0)))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    kept = {x.doc_id for x in cp.toxic(spark, docs, str(tmp_path)).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in held if (i in kept) == (i % 5 == 0)] == []


def test_copies_and_passages(spark):
    """One of each group of near copies stays; a passage of over 50 words keeps its first place only."""
    r = random.Random(9)
    passage = prose(r, 60)
    texts = [prose(r, 150) for _ in range(40)]
    texts += [texts[0], texts[1].upper(), *(" ".join([*t.split()[:75], *passage.split(), *t.split()[75:]]) for t in (prose(r, 150) for _ in range(8)))]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    once = cp.near_copies(spark, docs, "")
    assert sorted(x.doc_id for x in once.collect()) == sorted(set(brute(texts)))
    left = {x.doc_id: x for x in cp.passages(spark, once, "").collect()}
    assert all(left[i].text == texts[i] and left[i].n_chars == len(texts[i]) for i in left if i < 43)
    for i in range(43, 50):
        gone = len(words(texts[i])) - len(words(left[i].text))
        assert 30 <= gone <= 75 and left[i].n_chars == len(left[i].text)
