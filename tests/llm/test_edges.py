"""Every operator over awkward rows and over none: no crash, a row for each row, and reruns that agree."""

import pytest
from pyspark.sql import functions as F

from quillstone.llm import hmm, mixing, packing, quality, sharding, simhash, substrings, suffixes, toxicity, vectors
from quillstone.llm.queries import fold, tokenizer_path

LABELS = "doc_id long, quality int, toxic int, text string"


def labels_of(spark):
    return spark.createDataFrame([(i, 1, int(i % 4 == 0), "z") for i in range(70)] + [(None, None, None, None), (3, None, 7, ""), (5, 0, 0, None), (5, 0, 1, None)], LABELS)


PER_ROW = {
    "mixing": lambda d: mixing.quotas(d),
    "sharding": lambda d: sharding.place(d, sharding.names(5), 251).select("row.doc_id", "slot", "shard"),
    "hmm": lambda d: hmm.score(d, fold(F.col("doc_id")) == 1).select("doc_id", "held_out", "n_tokens", "n_known", F.round("score", 6)),
    "quality": lambda d: quality.verdicts(d),
    "substrings": lambda d: substrings.removed(d),
    "toxicity": lambda d: toxicity.scores(d, toxicity.fit(d, labels_of(d.sparkSession))).select("doc_id", F.round("score", 6)),
    "simhash": lambda d: simhash.near_duplicates(d),
    "suffixes": lambda d: suffixes.deduplicate(d),
}
KEEP_COLUMNS = {
    "mix": mixing.mix,
    "keep": quality.keep,
    "clean": lambda d: toxicity.clean(d, toxicity.fit(d, labels_of(d.sparkSession))),
    "first": simhash.first_of_each,
    "passages": substrings.deduplicate,
}


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_each_row(hard, empty, name):
    got = rows(PER_ROW[name](hard))
    assert len(got) == hard.count()
    assert got == rows(PER_ROW[name](hard.repartition(7)))
    assert PER_ROW[name](empty).count() == 0


@pytest.mark.parametrize("name", KEEP_COLUMNS)
def test_columns_stay(hard, empty, name):
    out = KEEP_COLUMNS[name](hard)
    assert out.columns == hard.columns and [t for _, t in out.dtypes] == [t for _, t in hard.dtypes]
    assert 0 < out.count()
    assert KEEP_COLUMNS[name](empty).count() == 0


def test_pack(hard, empty):
    pieces = packing.pack(hard, tokenizer_path()).collect()
    assert packing.pack(empty, tokenizer_path()).count() == 0
    assert sum(p.length for p in pieces if p.start == 0 or True) == sum(p.doc_tokens for p in pieces if p.start == 0)
    assert sum(p.start == 0 for p in pieces) == hard.count()


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.1], 0), (4, [0.0, 1.0], 0), (5, None, 0), (6, [], 0), (7, [0.0, 0.0], 0), (8, [nan, 1.0], 0), (9, [inf, 1.0], 0)]
    v += [(10, [None, 1.0], 0), (11, [1.0, 0.0, 0.0], 0), (4, [0.0, 1.0], 0), (None, [0.0, 1.0], None), (12, [1e-30, 0.0], 0), (13, [-1.0, 0.0], 0), (14, [0.0, 2.0, 0.0], 0), (15, [0.1, 5.0, 0.0], 0)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int").withColumn("root", F.lit("x"))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()), key=repr)
    want = [(i, 3, 1, i == 1) for i in (1, 2, 3, 12)] + [(4, 2, 4, True)] * 2 + [(None, 2, 4, False)] + [(i, 0, i, True) for i in (5, 6, 7, 8, 9, 10, 11, 13)] + [(14, 1, 14, True), (15, 1, 14, False)]
    assert got == sorted(want, key=repr)
    assert vectors.near_duplicates(df.where("false")).count() == 0
