"""Every occurrence of a toxic word scores."""

from quillstone.llm import toxicity

MODEL = toxicity.Model({"vile": 4.0, "grob": 4.0, "nasty": 4.0}, 0.25)


def test_a_second_passage_of_the_same_words_is_found():
    bad, plain = "vile grob nasty", " ".join(["plain"] * 60)
    n, segments = MODEL.segments(f"{bad} {plain} {bad}", {})
    assert n == 66 and [(a, z) for _, a, z in segments] == [(0, 2), (63, 65)]
    assert segments[0][0] == segments[1][0] == 3 * (4.0 - MODEL.drift)


def test_a_passage_of_words_that_came_singly_is_found():
    plain = " ".join(["plain"] * 60)
    _, segments = MODEL.segments(f"vile {plain} grob {plain} nasty {plain} vile grob nasty", {})
    assert max(segments)[1:] == (183, 185)


def test_rows_of_one_id_or_none_are_dealt_to_many_shards(spark):
    """A shard is a task's: rows that share an id, or have none, must not be one shard."""
    from pyspark.sql import functions as F

    from quillstone.llm import mixing

    for i in ("null", "7"):
        docs = spark.range(6000).selectExpr(f"cast({i} as long) as doc_id", "concat('w', id, repeat(' x y z', 20)) as text", "'s' as source")
        slim = mixing._slim(docs)
        sizes = [r.n for r in mixing._plan(slim, slim, **mixing.SETTINGS).groupBy("_group", "_shard").agg(F.count("*").alias("n")).collect()]
        assert len(sizes) > 3 and max(sizes) < 3000
        out = mixing.quotas(docs).agg(F.sum("taken"), F.max("target")).first()
        assert abs(out[0] - out[1]) < 100

def test_an_id_of_many_texts_teaches_within_the_bound(spark, monkeypatch):
    seen, real = [], toxicity._counts
    monkeypatch.setattr(toxicity, "_counts", lambda sample, *a: (seen.extend(r["count"] for r in sample.groupBy("toxic").count().collect()), real(sample, *a))[1])
    docs = spark.range(2000).selectExpr("if(id < 1900, 1, id) as doc_id", "concat('vile w', id) as text")
    labels = spark.range(2000).selectExpr("id as doc_id", "int(id = 1) as toxic")
    toxicity.fit(docs, labels, rows=100)
    assert seen and max(seen) <= 200


def test_repeated_rows_come_to_the_start_of_training_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quillstone.llm import hmm

    seen, real = [], hmm._flat
    monkeypatch.setattr(hmm, "_flat", lambda texts: (seen.append(len(texts)), real(texts))[1])
    docs = spark.range(510).selectExpr("if(id < 500, 7, id) as doc_id", "if(id < 500, 'one two', concat('three ', id)) as text")
    assert hmm.score(docs, F.lit(False)).count() == 510
    assert seen[0] == 11
