"""What is compared, shuffled or grouped must not grow faster than the tables."""

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone import catalog, plans  # noqa: F401
from quillstone.functions import calc, units
from quillstone.operators import chunking, evidence, grounding, pages, search, verify
from quillstone.sources import loaders
from quillstone.streaming import events as ev
from quillstone.streaming import thoughts


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_revisions_compare_different_texts_and_names_only(spark):
    q = spark.createDataFrame([(1, "DDR4 rev B vs DDR5"), (2, "ddr4 rev b VS ddr5"), (3, "DDR5 rev C"), (3, "ddr4 rev. b"), (4, None)], "query_id long, text string")
    d = spark.createDataFrame([(10, "B", ["DDR4", "DDR5"]), (11, "b", ["DDR4"]), (11, "b", ["DDR4"]), (12, "C", ["DDR5", None]), (13, "", ["DDR4"]), (14, "B", None)], "doc_id long, revision string, entities array<string>")
    out = evidence.revision_mentions(q, d)
    assert sorted(map(tuple, out.collect())) == [(1, 10), (1, 11), (2, 10), (2, 11), (3, 10), (3, 11), (3, 12)]
    above = plan(out).split("regexp_like")[0]  # what stands above the comparison
    assert "Aggregate [texts" in above


def test_pages_are_rows_not_groups_of_their_own(spark):
    """A group for each page costs more than the page: pages come many to a batch, and tokens of a word are parsed once."""
    v = spark.createDataFrame([(1, 1, 1, "300", ["tR1"], ["Max"], []), (1, 2, 1, "300", ["tR2"], ["Max"], []), (2, 1, 1, "300", ["tR1"], ["Max"], [])], "doc_id long, page long, value_id long, value string, labels array<string>, heads array<string>, groups array<string>")
    w = spark.createDataFrame([(1, 1, 10.0, 0.0, 50.0, 10.0, "Symbol", None), (1, 1, 200.0, 0.0, 240.0, 10.0, "Max", False), (1, 1, 10.0, 20.0, 50.0, 30.0, "tR1", False), (1, 1, 200.0, 20.0, 240.0, 30.0, "300", False), (1, 2, 10.0, 20.0, 50.0, 30.0, "tR2", False), (1, 2, 200.0, 20.0, 240.0, 30.0, "300", False)], "doc_id long, page long, x0 double, y0 double, x1 double, y1 double, text string, raised boolean")
    out = pages.ground_values(v, w)
    assert sorted((r.doc_id, r.page, r.status, r.head_before) for r in out.collect()) == [(1, 1, "grounded", False), (1, 2, "grounded", True), (2, 1, "no_text_layer", False)]
    assert "CoGroup" not in plan(out)
    before = grounding._norm_tokens.cache_info().hits
    assert grounding.norm_tokens("tR1 300") == grounding.norm_tokens("tR1 300") == ["tr1", "300"]
    assert grounding._norm_tokens.cache_info().hits > before


def test_an_index_is_built_and_searched_without_shuffling_postings(spark):
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(1, 30)), f"s{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    index = search.build_index(docs, "doc_id", ["text", "source"])
    got = sorted((r.doc_id, r.term, r.f0, r.f1, r.l0, r.l1) for r in index.postings.collect())
    assert got == sorted((i, t, x.split().count(t), int(t == s), 29, 1) for i, x, s in rows for t in {*x.split(), s})
    assert "Aggregate" not in plan(search._indexed(docs, "doc_id", ["text", "source"]))
    q = spark.createDataFrame([(1, ["w3", "w5", "s1"]), (2, ["w0", "none"])], "query_id long, terms array<string>")
    found = search.bm25(index, "doc_id", {"text": 1.0, "source": 0.5}, q, 5)
    slow = search.bm25(search.Index(index.key, index.fields, index.docs, index.stats, False), "doc_id", {"text": 1.0, "source": 0.5}, q, 5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, slow.collect()))
    assert "MapInArrow" in plan(found)


def test_an_index_of_repeated_keys_counts_a_key_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a c"), (2, "b"), (3, "d"), (4, "e")], "doc_id long, text string")
    index = search.build_index(docs, "doc_id", ["text"])
    assert not index.single
    assert {(r.doc_id, r.term, r.f0) for r in index.postings.collect()} == {(1, "a", 2), (1, "b", 1), (1, "c", 1), (2, "b", 1), (3, "d", 1), (4, "e", 1)}


def test_queries_of_the_same_known_terms_are_scored_once(spark):
    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5}") for i in range(40)], "doc_id long, text string")
    asked = [(q, ["w1", f"own{q}"] if q % 2 else ["w2", "w0", f"own{q}"]) for q in range(50)]
    queries = spark.createDataFrame([*asked, (50, ["none"])], "query_id long, terms array<string>")
    known = queries.select("query_id", F.explode("terms").alias("term")).where("term like 'w%'")
    sets, same = search._alike(known)
    assert sorted(map(tuple, sets.collect())) == [(0, "w0"), (0, "w2"), (1, "w1")]
    assert sorted((r.query_id, r._first) for r in same.collect()) == [(q, q % 2) for q in range(50)]
    scope = docs.where("doc_id > 10")
    found = {}
    for r in search.bm25(docs, "doc_id", {"text": 1.0}, queries, 4, scope).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    alone = {}
    for q in (0, 1):
        one = queries.where(F.col("query_id") == q)
        alone[q] = sorted((r.rank, r.doc_id, r.score) for r in search.bm25(docs, "doc_id", {"text": 1.0}, one, 4, scope).collect())
    assert {q: sorted(v) for q, v in found.items()} == {q: alone[q % 2] for q in range(50)}
    assert all(d > 10 for v in alone.values() for _, d, _ in v) and len(alone[0]) == 4


def test_a_word_is_stemmed_once():
    calc.stem.cache_clear()
    assert calc.stem_words.func(pd.Series(["Running runs", "running RUNS, Émile", None])).tolist() == ["run run", "run run, emil", None]
    assert calc.stem.cache_info().misses <= 3


def test_rows_of_a_grid_are_found_without_a_join(spark):
    words = [(d, 1, x, y * 20.0) for d in (1, 2) for y in range(4 if d == 1 else 2) for x in (10.0, 100.0, 200.0, 300.0)] + [(1, 1, 500.0, 200.0), (None, 1, 10.0, 0.0), (3, 1, None, None)]
    out = grounding.aligned_rows(spark.createDataFrame(words, "doc_id long, page long, x0 double, y0 double"))
    assert [tuple(r) for r in out.collect()] == [(1, 1, 4)]
    assert "Join" not in plan(out)


def test_equal_texts_of_a_batch_are_parsed_once():
    asked = []
    out = units._each(pa.array(["5 ns", None, "5 ns", "1.2 V or 3 V"] * 50), lambda t: asked.append(t) or units.quantities_of(t))
    assert sorted(asked) == ["", "1.2 V or 3 V", "5 ns"]
    assert [len(x) for x in out.to_pylist()] == [1, 0, 1, 2] * 50


def test_values_of_a_claim_are_found_once(spark):
    c = spark.createDataFrame([(1, 1, "fact", "It is 5000 ps [1][2].", [1, 2, 2]), (1, 2, "fact", "It is 7 ns [1].", [1]), (1, 3, "fact", "It is so.", [])], "answer_id long, claim_id int, kind string, text string, cites array<int>")
    s = spark.createDataFrame([(1, 1, "calc", True, False, "it is 5 ns"), (1, 2, "document", True, False, "| t | 5 | ns |")], "answer_id long, n int, kind string, verified boolean, traced boolean, text string")
    out = verify.check_values(c, s)
    rows = {r.claim_id: (r.status, r.codes, r.origins) for r in out.collect()}
    assert rows == {1: ("unsupported", ["calc_input_unsourced"], ["document"]), 2: ("unsupported", ["calc_input_unsourced", "value_not_found"], []), 3: ("unsupported", ["no_citation"], [])}
    assert plan(out).count("ArrowEvalPython") == 2


def test_streams_of_a_group_keep_their_states(spark, tmp_path):
    """A call of Python for each stream costs far more than its pieces: many share one."""
    for k, rows in enumerate([[(1, 0, "a<thi", False), (2, 0, "x", False)], [(2, 1, "<think>y", True), (1, 1, "nk>b</th", False)], [(1, 2, "ink>c", True)]]):
        spark.createDataFrame(rows, "stream_id long, at int, text string, last boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/pieces")
    out = ev.run_available(spark, f"{tmp_path}/pieces", lambda p: thoughts.split_stream(p, groups=1), files=1)
    assert sorted(map(tuple, out.select("stream_id", "at", "answer", "thoughts").collect())) == [(1, 0, "a", ""), (1, 1, "", "b"), (1, 2, "c", ""), (2, 0, "x", ""), (2, 1, "", "y")]


def test_a_word_is_hashed_once():
    loaders._places.cache_clear()
    assert loaders.embedding_of("one two one", 8) == loaders.embedding_of("two ONE one", 8)
    assert loaders._places.cache_info().misses == 2


def test_units_of_documents_are_found_once(spark, sf):
    assert "units" not in plan(catalog.QUERIES["support_of_passages"](spark, sf)).replace("find_quantities", "").replace("/units-", "")


def test_few_documents_are_chunked_at_once(spark):
    docs = spark.createDataFrame([(1, [(1, "a b.", "text", "S")])], "doc_id long, blocks array<struct<page:int,text:string,kind:string,section:string>>")
    assert chunking.chunk_documents(docs).count() == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 100


@pytest.mark.parametrize("name", ["apply_corrections", "render_answers"])
def test_answers_are_shuffled_by_answer_alone(spark, sf, name):
    p = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in p.split("\n") if "Exchange hashpartitioning(" in x]
    assert dealt and all("hashpartitioning(l_orderkey" in x and "l_linenumber" not in x.split("hashpartitioning(")[1].split(")")[0] for x in dealt if "claim_id" not in x)
    assert not any("line#" in x or "kind#" in x for x in dealt)


def test_needles_ask_the_index_once(spark):
    docs = spark.createDataFrame([(i, f"w{i} common words w{i % 3} stand here") for i in range(30)], "doc_id long, text string")
    index = search.build_index(docs, "doc_id", ["text"])
    needles = spark.createDataFrame([(1, "w5 common words w2 stand"), (2, "common words w1 stand here"), (3, "here w5 none")], "query_id long, needle string")
    out = search.containing(index, docs, needles)
    assert {tuple(x) for x in out.select("query_id", "doc_id").collect()} == {(1, 5), *((2, i) for i in range(30) if i % 3 == 1)}
    assert "explode(p" not in plan(out)  # what was found is written, not looked for again by each count and join


def test_lines_of_a_page_are_made_once_for_its_checks(monkeypatch):
    """Unit, label and head are looked for in the same lines, with the same results as each by itself."""
    made, rows = [], grounding._rows
    monkeypatch.setattr(grounding, "_rows", lambda words: made.append(1) or rows(words))
    printed = [[(10, 0, "Symbol"), (200, 0, "Max")], [(10, 20, "tR1"), (200, 20, "300"), (300, 20, "ns")], []]
    words = [[{"x0": float(x), "y0": float(y), "x1": x + 40.0, "y1": y + 10.0, "text": t} for x, y, t in page] for page in printed[:2]]
    words = pd.Series([words[0] + words[1], words[1], None])
    out = grounding.page_checks.func(words, pd.Series(["ns", "mV", "ns"]), pd.Series(["tR1"] * 3), pd.Series(["Max"] * 3), pd.Series(["Symbol Max tR1"] * 3))
    assert len(made) == 3
    assert out.values.tolist() == [["ok", 1, "found"], ["mismatch", 1, "not_found"], ["not_found", 0, "not_found"]]
    for w, u, row in zip(words, ["ns", "mV", "ns"], out.itertuples(), strict=True):
        assert (grounding.find_unit(w or [], u, "tR1", "Max"), len(grounding.find_wrapped(w or [], "tR1"))) == (row.unit, row.wrapped)
