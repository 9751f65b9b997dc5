"""Evaluation, scopes and the whole check of claims: edges by example, and texts against plain Python."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.operators import evaluate, examine, scopes

FACT = "array<struct<parameter:array<string>,value:string,unit:string,qualifier:string,conditions:array<string>>>"
ITEM = f"id long, answerable boolean, clarify boolean, document string, revision string, pages array<int>, facts {FACT}, keywords array<array<string>>, expected array<array<string>>"


def plain_contains(text, expected):
    flat = lambda s: re.sub(r"[\s  ]+", " ", s.lower())
    forms = lambda a: [flat(a), flat(a).replace(".", ",")] if re.search(r"\d\.\d", a) else [flat(a)]
    return all(any(f in flat(text or "") for a in e for f in forms(a)) for e in expected or [])


_TEXT = st.text("ab1.5, \n A", max_size=8)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.none() | _TEXT, st.none() | st.lists(st.lists(_TEXT, max_size=2), max_size=2)), min_size=20, max_size=40))
def test_contains_all(spark, cases):
    df = spark.createDataFrame([(i, t, e) for i, (t, e) in enumerate(cases)], "i int, t string, e array<array<string>>")
    got = {r.i: r.x for r in df.select("i", evaluate.contains_all(F.col("t"), F.col("e")).alias("x")).collect()}
    assert got == {i: plain_contains(t, e) for i, (t, e) in enumerate(cases)}


def test_rungs(spark):
    fact = (["tRC"], "1.5", "", "", [])
    items = spark.createDataFrame(
        [(1, True, False, "Spec", None, [4], [fact], None, None), (2, True, False, None, None, None, [fact], None, [["zz"]]), (3, True, False, None, None, [], [], None, [["A b", "c"]]),
         (4, True, False, "spec", None, None, None, None, None), (5, True, False, None, None, None, None, None, None)], ITEM)
    hits = [(1, 1, "other", 4, 4, "1.5"), (1, 2, "the SPEC", 5, 9, "1.5"), (1, 3, "the SPEC", 3, 4, ""), (2, 1, None, 1, 1, "has 1,5"), (3, 1, "", 1, 1, "xa  B"), (4, 2, "spec", 1, 1, None), (5, 1, "spec", 1, 1, "x")]
    got = evaluate.first_ranks(items, spark.createDataFrame(hits, "id long, rank int, doc_text string, page_start int, page_end int, text string"))
    assert {r.id: r.first_rank for r in got.collect()} == {1: 3, 2: 1, 3: 1, 4: 2, 5: None}


def test_scores(spark):
    fact = (["tRC", "row cycle"], "45", "ns", "min", [])
    rows = [(i, i != 4, i == 3, "Spec" if i < 3 else None, "B", [7], [fact], [["ns", "us"]], [["45"]]) for i in range(1, 8)]
    items = spark.createDataFrame(rows, ITEM)
    answers = spark.createDataFrame([(1, "ok", "45", None), (2, "ok", "46", None), (3, "clarify", "", None), (4, "ok", "", None), (5, "ok", "", "broke"), (7, "ok", None, None)], "id long, status string, answer string, error string")
    claims = [(1, 1, "kept", "Row cycle min is 45 ns."), (1, 2, "removed", "tRC is 3 ns."), (2, 1, "kept", "tRC is 45 ns."), (2, 2, "flagged", "tRC is 46 ns."), (4, 1, "kept", "x"), (5, 1, "kept", "tRC is 45 ns.")]
    sources = [(1, True, "a spec", None, "b", 6, 8), (2, True, "spec", "", "A", 7, 7), (2, False, "spec", "", "B", 7, 7)]
    got = evaluate.score(items, answers, spark.createDataFrame(claims, "id long, claim_id int, outcome string, text string"), spark.createDataFrame(sources, "id long, cited boolean, title string, path string, revision string, page_start int, page_end int"))
    by = {r.id: r for r in got.collect()}
    seen = {i: (r.answered, r.correct, r.wrong, r.source_correct, r.page_correct, r.contains) for i, r in by.items()}
    assert seen == {
        1: (True, True, False, True, True, True), 2: (True, False, True, False, False, False), 3: (False, True, False, None, None, None), 4: (True, False, True, None, None, None),
        5: (None,) * 6, 6: (None,) * 6, 7: (False, False, False, None, None, False),
    }
    assert by[1].facts == ["correct"] and by[2].facts == ["conflict"] and by[7].facts == ["absent"]
    rates = {r.name: (r.num, r.den) for r in evaluate.answers(got).collect()}
    assert rates["answered_rate"] == (3, 5) and rates["source_accuracy"] == (1, 2)


DOC = "doc_id long, bucket string, domain string, entities array<string>, identity string, doc_type string, superseded boolean, missing boolean"
ASK = "ask long, buckets array<string>, doc_ids array<long>, domains array<string>, entities array<string>, routed array<string>, revisions array<long>"


@pytest.fixture(scope="module")
def library(spark):
    rows = [(1, "b", "x", ["DDR4"], "s1", "base", True, False), (2, "b", "x", ["DDR4"], "s1", "base", False, False), (3, "c", "x", ["DDR5"], "s2", "base", False, True), (4, None, "y", None, "s3", "note", False, False), (4, None, "y", None, "s3", "note", False, False)]
    return spark.createDataFrame(rows, DOC)


def test_scopes(spark, library):
    asks = spark.createDataFrame(
        [(1, ["b"], None, None, None, None, None), (2, ["b"], [4], None, None, None, [1]), (3, None, [3], None, ["DDR5"], None, None), (4, None, [3, 99], None, ["DDR5"], None, None), (5, None, [1], None, None, None, None), (6, None, None, ["x"], ["ddr4", "DDR5"], None, None),
         (7, None, None, None, ["none"], ["y"], None), (8, None, None, None, None, ["y"], None), (9, [], [], [], [], ["z"], [1]), (10, None, [4, 4], None, [None], None, None)], ASK)
    reasons, members = scopes.resolve(asks, library)
    got = {r.ask: (r.reason, r.found, r.absent, r.skipped, r.n_docs) for r in reasons.collect()}
    assert got == {
        1: ("user", [], [], 0, 1), 2: ("user", [], [], 0, 2), 3: ("user", [], [], 1, 0), 4: ("entity_missing", [], ["DDR5"], 1, 0), 5: ("user", [], [], 0, 1), 6: ("entity", ["ddr4"], ["DDR5"], 0, 1),
        7: ("entity_missing", [], ["none"], 0, 0), 8: ("domain", [], [], 0, 1), 9: ("all", [], [], 0, None), 10: ("user", [], [], 0, 1),
    }
    assert sorted(map(tuple, members.collect())) == [(1, 2), (2, 1), (2, 4), (5, 1), (6, 2), (8, 4), (10, 4)]
    assert sorted(map(tuple, scopes.whole(asks.where("ask = 9"), library).collect())) == [(9, 1, True), (9, 2, False)]


def test_scopes_of_empty_tables(spark, library):
    none = spark.createDataFrame([], ASK)
    assert scopes.resolve(none, library)[0].count() == 0
    one = spark.createDataFrame([(1, ["b"], None, None, None, None, None)], ASK)
    reasons, members = scopes.resolve(one, library.limit(0))
    assert [tuple(r) for r in reasons.collect()] == [(1, "user", [], [], 0, 0)] and members.count() == 0


SOURCE = "answer_id long, n int, doc_id long, kind string, verified boolean, head string, text string, traced boolean, unsourced int, from_user boolean"


def test_examined_and_mended(spark):
    src = spark.createDataFrame(
        [(1, 1, 10, "document", True, "Section 12", "tRC is 45 ns", None, None, None), (1, 2, 11, "document", True, None, "tRAS is 30 ns at 266 bins", None, None, None), (1, 3, 10, "document", True, None, "tRAS is 30 ns and 266", None, None, None),
         (1, 4, None, "document", False, None, "tRP is 8 ns", None, None, None), (1, 5, None, "user", None, None, "I have 99 ns", None, None, None), (1, 6, None, "calc", None, None, "= 7 ns", False, 1, None), (1, 7, None, "calc", None, None, "= 6 ns", True, 0, True)], SOURCE)
    said = {
        1: ("In section 12 it is 45 ns [1].", [1], "pending", []), 2: ("It is 12 and 45 ns [1].", [1], "unsupported", ["number_not_found"]), 3: ("tRAS is 0.03 us with 266 bins [1].", [1], "unsupported", ["value_not_found", "number_not_found"]),
        4: ("tRP is 8 ns [4].", [4], "unverified", ["unverified_source", "value_unverified_extraction"]), 5: ("It is 99 ns [5].", [5], "unsupported", ["user_value_as_documented"]), 6: ("If it is 99 ns [5].", [5], "pending", []),
        7: ("It is 7 ns [6].", [6], "unsupported", ["calc_input_unsourced"]), 8: ("It holds.", None, "unsupported", ["no_citation"]), 9: ("It holds [9].", [9, 9], "unsupported", ["invalid_citation", "no_citation"]), 10: (None, [1], "pending", []), 11: ("It is 6 ns [7].", [7], "unsupported", ["user_value_as_documented"]),
    }
    claims = spark.createDataFrame([(1, k, "fact", t, c) for k, (t, c, _, _) in said.items()], "answer_id long, claim_id int, kind string, text string, cites array<int>")
    out = examine.examine(claims, src)
    rows = {r.claim_id: r for r in out.collect()}
    assert {k: (r.status, r.codes) for k, r in rows.items()} == {k: (s, c) for k, (_, _, s, c) in said.items()}
    mended = {r.claim_id: (r.text, r.cites, r.added) for r in examine.mend(claims, src, out).collect()}
    assert mended.pop(3) == ("tRAS is 0.03 us with 266 bins [1][3].", [1, 3], 3)  # of the document cited already
    assert mended == {k: (t, c, None) for k, (t, c, _, _) in said.items() if k != 3}
