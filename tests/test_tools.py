"""Calls of tools stay within their question's scope, by example."""

import random

from pyspark.sql import functions as F

from quillstone import catalog, plans  # noqa: F401
from quillstone.operators import tools

DOCS = "doc_id long, bucket string, domain string, entities array<string>, identity string, doc_type string, superseded boolean, missing boolean"
ASKS = "ask long, buckets array<string>, doc_ids array<long>, domains array<string>, entities array<string>, routed array<string>, revisions array<long>"


def _given(spark):
    docs = spark.createDataFrame(
        [
            (1, "b", "ram", ["R4"], "i1", "base", False, False), (2, "b", "ram", ["R5", "X"], "i2", "base", False, False),
            (3, "b", "bus", ["P3"], "i3", "base", True, False), (4, "b", "bus", ["P3"], "i3", "base", False, False), (5, None, None, None, None, None, None, None),
        ],
        DOCS,
    )
    no: list = []
    asks = spark.createDataFrame(
        [
            (1, no, [1, 2], no, no, no, no), (2, no, no, no, ["R5"], no, no), (3, no, no, no, no, no, no), (4, no, no, no, no, ["ram"], no),
            (5, no, no, no, ["none"], no, no), (6, no, no, no, no, no, [3]), (7, None, None, None, None, None, None),
        ],
        ASKS,
    )
    return asks, docs


CALLS = [
    (10, 1, None, None, [1, 2]), (11, 1, "r4 ", None, [1]), (12, 1, "P3", "not_selected", []),
    (20, 2, "", None, [2]), (21, 2, "r5", None, [2]), (22, 2, "X", "outside", []), (23, 2, "R4", "outside", []),
    (30, 3, " ", None, None), (31, 3, "p3", None, [4]), (32, 3, "Q", "not_loaded", []),
    (40, 4, "R4", None, [1]), (41, 4, "P3", "outside", []), (42, 4, "Q", "not_loaded", []),
    (50, 5, None, "empty", []), (51, 5, "R4", "outside", []),
    (60, 6, "P3", None, [3]), (70, 7, None, None, None), (80, 99, "R4", "no_question", []), (81, None, None, "no_question", []),
]


def _permitted(spark):
    calls = spark.createDataFrame([c[:3] for c in CALLS], "call long, ask long, tag string")
    return tools.permitted(calls, *_given(spark))


def test_calls_narrow_and_never_widen(spark):
    outcomes, members = _permitted(spark)
    got, held = {r.call: (r.note, r.n_docs) for r in outcomes.collect()}, {}
    for r in members.collect():
        held.setdefault(r.call, []).append(r.doc_id)
    assert got == {c: (note, None if docs is None else len(docs)) for c, _, _, note, docs in CALLS}
    assert {c: sorted(v) for c, v in held.items()} == {c: docs for c, _, _, _, docs in CALLS if docs}


def test_rows_come_from_permitted_documents_only(spark):
    outcomes, members = _permitted(spark)
    given = [(i, d, t, v) for i, d, t, v in [(1, 1, ["a", "b", None], True), (2, 2, ["a", "a"], True), (3, 4, ["a"], False), (4, 4, ["b"], None), (5, None, ["a"], True), (6, 1, None, True)]]
    rows = spark.createDataFrame(given, "row_id long, doc_id long, terms array<string>, verified boolean")
    calls = spark.createDataFrame([(c[0], ["a", "b", None]) for c in CALLS], "call long, terms array<string>")
    found, unverified = tools.rows(calls, rows, outcomes, members, 2)
    got = {}
    for r in found.orderBy("call", "rank").collect():
        got.setdefault(r.call, []).append((r.row_id, r.score))
    of = {1: (1, 2), 2: (2, 1)}
    want = {c: [of[d] for d in docs if d in of] if docs is not None else [(1, 2), (2, 1)] for c, *_, docs in CALLS}
    assert got == {c: v for c, v in want.items() if v}
    assert {r.call: r.n_rows for r in unverified.collect()} == {30: 2, 31: 2, 70: 2}


def test_empty_tables(spark):
    asks, docs = _given(spark)
    none = lambda schema: spark.createDataFrame([], schema)
    calls = spark.createDataFrame([(1, 3, "R4"), (2, 3, None)], "call long, ask long, tag string")
    outcomes, members = tools.permitted(calls, asks, none(DOCS))
    assert {(r.call, r.note, r.n_docs) for r in outcomes.collect()} == {(1, "not_loaded", 0), (2, None, None)} and members.isEmpty()
    found, unverified = tools.rows(none("call long, terms array<string>"), none("row_id long, doc_id long, terms array<string>, verified boolean"), outcomes, members)
    assert found.isEmpty() and unverified.isEmpty()


def test_documents_of_a_tag_are_listed_once_not_for_each_call(spark):
    """The same outcomes and rows as from a list for each call, also where questions name revisions."""
    r = random.Random(3)
    docs = spark.createDataFrame([(i, "b", "d", [r.choice("ab"), "c"], f"i{i // 3}", r.choice(["base", "note"]), i % 3 == 0, i % 7 == 0) for i in range(60)], DOCS)
    asks = spark.createDataFrame([(a, [], [], [], [], [], [r.randrange(60)] if a % 2 else []) for a in range(30)], ASKS)
    calls = [(a * 3 + j, a, t, r.sample(["common", "x", "y", "none", None], 3)) for a in range(30) for j, t in enumerate(["a", "B ", "c"])]
    calls = spark.createDataFrame(calls, "call long, ask long, tag string, terms array<string>")
    given = [(i, r.randrange(60), ["common"] * (r.random() < 0.8) + r.sample(["x", "y", "z", None], 2), r.choice([True, True, False, None])) for i in range(400)]
    given = spark.createDataFrame(given, "row_id long, doc_id long, terms array<string>, verified boolean")
    outcomes, listed = tools.permitted(calls, asks, docs)
    same, members, tagged = tools.scoped(calls, asks, docs)
    assert members.isEmpty() and tagged.held.count() < 120 and listed.count() > 1000
    counted = {x["call"]: x["n"] for x in listed.groupBy("call").agg(F.count("*").alias("n")).collect()}
    assert {x["call"]: x.n_docs for x in same.collect()} == {c: counted.get(c, 0) for c in range(90)}
    for k in (1, 3, 10):
        slow, fast = tools.rows(calls, given, outcomes, listed, k), tools.rows(calls, given, same, members, k, tagged)
        for x, y in zip(slow, fast, strict=True):
            cols = sorted(x.columns)
            assert x.count() and sorted(map(tuple, x.select(cols).collect())) == sorted(map(tuple, y.select(cols).collect()))


def test_calls_on_the_whole_library_ask_with_their_common_terms_too(spark):
    """Against plain Python, where most rows have one of the terms."""
    r = random.Random(5)
    rows = [(i, r.choice([None, *range(20)]), ["common"] * (r.random() < 0.8) + r.sample(["x", "y", "z", None], 2), r.choice([True, True, False, None])) for i in range(300)]
    asked = [(c, r.sample(["common", "x", "y", "none", None], 3)) for c in range(30)]
    given = spark.createDataFrame(rows, "row_id long, doc_id long, terms array<string>, verified boolean")
    calls = spark.createDataFrame(asked, "call long, terms array<string>")
    outcomes = spark.createDataFrame([(c, None, None) for c, _ in asked], "call long, note string, n_docs long")
    for k in (1, 3, 10):
        found, unverified = tools.rows(calls, given, outcomes, spark.createDataFrame([], "call long, doc_id long"), k)
        want, bad = {}, {}
        for c, terms in asked:
            score = [(len(set(terms) & set(has) - {None}), i, ok) for i, _, has, ok in rows]
            want |= {(c, i): (s, n) for n, (s, i, _) in enumerate(sorted((x for x in score if x[0] and x[2]), key=lambda x: (-x[0], x[1]))[:k], 1)}
            bad |= {c: n for n in [sum(s > 0 and not ok for s, _, ok in score)] if n}
        assert {(x.call, x.row_id): (x.score, x["rank"]) for x in found.collect()} == want
        assert {x.call: x.n_rows for x in unverified.collect()} == bad


def test_tool_rows_leaves_no_term_out(spark, sf):
    """A call on the whole library has ten rows: more rows than that have its common term."""
    free = catalog.QUERIES["tool_scopes"](spark, sf).where("note is null and n_docs is null").select("call")
    found = catalog.QUERIES["tool_rows"](spark, sf).join(free, "call").groupBy("call").agg(F.count("*").alias("n"))
    assert free.count() > 10 and {r.n for r in found.collect()} == {10} and found.count() == free.count()
