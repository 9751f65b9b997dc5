"""Outlines, quality records, retries, clause links and tables found twice."""

import random

from pyspark.sql import functions as F

from quillstone.operators import outline as ol
from quillstone.operators import records


def test_a_line_that_names_a_title(spark):
    rows = [("4.2 Refresh Commands", "Refresh Commands", True), ("Refresh commands", "4.2 Refresh Commands", True), ("Refresh commands are issued by the controller at all times", "Refresh", False), ("Chapter 3 Timing", "Timing", True), ("Refresh Comma", "Refresh Commands of the device", True), ("Ref", "Refresh", False), ("", "x", False), ("4.2", "4.2 Refresh", False), ("abc", "1 abc", False)]
    df = spark.createDataFrame(rows, "line string, title string, want boolean")
    assert [r for r in df.withColumn("got", ol.names(F.col("line"), F.col("title"))).collect() if r.got != r.want] == []


def test_outline_or_headings(spark):
    entries = [(1, 0, 1, "1 Scope", 1), (1, 1, 2, "1.1 Terms", 3), (1, 2, 1, "2 Timing", 3), (1, 3, 2, "2.1 Refresh", 5), (2, 0, 1, "One", 1), (2, 1, 1, "Two", 2), (3, 0, 1, "A", 1), (3, 1, 1, "B", 2), (3, 2, 1, "C", 3), (4, 0, 1, "A", 1), (4, 1, 2, "B", 1), (4, 2, 2, "C", 1)]
    blocks = [
        (1, 0, 1, "Contents\n1 Scope\n2 Timing", False), (1, 1, 1, "1 Scope\nText.", False), (1, 2, 2, "2 Timing\nonly named here", False), (1, 3, 3, "2 Timing\nin a table", True),
        (1, 4, 3, "1.1 Terms\n2 Timing\nmore", False), (1, 5, 4, "body", False), (1, 6, 6, "late", False), (2, 0, 1, "3.1 Own\nx", False), (3, 0, 1, "A", False), (4, 0, 1, "B", False), (5, 0, 1, "z", False),
    ]
    docs = [(1, 6, False), (2, 2, False), (3, 400, False), (4, 1, True), (5, 1, False)]
    heads = [(1, 5, 1, "not used"), (2, 0, 2, "3.1 Own"), (4, 0, 1, "B")]
    o, b = spark.createDataFrame(entries, "doc_id long, nth long, level int, title string, page int"), spark.createDataFrame(blocks, "doc_id long, ordinal long, page int, text string, table boolean")
    d, h = spark.createDataFrame(docs, "doc_id long, n_pages int, docx boolean"), spark.createDataFrame(heads, "doc_id long, ordinal long, level int, title string")
    assert [r.doc_id for r in ol.usable(o, d).collect()] == [1], "too few entries, too coarse, a format with headings of its own"
    got = {(r.doc_id, r.ordinal): (r.section, r.by_outline) for r in ol.sections(o, b, d, h).collect()}
    one, terms, two = ["1 Scope"], ["1 Scope", "1.1 Terms"], ["2 Timing"]
    # The page of contents names its titles in later lines than the first, so it takes none of them.
    assert [got[1, k][0] for k in range(7)] == [[], one, one, one, two, two, ["2 Timing", "2.1 Refresh"]] and terms != two
    assert all(got[1, k][1] for k in range(7)) and got[2, 0] == (["3.1 Own"], False) and got[3, 0] == ([], False) and got[4, 0] == (["B"], False) and got[5, 0] == ([], False)
    assert len(got) == len(blocks)


def test_status_of_documents(spark):
    d = spark.createDataFrame([(1, None, 5, 4, 4), (2, "", 5, 4, 4), (3, "embedding", 5, 4, None), (4, "read", 5, None, None), (5, "read", 5, 4, 3)], "doc_id int, stage string, processed_at int, indexed_at int, last_ok_at int")
    i = spark.createDataFrame([(2, "vlm_failed", 7), (2, "vlm_failed", 3), (1, "no_text", 1), (4, "vlm_failed", 1)], "doc_id int, code string, page int")
    got = {r.doc_id: tuple(r)[1:] for r in records.quality(i, d).collect()}
    assert got == {1: ("ok", "", [], False, 5, False), 2: ("partial", "", [3, 7], False, 5, True), 3: ("failed", "embedding", [], True, 4, True), 4: ("failed", "read", [1], False, None, True), 5: ("failed", "read", [], True, 3, True)}


def brute_retry(pages, again, status):
    out, report = {}, {}
    for doc in {p[0] for p in pages} | {p[0] for p in again}:
        old, new = ({n: (f, c) for d, n, f, c in x if d == doc} for x in (pages, again))
        if status.get(doc, "ok") == "ok" or not new:
            out[doc] = old
            continue
        whole = status[doc] == "failed"
        merged = dict(new) if whole else old | {n: v for n, v in new.items() if n not in old or old[n][0]}
        bad = lambda x: sorted(n for n, (f, _) in x.items() if f)
        refused = not whole and len(bad(merged)) > len(bad(old))
        out[doc] = old if refused else merged
        report[doc] = ("document" if whole else "pages", "kept_existing" if refused else "partial" if bad(merged) else "ok", bad(out[doc]))
    return {(d, n): v for d, x in out.items() for n, v in x.items()}, report


def test_a_retry_mends_failed_pages_or_nothing(spark):
    r = random.Random(6)
    status = {d: r.choice(["ok", "partial", "partial", "failed"]) for d in range(60)}
    pages = [(d, n, r.random() < 0.3, f"old {n}") for d in range(60) for n in range(r.randint(0, 5))]
    again = [(d, n, r.random() < 0.4, f"new {n}") for d in range(60) for n in range(6) if r.random() < 0.5]
    schema = "doc_id int, page int, failed boolean, content string"
    merged, report = records.retry(spark.createDataFrame(pages, schema), spark.createDataFrame(again, schema), spark.createDataFrame(list(status.items()), "doc_id int, status string"))
    want, said = brute_retry(pages, again, status)
    assert {(x.doc_id, x.page): (x.failed, x.content) for x in merged.collect()} == want
    assert {x.doc_id: tuple(x)[1:] for x in report.collect()} == said and {v[1] for v in said.values()} == {"kept_existing", "partial", "ok"}


def test_a_retry_sorts_documents_once_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(records, "DOCUMENTS", 5)
    schema, ids = "doc_id int, page int, failed boolean, content string", range(100)
    pages = [(d, n, n == 1, "old") for d in ids for n in (1, 2)] + [(None, 1, True, "old"), (1, None, True, "old")]
    again = [(d, n, False, "new") for d in ids for n in (1, 3)] + [(None, 1, False, "new"), (1, None, False, "new")]
    status = spark.createDataFrame([(d, "partial" if d % 2 else "ok") for d in ids], "doc_id int, status string")
    merged, _ = records.retry(spark.createDataFrame(pages, schema), spark.createDataFrame(again, schema), status)
    got = sorted(((x.doc_id, x.page, x.failed, x.content) for x in merged.collect()), key=str)
    want = [(d, 1, not d % 2, "new" if d % 2 else "old") for d in ids] + [(d, 2, False, "old") for d in ids] + [(d, 3, False, "new") for d in ids if d % 2]
    assert got == sorted(want + [(None, 1, True, "old"), (1, None, True, "old"), (1, None, False, "new")], key=str)
    steps = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in steps and "RepartitionByExpression [doc_id" in steps and ", 20" in steps.split("RepartitionByExpression [doc_id")[1].split("\n")[0]


def test_clause_links(spark):
    e = spark.createDataFrame([(1, 10, "In section 4.2 and § 7.1 read; Clause 4.2 again."), (2, 10, "sec. 9.9"), (3, 11, "section 4.2"), (4, 10, None)], "erratum int, doc_id int, text string")
    a = spark.createDataFrame([(10, 20), (11, 21)], "doc_id int, base_id int")
    p = spark.createDataFrame([(100, 20, "4 A > 4.2 B"), (101, 20, "4 A > 4.2.1 C"), (102, 20, "4.20 D"), (103, 20, "7.1x E"), (104, 20, "Annex > 7.1 F"), (105, 21, "4.2 Other"), (106, 22, "4.2 Not amended"), (107, 20, None)], "passage int, doc_id int, section string")
    assert sorted(map(tuple, records.clause_links(e, a, p).collect())) == [(1, "4.2", 100), (1, "4.2", 101), (1, "7.1", 104), (3, "4.2", 105)]


def test_tables_are_taken_once(spark):
    box = lambda y: (0.0, float(y), 100.0, y + 10.0)
    read = [(1, 1, 1, "Symbol Min tRFC 350", box(0), "4-2"), (1, 1, 2, "Symbol Min tRFC 350", box(0), None), (1, 1, 3, "else", box(90), "9"), (1, 2, 4, "a b c", None, None)]
    printed = [(1, 1, 7, "Symbol Min\ntRFC 350", box(0), "Table 4-2: Timing"), (1, 1, 8, "Symbol Max\ntXS 1", box(50), "Table 9"), (1, 2, 9, "a b", None, None)]
    kind = "struct<x0:double,y0:double,x1:double,y1:double>"
    s = records.table_scores(spark.createDataFrame(read, f"doc_id int, page int, a int, text string, box {kind}, ref string"), spark.createDataFrame(printed, f"doc_id int, page int, b int, text string, box {kind}, before string"))
    got = {(x.a, x.b): x.score for x in s.collect()}
    assert got[1, 7] == 1.8 and got[2, 7] == 1.5 and got[3, 8] == 0.3 and got[4, 9] == round(2 / 3, 6)
    assert sorted((x.a, x.b) for x in records.claim_once(s).collect()) == [(1, 7), (4, 9)], "the second reading finds its table taken"


def brute_claims(scores):
    out = []
    for page in sorted({s[1] for s in scores}):
        taken = set()
        for a in sorted({s[2] for s in scores if s[1] == page}):
            free = sorted([(-v, b) for _, p, x, b, v in scores if p == page and x == a and b not in taken])
            if free and -free[0][0] >= 0.5 and (len(free) == 1 or -free[1][0] < -free[0][0] - 0.15):
                taken.add(free[0][1])
                out.append((page, a, free[0][1]))
    return out


def test_claims_as_plain_python(spark):
    r = random.Random(9)
    rows = [(1, p, a, b, r.choice([0.2, 0.45, 0.5, 0.6, 0.7, 0.8, 1.0])) for p in range(30) for a in range(r.randint(1, 5)) for b in range(r.randint(1, 4))]
    got = records.claim_once(spark.createDataFrame(rows, "doc_id int, page int, a int, b int, score double")).collect()
    assert sorted((x.page, x.a, x.b) for x in got) == brute_claims(rows)
