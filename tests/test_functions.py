"""Functions and operators against known values."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.functions import units as un
from quillstone.operators import chunking, cleaning, evaluate, library, search, verify
from quillstone.sources import loaders


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def texts(spark, rows, f, *more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    return [r.v for r in df.select("i", f(F.col("t"), *more).alias("v")).orderBy("i").collect()]


def agree(a, b):
    qa, qb = un.quantities_of(a)[0], un.quantities_of(b)[0]
    return qa["base"] == qb["base"] and any(abs(x - y) <= 1e-6 * max(abs(x), abs(y)) for x in qa["values"] for y in qb["values"])


@pytest.mark.parametrize(("a", "b", "same"), [("0,35 µs", "350 ns", True), ("400 kbit/s", "0.4 Mb/s", True), ("100 Ω", "0.1 kohm", True), ("1.2 V", "1.25 V", False), ("800 mVpp", "0.8 V", True)])
def test_quantities_agree(spark, a, b, same):
    assert agree(a, b) is same
    df = spark.createDataFrame([(a, b)], "a string, b string").select(un.find_quantities("a")[0].alias("x"), un.find_quantities("b")[0].alias("y"))
    assert df.select(un.same(F.col("x"), F.col("y"))).first()[0] is same


def test_quantities():
    found = [q["values"][0] for q in un.quantities_of("VDD 1.14 – 1.26 V, -40 °C to 85 °C")]
    assert found == [1.14, 1.26, -40.0, 85.0]
    assert un.quantities_of("3 states and 128b/130b encoding in DDR4") == []
    assert set(un.readings("1,200")) == {1.2, 1200.0} and un.readings("1.234,5") != [] and un.quantities_of(None) == []
    assert un.quantities_of("295⁽1⁾ ns")[0]["number"] == "295"


def test_text(spark):
    assert texts(spark, ["termi-\nnation ﬁeld", " a \r\n\r\n\r\n\r\n b\t\tc "], tx.normalize) == ["termination field", "a\n\nb c"]
    assert texts(spark, ["HIZI Hızı hizi", "Çöğüş"], tx.fold) == ["hizi hizi hizi", "cogus"]
    assert texts(spark, ["İletişim İvme", "the cat in a hat cat"], tx.search_terms) == [["iletişim", "ivme"], ["cat", "hat"]]
    assert texts(spark, ["see [1][2,3] or [4–6] not [9-3] nor [1-80]", "[x]"], tx.citations) == [[1, 2, 3, 4, 5, 6], []]
    assert texts(spark, ["1. takes 12,5 or 0x1F of [3], 7 and 100"], tx.bare_numbers) == [["12,5", "0x1F", "100"]]
    assert texts(spark, ["See fig. 3 now. tRFC is set. E.g. this. Done"], tx.sentences) == [["See fig. 3 now.", "tRFC is set.", "E.g. this.", "Done"]]
    assert texts(spark, ["Page 12 of 300", "xiv", "mix IV"], tx.number_key) == ["page # of #", "#", "mix #"]
    assert texts(spark, ["token = abc123 at 10.0.0.1:80 https://x.y/z"], tx.scrub) == ["token <redacted> at <address> <server>"]
    assert texts(spark, ["", "Haberleşme Arayüzleri"], tx.slug)[0] == "_root"
    assert texts(spark, ["Haberleşme Arayüzleri"], tx.slug)[0].startswith("haberlesme-arayuzleri-")
    assert texts(spark, ["nedir bu", "what is it", "değer"], tx.detect_language) == ["tr", "en", "tr"]
    assert texts(spark, ["a<think>b\nc</think>d", "lost</think> kept", "<think>x</think> a </think>b "], tx.strip_thinking) == ["ad", "kept", "b"]
    both = F.array(F.array(F.lit("1.5"), F.lit("zzz")), F.array(F.lit("volt")))
    assert texts(spark, ["is 1,5  Volt", "1.5 amp"], tx.contains_all, both) == [True, False]


@pytest.mark.parametrize(("line", "want"), [("4.2.6.3 Polling", (4, "4.2.6.3 Polling")), ("Appendix B Compliance", (1, "Appendix B Compliance")), ("3.3 V supply rail", None), ("### Third", (3, "Third")), ("A Device shall do", None), ("3 100 200 ns", None), ("2 Scope", (1, "2 Scope")), ("41 Scope", None), ("", None)])
def test_headings(spark, line, want):
    h = value(spark, cleaning.heading(F.lit(line), F.lit(True)))
    assert (h and (h.level, h.title)) == want


def test_header_footer_and_toc(spark):
    rows = [(1, p, p * 10 + k, t) for p in range(1, 8) for k, t in enumerate(["Some Standard Rev A", f"Body line {'abcdefg'[p - 1]} is here", "More of it", f"Page {p} of 7"])]
    rows[2:3] = [(1, 1, 12, "First page only")]
    df = spark.createDataFrame(rows, "doc_id int, page int, line_no int, line string")
    kept = {r.line for r in cleaning.headers_footers(df).where("not dropped").collect()}
    assert "Some Standard Rev A" not in kept and not any(x.startswith("Page") for x in kept) and "Body line c is here" in kept
    few = df.where("page <= 3")
    assert few.count() == cleaning.headers_footers(few).where("not dropped").count()
    toc = [(1, 1, i, f"Chapter {i} ........ {i * 3}") for i in range(10)] + [(1, 2, 20 + i, "plain prose here") for i in range(5)]
    assert [(r.doc_id, r.page) for r in cleaning.toc_pages(spark.createDataFrame(toc, "doc_id int, page int, line_no int, line string")).collect()] == [(1, 1)]


def test_section_stack(spark):
    rows = [(1, 1, "A"), (2, 2, "B"), (3, None, None), (4, 3, "C"), (5, 2, "D"), (6, None, None), (7, 1, "E"), (8, 3, "F")]
    df = spark.createDataFrame([(0, *r) for r in rows], "d int, o int, level int, title string")
    got = [r.section for r in cleaning.section_stack(df, ["d"], "o").orderBy("o").collect()]
    assert got == [["A"], ["A", "B"], ["A", "B"], ["A", "B", "C"], ["A", "D"], ["A", "D"], ["E"], ["E", "F"]]


def test_chunks_keep_their_bounds():
    r = random.Random(1)
    blocks = [(i // 3 + 1, " ".join(" ".join(r.choices(["Alpha", "beta", "gamma,"], k=12)).capitalize() + "." for _ in range(r.randint(1, 12))), "text", f"S{i // 5}") for i in range(40)]
    out = chunking.chunk(blocks, target=200, most=300, overlap=40)
    assert out and all(chunking.tokens(c["text"]) <= 360 for c in out) and [c["ordinal"] for c in out] == list(range(len(out)))
    for a, b in zip(out, out[1:], strict=False):
        if b["overlap"]:
            assert a["section"] == b["section"] and b["text"][: b["overlap"] - 2] in a["text"]
    table = "Table 1 Caption\n| a | b |\n|---|---|\n" + "\n".join(f"| r{i} | {i} |" for i in range(200))
    parts = chunking.table_parts(table, 120)
    assert len(parts) > 1 and all(p.startswith("Table 1 Caption\n| a | b |\n|---|---|") and chunking.tokens(p) <= 140 for p in parts)
    assert sum(p.count("| r") for p in parts) == 200


def test_bm25_as_written_out(spark):
    import math

    docs = [(1, "alpha beta beta gamma"), (2, "alpha alpha"), (3, "delta"), (4, "beta delta epsilon zeta eta"), (5, None)]
    df = spark.createDataFrame(docs, "id long, text string")
    q = spark.createDataFrame([(7, ["beta", "alpha", "nothing"]), (8, ["delta"])], "query_id long, terms array<string>")
    got = {(r.query_id, r.id): r.score for r in search.bm25(df, "id", {"text": 1.0}, q, 10).collect()}
    words = {i: (t or "").split() for i, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    for (qid, terms) in ((7, ["beta", "alpha"]), (8, ["delta"])):
        for i, w in words.items():
            s = 0.0
            for t in terms:
                n = sum(t in x for x in words.values())
                idf = math.log((len(words) - n + 0.5) / (n + 0.5))
                tf = w.count(t)
                s += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) if tf else 0
            assert abs(got.get((qid, i), 0) - s) < 1e-7


def test_fusion_budget_and_islands(spark):
    lists = spark.createDataFrame([(1, 0, 10, 1), (1, 0, 11, 2), (1, 1, 11, 1), (1, 1, 12, 2)], "query_id int, list_id int, id long, rank int")
    assert [r.id for r in search.fuse(lists, "id").orderBy("rank").collect()] == [11, 10, 12]
    rows = spark.createDataFrame([(1, 1, 900), (1, 2, 50), (1, 3, 100), (2, 1, 5000), (2, 2, 1)], "q int, o int, t int")
    assert sorted((r.q, r.o) for r in search.budget_prefix(rows, ["q"], [F.asc("o")], "t", 1000).collect()) == [(1, 1), (1, 2), (2, 1)]
    items = F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit(t).cast("long").alias("tokens")) for k, t in ((1, 60), (2, 50), (3, 30), (4, 20), (5, 10))])
    assert value(spark, search.budget_skip(items, 100)) == [1, 3, 5]


def test_revisions_and_supersedence(spark):
    keys = texts(spark, ["1.10", "1.9", "B", "C", "2.0r1"], library.revision_key)
    assert keys[1] < keys[0] < keys[2] < keys[3]
    rows = [(1, "s", "", "B"), (2, "s", "", "C"), (3, "t", "2020-01", "C"), (4, "t", "2021", "B"), (5, "u", "", "1.0"), (6, "u", "", "B"), (7, "v", "", "1"), (8, "v", "", "1")]
    got = {r.doc_id: r.superseded_by for r in library.supersedence(spark.createDataFrame(rows, "doc_id int, series string, doc_date string, revision string"), ["series"]).collect()}
    assert got == {1: 2, 2: None, 3: 4, 4: None, 5: None, 6: None, 7: None, 8: None}


def test_change_plan(spark):
    files = [("a", 1, 1, "x"), ("b", 2, 1, "y2"), ("c", 1, 2, "z"), ("new/d", 1, 1, "d"), ("e2", 1, 1, "x"), ("f", 5, 5, "f"), ("g", 1, 1, "g"), ("h", 1, 1, "h")]
    docs = [(1, "a", 1, 1, "x", "fp", False), (2, "b", 1, 1, "y", "fp", False), (3, "c", 1, 1, "z", "", False), (4, "d", 1, 1, "d", "fp", False), (5, "gone", 1, 1, "q", "fp", False), (6, "far/x", 1, 1, "w", "fp", False), (7, "g", 1, 1, "g", "old", False), (8, "h", 1, 1, "h", "fp", True)]
    plan = library.change_plan(spark.createDataFrame(files, "rel string, size int, mtime int, sha string"), spark.createDataFrame(docs, "doc_id long, rel string, size int, mtime int, sha string, fp string, missing boolean"), "fp", ["far/"])
    got = {r.rel: (r.action, r.from_doc) for r in plan.collect()}
    assert got == {"a": ("unchanged", None), "b": ("changed", None), "c": ("touched", None), "new/d": ("moved", 4), "e2": ("duplicate", 1), "f": ("new", None), "gone": ("missing", None), "far/x": ("unreachable", None), "g": ("settings", None), "h": ("restored", None)}


def test_claims_checks_and_verdicts(spark):
    answer = "# Timing\nSure. The value is 350 ns [1].\n\n| a | b |\n|---|---|\n| tRFC | 295 [2-3] |\n```\ncode 5\n```\n- Uses e.g. this [4]. Ends."
    got = [(c["kind"], c["text"], c["cites"], c["section"]) for c in verify.claims_of(answer)]
    assert got == [("text", "Sure.", [], "Timing"), ("text", "The value is 350 ns [1].", [1], "Timing"), ("row", "| tRFC | 295 [2-3] |", [2, 3], "Timing"), ("text", "Uses e.g. this [4].", [4], "Timing"), ("text", "Ends.", [], "Timing")]
    claims = spark.createDataFrame([(1, 1, "is 350 ns", [1]), (1, 2, "is 999 ns", [1]), (1, 3, "is so", []), (1, 4, "is so", [9]), (1, 5, "is so", [2]), (1, 6, "is 1,5 V", [1])], "answer_id int, claim_id int, text string, cites array<int>")
    src = spark.createDataFrame([(1, 1, "document", True, "states 350 and 1.5", 10), (1, 2, "calc", False, "999", 11), (1, 3, "document", True, "is 999 there", 10)], "answer_id int, n int, kind string, verified boolean, text string, doc_id long")
    checked = verify.check(claims, src)
    out = {r.claim_id: (r.status, r.codes) for r in checked.collect()}
    assert out == {1: ("pending", []), 2: ("unsupported", ["value_missing"]), 3: ("unsupported", ["no_citation"]), 4: ("unsupported", ["invalid_citation"]), 5: ("unsupported", ["unverified_source"]), 6: ("pending", [])}
    assert [(r.claim_id, r.add) for r in verify.repair(checked, claims, src).collect()] == [(2, 3)]
    given = spark.createDataFrame([(1, 1, "supported"), (1, 2, "supported"), (1, 2, "supported"), (1, 3, "perhaps"), (1, 4, None)], "answer_id int, claim_id int, verdict string")
    v = verify.verdicts(claims, given)
    assert {r.claim_id: r.verdict for r in v.collect()} == {1: "supported", 2: "invalid", 3: "invalid", 4: "invalid", 5: "missing", 6: "missing"}
    assert verify.compose(v).first().status == "warning"


def test_rates_over_nothing_are_null(spark):
    r = spark.createDataFrame([(1,), (None,)], "r int")
    m = evaluate.retrieval(r, "r").first()
    assert (m.n, m.recall_1, m.mrr) == (2, 0.5, 0.5)
    out = evaluate.rates(r, {"x": (F.lit(True), F.lit(False))}).first()
    assert (out.num, out.den, out.rate) == (0, 0, None)


def test_loaders(spark, tmp_path):
    (tmp_path / "a.md").write_text("# One\ntext here\n\nnext\fpage two", encoding="utf-8")
    (tmp_path / "b.html").write_text("<h2>Two</h2><p>a&amp;b<script>x</script></p><td>c</td>", encoding="utf-8")
    (tmp_path / "c.txt").write_bytes("şğİ".encode("cp1254"))
    (tmp_path / ".hidden.txt").write_text("x")
    (tmp_path / "d.xyz").write_text("x")
    import io
    import zipfile

    buf = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "e.docx").write_bytes(buf.getvalue())
    found = loaders.files(spark, str(tmp_path))
    got = {}
    for r in loaders.load(found).orderBy("path", "ord").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.page, r.text))
    assert got["a.md"] == [(1, "# One"), (1, "text here"), (1, "next"), (2, "page two")]
    assert got["b.html"] == [(1, "## Two"), (1, "a&b"), (1, "| c")] and got["c.txt"] == [(1, "şğİ")]
    assert got["e.docx"] == [(1, "# Head"), (1, "para"), (1, "| k |\n|---|")] and set(got) == {"a.md", "b.html", "c.txt", "e.docx"}
    assert {r.rel for r in found.select("rel").collect()} == {"a.md", "b.html", "c.txt", "d.xyz", "e.docx"}
    (tmp_path / "log.csv").write_text("﻿user;tokens\r\na;3\r\nb;4\r\n", encoding="utf-8")
    (tmp_path / "old.csv").write_text("user;time;tokens\nc;9;5\n", encoding="utf-8")
    log = loaders.usage_log(spark, str(tmp_path / "*.csv"), [["user", "tokens"], ["user", "time", "tokens"]])
    assert sorted((r.user, r.tokens, r.time) for r in log.collect()) == [("a", "3", None), ("b", "4", None), ("c", "5", "9")]
    e = loaders.embedding_of("hello world", 64)
    assert abs(sum(x * x for x in e) - 1) < 1e-9 and loaders.embedding_of("", 8) == [0.0] * 8


def test_sql_functions(spark, sf):
    from quillstone import sqlapi

    sqlapi.register(spark, sf)
    row = spark.sql("SELECT estimate_tokens('a b c d e') AS t, fold_letters('HIZI') AS f, fts_terms('İvme a ivme') AS s, find_quantities('5 ns')[0].base AS b").first()
    assert (row.t, row.f, row.s, row.b) == (6, "hizi", ["ivme"], "s")
    assert spark.sql("SELECT c.ordinal, c.text FROM (SELECT 'one\n\ntwo' AS t) x, LATERAL chunk_text(t) c").collect()[0].text == "one\n\ntwo"
    assert spark.sql("SELECT count(*) FROM documents").first()[0] == 200
    assert spark.sql("SELECT fts_terms('the cat in a hat cat') AS s, parse_citations('see [1][2,4-6]') AS c, scrub('token = abc123 at 10.0.0.1:80') AS x").first() == (["cat", "hat"], [1, 2, 4, 5, 6], "token <redacted> at <address>")


def test_clarification_rendering_and_plans(spark):
    from quillstone.operators import evidence, ingest, render

    items = [("heading", "# A"), ("text", "Here:"), ("blank", ""), ("heading", "## B"), ("head", "| a |"), ("sep", "|---|"), ("blank", ""), ("fence", "```"), ("fence", "```"), ("text", "Stays."), ("heading", "# C"), ("heading", "## D")]
    assert [t for _, t in render.tidy(items) if t] == ["# A", "## B", "Stays."]
    assert render.tidy([("head", "| a |"), ("sep", "|-|"), ("row", "| 1 |")]) == [("head", "| a |"), ("sep", "|-|"), ("row", "| 1 |")]
    assert render.tidy([("text", "one:"), ("text", "two:"), ("text", "three")]) == [("text", "two:"), ("text", "three")]
    assert render.tidy([("fence", "```"), ("code", "x"), ("fence", "```")]) == [("fence", "```"), ("code", "x"), ("fence", "```")]
    room = spark.createDataFrame([([(100, 0.9, True), (80, 0.5, False), (50, 0.2, False)],)], "p array<struct<tokens:long,score:double,parent:boolean>>")
    fits = lambda tokens, score, budget: room.select(evidence.fits_after_making_room(F.col("p"), F.struct(F.lit(tokens).alias("tokens"), F.lit(score).alias("score")), budget)).first()[0]
    assert fits(60, 0.4, 240) and not fits(60, 0.1, 240) and fits(120, 0.8, 220)
    docs = spark.createDataFrame([(1, "a", "v"), (2, "b", None)], "id int, name string, note string")
    assert sorted(tuple(r) for r in ingest.bulk_update(docs, spark.createDataFrame([(2, "c"), (1, None)], "id int, name string"), "id").collect()) == [(1, "a", "v"), (2, "c", None)]
    with pytest.raises(ValueError):
        library.compatible(spark.createDataFrame([("m", 3)], "model string, dim int"), "m", 4)
    library.compatible(spark.createDataFrame([("m", 3)], "model string, dim int"), "m", 3)
    words = ingest.dictionary("domains:\n  x: {}\n")
    assert set(words["domains"]) == {"x", "general"} and ingest.dictionary("")["terms"] == {}


def test_metadata(spark):
    from quillstone.functions import metadata as md

    names = ["JESD79-4C", "PCIe_Base_5.0_r1.0", "PCIe CEM 5.0", "PCIe Base 5.0 Errata", "Layout Guide rev B June 2021"]
    assert texts(spark, names, md.series) == ["jesd79-4", "pci express base", "pci express cem", "pci express base", "layout guide june"]
    assert texts(spark, names, md.revision) == ["C", "1.0", "", "", "B"]
    assert texts(spark, names, md.doc_type) == ["base", "base", "base", "errata", "guide"]
    assert texts(spark, ["x 2021-03", "March 2020", "1999", "none"], md.date) == ["2021-03", "2020-03", "1999", ""]
    assert texts(spark, ["PCIe_Base_5.0_r1.0", "v3"], md.version) == ["5.0", ""]
    assert [tuple(b) for b in texts(spark, ["a/b/c.txt", "c.txt", "/x/y.txt", "C:\\x\\y"], md.bucket)] == [("a", "b"), ("", ""), ("", ""), ("", "")]


def test_calculator(spark):
    from quillstone.functions import calc

    assert calc.evaluate("2 × (3 + 4)^2 - sqrt(16)") == 94 and calc.evaluate("-2**2 + max(1, 7 // 2, 2) * 2**-1") == -2.5
    for bad in ("__import__('os')", "2**1000", "x", "(1).real", "1+" * 200 + "1", "", "2 3", "min(1 2)", "(1"):
        with pytest.raises((ValueError, SyntaxError)):
            calc.evaluate(bad)

    def trace(expression, sources):
        df = spark.createDataFrame([(expression, n, t) for n, t in sources], "e string, n int, t string").withColumn("values", calc.stated_values(F.col("t")))
        df = df.groupBy("e").agg(F.array_sort(F.collect_list(F.struct("n", "values"))).alias("src")).select(calc.traced(calc.number_literals("e"), F.col("src")).alias("i"))
        row = df.select("i", calc.all_traced(F.col("i")).alias("ok")).first()
        return [{"value": x.value, "sources": x.sources} for x in row.i], row.ok

    inputs, ok = trace("350 * 1e-9 * 4", [(1, "is 0,35 µs"), (2, "350 there")])
    assert ok and inputs == [{"value": "350", "sources": [2]}]
    assert trace("4 * 4", [(1, "4")]) == ([], False) and not trace("99 + 1", [(1, "98")])[1]
    assert trace("3.5e-7 + 1", [(1, "is 0,35 µs"), (2, "3 V")]) == ([{"value": "3.5e-7", "sources": [1]}], True)
    assert calc.json_in('x {bad {"a": {"b": "}"}} y') == {"a": {"b": "}"}} and calc.json_in("none") is None
    text = "\n".join(["head", *[f"line {i} filler words" for i in range(40)], "tRFC 295 here", "tail"])
    cut = calc.excerpt(text, "value 295 of tRFC", 120)
    assert len(cut) <= 120 and "295" in cut and cut.startswith("head") and "[...]" in cut
    words = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "filing": "file", "happy": "happi", "generalizations": "gener", "controlling": "control"}
    assert {w: calc.stem(w) for w in words} == words


def test_statements(spark):
    from quillstone.functions import statements as st

    said = {
        "Sure, here it is:": True, "Hello there my friend": True, "**Note**": True, "": True, "Teşekkürler, umarım yardımcı olur": True, "# A heading": True,
        "The delay is 350 ns.": False, "Hello, DDR5 has ODT always.": False, "It is so [1].": False, "It takes 5 V always here": False, "Here is the DDR5 value we have": False, "# A sentence it is.": False,
    }
    assert texts(spark, list(said), st.framing) == list(said.values())
    facts = [
        ("tRFC is 0.35 µs [2]", "350", "ns", None, "correct"), ("tRFC is not 350 ns", "350", "ns", None, "conflict"), ("tRFC is 295 ns", "350", "ns", None, "conflict"), ("tXX is 350 ns", "350", "ns", None, "absent"),
        ("max tRFC is 350 ns", "350", "ns", "min", "conflict"), ("min tRFC is 350 ns", "350", "ns", "min", "correct"), ("tRFC is 350 ns, not 295", "350", "ns", None, "conflict"), ("tRFC is 350 ns or 295 ns", "350", "ns", None, "conflict"),
        ("tRFC is 350 ns for 16 Gb and 295 ns for 8 Gb", "350", "ns", None, "correct"), ("tRFC is 1,2", "1.2", "", None, "correct"), ("tRFC is long", "350", "ns", None, "absent"), (None, "350", "ns", None, "absent"),
        ("tRFC is 350 ns; the other one, which is quite far away from here, is not", "350", "ns", None, "correct"), ("tRFC is 4", "5", "", None, "conflict"),
    ]
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(facts)], "i int, s string, v string, u string, q string, want string")
    got = df.select("i", "s", "want", st.judge_fact(F.col("s"), F.array(F.lit("tRFC")), F.col("v"), F.col("u"), F.col("q")).alias("v")).collect()
    assert [(r.s, r.v) for r in got if r.v != r.want] == []
    one = spark.createDataFrame([("tRFC is 350 ns at 1x mode",), ("tRFC is 350 ns",)], "s string")
    assert [r.v for r in one.select(st.judge_fact(F.col("s"), F.array(F.lit("tRFC")), F.lit("350"), F.lit("ns"), conditions=F.array(F.lit("1X  mode"))).alias("v")).collect()] == ["correct", "absent"]


def test_table_quantities_and_kinds(spark):
    assert [(q["number"], q["unit"]) for q in un.table_quantities_of("tRFC, | 295 | - | ns")] == [("295", "ns")]
    assert un.table_quantities_of("tX | 4 | nCK") == []
    assert [q["values"][0] for q in un.table_quantities_of("| P | Min (V) |\n|---|---|\n| x | 1.2 |")] == [1.2]
    assert texts(spark, ["-", "n/a", "12", "1 to 2", "0.5 x VDD", "abc"], un.value_kind) == ["empty", "empty", "number", "range", "expression", "empty"]
    assert un.format_si(3.5e-7, "s") == "350 ns" and un.format_si(0, "V") == "0 V"


def test_grounding():
    from quillstone.operators import grounding as gr

    assert gr.norm_tokens("DDR4-3200") == ["ddr4", "3200"] and gr.norm_tokens("295ns") == ["295", "ns"] and gr.norm_tokens("1,2") == ["1.2"] and gr.norm_tokens("-40") == ["-40"]


def test_places_on_pages():
    from quillstone.operators import grounding as gr

    word = lambda x, y, t: {"x0": x, "y0": y, "x1": x + 40, "y1": y + 10, "text": t}
    page = [word(0, 0, "Symbol"), word(100, 0, "Min"), word(200, 0, "Unit"), word(0, 20, "Refresh"), word(45, 20, "cycle"), word(100, 20, "295"), word(200, 20, "ns"), word(0, 32, "time"), word(0, 60, "VDD"), word(100, 60, "1.2"), word(200, 60, "V")]
    assert len(gr.find_wrapped(page, "Refresh cycle time")) == 1 and gr.find_wrapped(page, "Refresh time cycle") == [] and gr.find_wrapped(page, "") == []
    assert gr.find_unit(page, "ns", "Refresh cycle time", "Min") == "ok" and gr.find_unit(page, "mV", "VDD", "Min") == "mismatch" and gr.find_unit(page[:3], "ns", "VDD", "Min") == "not_found"
    assert gr.locate(page, "VDD 1.2 V")[0] == "found" and gr.locate(page + [word(0, 90, "VDD"), word(100, 90, "1.2"), word(200, 90, "V")], "VDD 1.2 V")[0] == "ambiguous" and gr.locate(page, "something else")[0] == "not_found"


def test_records(spark, tmp_path):
    from quillstone.sources import records

    items = records.gold_items(spark, "- question: A?\n  expected_doc: x\n  expected_page: 3\n  facts: [{parameter: tRFC, value: 350, unit: ns}]\n  keywords: [a, [b, c]]\n- question: B?\n  answerable: false").collect()
    assert (items[0].document, items[0].pages, items[0].facts[0].value, items[0].keywords, items[1].answerable) == ("x", [3], "350", [["a"], ["b", "c"]], False)
    with pytest.raises(ValueError):
        records.gold_items(spark, "- {x: 1}")
    (tmp_path / "a.json").write_text('{"id": "a", "rating": "up", "question": "q", "sources": [{"n": 1, "file": "f", "page_start": 2}]}')
    (tmp_path / "b.json").write_text('{"id": "b", "rating": "down", "question": "r", "correction": {"value": "5", "unit": "ns", "page": 0}}')
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.json").write_text('{"id": "d", "question": "s", "unanswerable": true}')
    (tmp_path / "e.json").write_text('{"id": "e", "question": "t", "rating": "down"}')
    made = records.candidate_items(records.json_records(spark, str(tmp_path), records.FEEDBACK))
    assert {(r.id, r.answerable, r.document, r.page, r.value) for r in made.collect()} == {("a", True, "f", 2, None), ("b", True, None, None, "5"), ("d", False, None, None, None)}
    assert "answerable: false" in records.yaml_of(made)
