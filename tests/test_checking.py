"""Citation spans, support, eviction, grounding by pages and keyed streams against plain Python and by example."""

import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from quillstone import catalog, plans  # noqa: F401
from quillstone.operators import citing, evidence, pages, support
from quillstone.streaming import events as ev
from quillstone.streaming import thoughts

# --- citation spans


def brute_spans(text, claims):
    blank, fence = [], False
    for line in text.split("\n"):
        mark = re.match(r"\s*```", line)
        blank.append(" " * len(line) if mark or fence else re.sub("`[^`]+`", lambda m: " " * len(m[0]), line))
        fence ^= bool(mark)
    spans, at = [], 0
    for i, t, outcome in claims:
        if outcome in ("kept", "flagged") and t:
            lo = text.find(t, at) if t in text[at:] else text.find(t)
            if lo >= 0:
                spans.append((lo, lo + len(t), i))
                at = lo + len(t)
    out = []
    for m in re.finditer(r"\[(\d+(?:\s*[,–-]\s*\d+)*)\]", "\n".join(blank)):
        own = next((i for lo, hi, i in spans if lo <= m.start() < hi), None)
        for part in re.split(r"\s*,\s*", m[1]):
            ends = [int(x) for x in re.split(r"\s*[–-]\s*", part)]
            numbers = ends if len(ends) == 1 else range(ends[0], ends[1] + 1) if len(ends) == 2 and 0 < ends[1] - ends[0] < 50 else []
            out += [(m.start(), n, own) for n in numbers]
    return out


def test_citation_spans_as_plain_python(spark):
    r = random.Random(4)
    answers, claims = [], []
    for i in range(60):
        parts = [r.choice(["A b [1].", "A b [1].", "Süß 😀 x [2, 3] y.", "Of `x [4]` and [5-7].", "No mark.", "\n```\ncode [8]\n```\n", "[9]", "Odd [60-2] [1-90].", "`", "\n"]) for _ in range(r.randint(0, 9))]
        answers.append((i, " ".join(parts) + (" ``` [3]" if i % 7 == 0 else "\n```\n[1] open" if i % 7 == 1 else "")))
        claims += [(i, k, p.strip() if k % 4 else p, r.choice(["kept", "kept", "flagged", "dropped"])) for k, p in enumerate(parts)]
    answers += [(90, None), (91, ""), (92, "x [1]")]
    claims += [(92, 1, None, "kept"), (92, 2, "not there", "kept"), (99, 1, "x", "kept")]
    got = citing.citation_spans(spark.createDataFrame(answers, "answer_id long, text string"), spark.createDataFrame(claims, "answer_id long, claim_id long, text string, outcome string")).collect()
    for i, text in answers:
        rows = sorted((x.nth, x["at"], x.number, x.claim_id) for x in got if x.answer_id == i)
        want = brute_spans(text or "", [c[1:] for c in claims if c[0] == i])
        # places count characters, as Spark does
        assert [x[1:] for x in rows] == want and [x[0] for x in rows] == list(range(len(want))), (text, rows, want)


# --- support


def test_support_takes_no_more_than_it_needs(spark):
    units = [
        (1, 0, "text", "The interval is 295 ns at 8 Gb.", None), (1, 1, "text", "It is 295 and 350 here.", None), (1, 2, "text", "And 41 alone.", None), (1, 3, "text", "Nothing of note.", None),
        (1, 4, "row", "| tXS | 1.25 | - |", ["Symbol", "Min (ns)", "Max"]), (1, 5, "header", "| Symbol | 800 |", []),
        (2, 0, "text", "The refresh counter restarts afterwards.", None), (2, 1, "text", "Then the refresh counter restarts afterwards!", None), (2, 2, "text", "RTT and MR1 are set.", None), (2, 3, "text", "RTT is left.", None),
    ]
    claims = [(10, 1, "Values 295, 350 and 41 hold [7]."), (11, 1, "It takes 1250 ps [1]."), (12, 1, "The value 295 holds."), (13, 2, "The refresh counter restarts afterwards."), (14, 2, "RTT MR1 nicht gesetzt"), (15, 1, "The 800 bin."), (16, 9, "No source 12."), (17, 1, "Values 77 are nowhere.")]
    u = spark.createDataFrame(units, "doc_id long, unit_id long, kind string, text string, header array<string>")
    out = support.cover(spark.createDataFrame(claims, "claim_id long, doc_id long, text string"), u).collect()
    got = {}
    for x in sorted(out, key=lambda x: (x.claim_id, x.nth)):
        got.setdefault(x.claim_id, []).append((x.unit_id, x.numbers))
    assert got[10] == [(1, ["295", "350"]), (2, ["41"])]  # the first unit states nothing that is still missing
    assert got[11] == [(4, ["1.25"])] and [i for i, _ in got[12]] == [0] and got[15] == [(5, ["800"])]
    assert 13 not in got, "two different units carry it equally well"
    assert got[14] == [(2, [])] and 16 not in got and 17 not in got


def brute_cover(nums, units, most):
    scored = sorted([(-3 * len(set(nums) & set(h)), i, h) for i, h in units if set(nums) & set(h)])
    chosen, covered = [], set()
    for _, i, h in scored:
        new = set(nums) & set(h) - covered
        if len(chosen) < most and (new or not chosen):
            chosen.append(i)
            covered |= new
    return chosen


@pytest.mark.parametrize("most", [1, 3, 8])
def test_cover_as_plain_python(spark, most):
    r = random.Random(most)
    claims, units, want = [], [], {}
    for c in range(40):
        nums = [str(n) for n in r.sample(range(10, 99), r.randint(1, 6))]
        us = [(i, [str(n) for n in r.sample(range(10, 99), 3)] + r.sample(nums, r.randint(0, len(nums)))) for i in range(8)]
        claims.append((c, c, " und ".join(nums)))
        units += [(c, i, "text", " zu ".join(h), None) for i, h in us]
        want[c] = brute_cover(nums, us, most)
    out = support.cover(spark.createDataFrame(claims, "claim_id long, doc_id long, text string"), spark.createDataFrame(units, "doc_id long, unit_id long, kind string, text string, header array<string>"), most).collect()
    got = {c: [x.unit_id for x in sorted(out, key=lambda x: x.nth) if x.claim_id == c] for c in want}
    assert got == want


# --- eviction


def brute_room(ps, rs, budget):
    kept, added, parents = list(ps), [], {r[3] for r in rs}
    for i, tokens, score, _ in rs:
        over = sum(p[1] for p in kept) + sum(a[1] for a in added) + tokens - budget
        gone = []
        for p in sorted((p for p in reversed(kept) if p[0] not in parents and p[2] < score), key=lambda p: p[2]):
            if over <= 0:
                break
            gone.append(p)
            over -= p[1]
        if over <= 0:
            kept = [p for p in kept if p not in gone]
            added.append((i, tokens))
    return [(p[0], False) for p in kept] + [(a[0], True) for a in added]


def test_references_push_out_what_scores_less(spark):
    r = random.Random(1)
    ps, rs, want = [], [], {}
    for q in range(80):
        own = [(i, r.randint(10, 300), r.choice([0.1, 0.2, 0.5, 0.5, 0.9])) for i in range(r.randint(1, 8))]
        refs = [(100 + k, r.randint(10, 400), r.choice([0.15, 0.45, 0.81]), r.randrange(len(own))) for k in range(r.randint(0, 3))]
        ps += [(q, n, *p) for n, p in enumerate(own)]
        rs += [(q, n, *x) for n, x in enumerate(refs)]
        want[q] = brute_room(own, refs, 700)
    out = evidence.make_room(spark.createDataFrame(ps, "query_id int, nth int, id int, tokens int, score double"), spark.createDataFrame(rs, "query_id int, nth int, id int, tokens int, score double, parent int"), 700).collect()
    assert {q: [(x.id, x.added) for x in sorted(out, key=lambda x: x.place) if x.query_id == q] for q in want} == want
    assert any(len(w) < sum(p[0] == q for p in ps) + sum(x[0] == q for x in rs) for q, w in want.items())


# --- grounding


def page(rows, top=100.0, xs=(60, 155, 250, 345, 440), more=()):
    """Rows of cells at left edges xs, 20 apart; a cell's words stand behind each other."""
    words = list(more)
    for r, row in enumerate(rows):
        for x, cell in zip(xs, row, strict=False):
            for w in cell.split():
                words.append((float(x), top + 20 * r, x + 5.0 * len(w), top + 20 * r + 10, w, False))
                x += 5 * len(w) + 4
    return pages.Page(pages.reading_order(words))


HEAD = ["Parameter", "Symbol", "Min", "Max", "Unit"]


def status(p, before=None, **kw):
    return pages.ground_parameter(p, kw, before)


def test_a_swap_a_wrong_unit_and_another_row():
    p = page([HEAD, ["Refresh cycle", "tRFC", "350", "-", "ns"], ["Exit time", "tXS", "-", "410", "ns"]])
    own = {"parameter": "Refresh cycle", "symbol": "tRFC", "unit": "ns"}
    assert status(p, **own, min="350") == "grounded" and status(p, **own, max="350") == "conflict"
    assert status(p, **{**own, "unit": "us"}, min="350") == "unit_mismatch" and status(p, **{**own, "unit": "furlong"}, min="350") in ("unit_mismatch", "unit_not_found")
    assert status(p, parameter="Exit time", symbol="tXS", min="350", unit="ns") == "not_found"
    assert status(p, symbol="t RFC", min="350") == "grounded", "a symbol with a blank"
    assert status(p, **own) == "no_value" and status(pages.Page([]), **own, min="1") == "no_text_layer" and status(None, **own) == "unchecked"
    assert status(p, **own, min="350", conditions="at 85C") == "condition_not_found"


def test_no_head_no_ground():
    p = page([["Refresh", "tRFC", "295", "350", "ns"]])
    assert status(p, symbol="tRFC", max="295") == "not_found"
    assert status(p, page([HEAD]), symbol="tRFC", max="295") == "conflict", "the page before says that it is the least"
    assert status(p, page([HEAD]), symbol="tRFC", max="350", unit="ns") == "grounded"
    assert pages.ground_value(p, "350", ["tRFC"], ["Max"], before=page([HEAD])).head_before


def test_numbers_elsewhere_do_not_count_and_two_rows_are_ambiguous():
    body = [(60.0 + 40 * i, 40.0, 90.0 + 40 * i, 50.0, w, False) for i, w in enumerate("the value 350 of tXS".split())]
    p = page([HEAD, ["Refresh", "tRFC", "350", "-", "ns"], ["Exit", "tXS", "350", "-", "ns"], ["Again", "tXS", "350", "-", "ns"]], more=body)
    assert status(p, symbol="tRFC", min="350") == "grounded" and status(p, symbol="tXS", min="350") == "ambiguous"


def test_groups_above_the_head_and_conditions_in_the_row():
    p = page([["", "", "DDR4-1600", "", "DDR4-3200"], ["Parameter", "Symbol", "Min", "Max", "Min"], ["Refresh", "tRFC", "350", "-", "260"]])
    assert status(p, symbol="tRFC", min="260", conditions="DDR4-3200") == "grounded"
    assert status(p, symbol="tRFC", min="260", conditions="DDR4-1600") == "conflict"
    assert status(p, symbol="tRFC", min="350", conditions="DDR4-1600") == "grounded"
    words = [(60.0, 130.0, 80.0, 140.0, "tRFC", False)]  # one label for two rows
    p = page([["Symbol", "Density", "Min", "Unit"], ["", "8 Gb", "350", "ns"], ["", "16 Gb", "550", "ns"]], more=words)
    assert status(p, symbol="tRFC", min="550", unit="ns", conditions="16 Gb") == "grounded"
    assert status(p, symbol="tRFC", min="550", unit="ns", conditions="8 Gb") != "grounded"


def test_three_streams():
    w = [(60.0, 100.0, 65.0, 110.0, "t", False), (65.2, 103.0, 80.0, 111.0, "RFC", False), (250.0, 100.0, 265.0, 110.0, "295", False), (265.5, 98.0, 268.0, 102.0, "1", True)]
    p = page([], more=[*w, (60.0, 60.0, 90.0, 70.0, "Symbol", False), (250.0, 60.0, 270.0, 70.0, "Min", False)])
    assert p.find("tRFC") and p.find("t RFC") and p.find("295") and p.find("295 1") and not p.find("1")
    assert pages.ground_value(p, "295", ["tRFC"], ["Min"]).status == "grounded"


def test_every_phrase_is_found_where_a_scan_finds_it():
    r = random.Random(3)
    words = [(float(x), float(y), x + 8.0, y + 9.0, r.choice("a b c 1 2 1.5 ab".split()), r.random() < 0.1) for y in range(0, 200, 20) for x in range(0, 200, 20)]
    p = pages.Page(words)
    for _ in range(200):
        want = r.choices("a b c 1 2 1.5 ab".split(), k=r.randint(1, 4))
        scan = set()
        for tokens, of in p.streams:
            scan |= {frozenset(w for ws in of[i : i + len(want)] for w in ws) for i in range(len(tokens) - len(want) + 1) if tokens[i : i + len(want)] == want}
        assert {x.words for x in p.find(" ".join(want))} == {s for s in scan if not all(words[w][5] for w in s)}


def test_grounding_by_pages(spark):
    head, first, last = page([HEAD]), page([HEAD, ["Refresh", "tRFC", "350", "-", "ns"]]), page([["Exit", "tXS", "-", "410", "ns"]])
    rows = [(d, n, *w) for d, n, p in ((1, 1, first), (1, 2, last), (2, 7, last), (3, 1, head)) for w in p.words]
    words = spark.createDataFrame(rows, "doc_id int, page int, x0 double, y0 double, x1 double, y1 double, text string, raised boolean").withColumn("own", F.lit("x"))
    v = [(1, 1, 1, "350", ["tRFC"], ["Min"], None), (1, 2, 2, "410", ["tXS"], ["Max"], []), (1, 2, 3, "410", ["tXS"], ["Min"], []), (2, 7, 4, "410", ["tXS"], ["Max"], []), (5, 1, 5, "1", ["a"], ["b"], []), (1, 1, 6, None, None, None, None)]
    values = spark.createDataFrame(v, "doc_id int, page int, value_id int, value string, labels array<string>, heads array<string>, groups array<string>")
    got = {x.value_id: (x.status, x.head_before) for x in pages.ground_values(values, words).collect()}
    assert got == {1: ("grounded", False), 2: ("grounded", True), 3: ("conflict", False), 4: ("not_found", False), 5: ("no_text_layer", False), 6: ("not_found", False)}
    assert pages.ground_values(values.where("false"), words).count() == 0


# --- thoughts


def whole(text):
    out, inside = ["", ""], False
    while text:
        tag = thoughts.TAGS[inside]
        head, found, text = text.partition(tag)
        out[inside] += head
        inside ^= bool(found)
    return tuple(out)


def test_pieces_cut_anywhere():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(["<think>", "</think>", "<", "th", "ink>", "</", "x", " ö"]) for _ in range(r.randint(0, 12)))
        said, inside, held = ["", ""], False, ""
        cuts = sorted(r.randint(0, len(text)) for _ in range(6))
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        for n, p in enumerate(pieces):
            out, inside, held = thoughts.part(held + p, inside, n == len(pieces) - 1)
            said = [a + b for a, b in zip(said, out, strict=True)]
            assert len(held) < 8
        assert tuple(said) == whole(text) and held == ""


def test_keyed_state_over_micro_batches(spark):
    r = random.Random(5)
    texts = {i: "".join(r.choice(["<think>", "</think>", "abc", "<th", " "]) for _ in range(10)) for i in range(12)}
    folder = f"file://{tempfile.mkdtemp()}/pieces"
    for k in range(4):
        rows = []
        for i, t in texts.items():
            step = len(t) // 4 + 1
            part = t[k * step : (k + 1) * step]
            rows += [(i, k * 1000 + n, c, k == 3 and n == max(0, len(part) - 1)) for n, c in enumerate(part or [""])]
        r.shuffle(rows)
        spark.createDataFrame(rows, "stream_id long, at int, text string, last boolean").coalesce(1).write.mode("append").parquet(folder)
    out = ev.run_available(spark, folder, thoughts.split_stream, files=1).collect()
    for i, t in texts.items():
        rows = sorted((x["at"], x.answer, x.thoughts) for x in out if x.stream_id == i)
        assert ("".join(x[1] for x in rows), "".join(x[2] for x in rows)) == whole(t)


def test_support_units_takes_no_part_that_adds_nothing(spark, tmp_path):
    """The query's cover: a part that states all of a passage's numbers stands alone, and rows of tables are parts too."""
    docs = [
        (1, "Head of it. The limit is 45 parts at 12 degrees. The limit is 45 parts again. The limit at 12 degrees holds.", "en", "web", 0),
        (2, "Widths of the port here.\n\n| Name | Width |\n|---|---|\n| lane A | 77 |\n| lane B | 78 |", "en", "web", 0),
    ]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(1, "The limit is 45 parts at 12 degrees."), (2, "| lane B | 78 |")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = catalog.QUERIES["support_units"](spark, str(tmp_path)).collect()
    assert sorted((r.claim_id, r.nth, r.unit_id) for r in out) == [(1, 1, 1), (2, 1, 3)]
