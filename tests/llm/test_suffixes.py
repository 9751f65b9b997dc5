"""Byte-level deduplication against a brute-force count of all windows."""

import hashlib
import random

import pytest

from quillstone.llm import suffixes

DOCS = "doc_id long, text string, lang string"


def brute(rows, length=100):
    docs = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    seen, out = set(), {}
    for null, i, text in docs:
        b = text.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        flags = bytes(gone)
        rest = bytes(x for x, g in zip(b, flags, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(flags) if g and (k == 0 or not flags[k - 1]))
        out[(None if null else i, text)] = (len(b), sum(flags), spans, hashlib.sha256(rest).hexdigest())
    return [(r[0], *out[(r[0], r[1] or "")]) for r in rows]


def corpus(n=120, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(300)]
    passage = " ".join(r.choices(words, k=60))
    rows = []
    for i in range(n):
        text = " ".join(r.choices(words, k=r.randint(0, 150)))
        k = r.random()
        if k < 0.3:
            at = r.randint(0, len(text))
            cut = r.randint(0, 80)
            text = text[:at] + passage[cut : len(passage) - r.randint(0, 80)] + text[at:]
        elif k < 0.5 and rows:
            text = r.choice(rows)[1] or ""
            if text and r.random() < 0.7:
                at = r.randint(0, len(text) - 1)
                text = text[:at] + "X" + text[at + 1 :]
        elif k < 0.55:
            text = "ab " * 120
        elif k < 0.6:
            text = passage * 3
        rows.append((i, text, "en"))
    return rows + [(n, None, None), (n + 1, "", "en"), (n + 2, "a" * 99, ""), (n + 3, "a" * 500, ""), (n + 4, "b" * 100, "")]


@pytest.mark.parametrize("tight", [False, True])
def test_as_brute_force(spark, monkeypatch, tight):
    if tight:  # so that tasks hold little at a time, and anchors are dealt to many of them
        monkeypatch.setattr(suffixes, "SPREAD", 1)
        monkeypatch.setattr(suffixes, "HELD", 3000)
        monkeypatch.setattr(suffixes, "CHUNK", 8000)
    rows = corpus()
    rows += [rows[5], (None, rows[7][1], "en"), (None, rows[30][1], "de")]
    random.Random(2).shuffle(rows)
    got = suffixes.deduplicate(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_empty(spark):
    assert suffixes.deduplicate(spark.createDataFrame([], DOCS)).count() == 0
