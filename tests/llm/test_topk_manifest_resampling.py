"""Top-k, manifest and resampling against plain Python, over awkward rows and over none."""

import math
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import manifest, resampling, topk


def near(x):
    return sorted(map(tuple, x), key=repr)


# --- exact top-k


def brute_topk(rows, k=20):
    """rows: (vec_id, embedding); those of which the id divides by 5 ask."""
    fine = [(i, [math.floor(64 * v) for v in x]) for i, x in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for n, (q, a) in enumerate(fine):
        if q is None or q % 5:
            continue
        found = [(-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b, strict=True)))), i is None, i or 0) for m, (i, b) in enumerate(fine) if m != n and len(a) == len(b)]
        out += [(q, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return near(out)


def vector_rows(seed, n=400, width=12):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, width)) * r.lognormal(sigma=1, size=(n, 1))
    x[: n // 3] = x[0]  # a third are copies
    x[n // 3 : n // 2] = np.abs(x[n // 3 : n // 2])
    x[n // 2 : n // 2 + 20] += 0.05 * r.normal(size=(20, width)) + x[n // 2]
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize(("segment", "block", "bucket"), [(64, 16, 16), (1000, 7, 1000), (8192, 2048, 1024)])
def test_topk_as_brute_force(spark, monkeypatch, segment, block, bucket):
    monkeypatch.setattr(topk._meet, "__defaults__", (bucket,))
    rows = vector_rows(segment)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = topk.search(df, F.col("vec_id") % 5 == 0, segment=segment, block=block).collect()
    assert near(got) == brute_topk(rows)


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.0, 0.0]), (5, [-1.0, -2.0]), (10, [1.0, 1.0]), (10, [1.0, 1.0]), (None, [1.0, 1.0]), (None, None), (15, []), (20, []), (25, [nan, 1.0]), (30, [1.0, None]), (35, [inf, 0.0])]
    rows += [(40, [1e9, -1e9]), (41, [1e9, 1e9]), (45, [1e18, 1e18]), (50, [1e-9, -1e-9]), (55, [1.0, 2.0, 3.0]), (56, [0.5, 0.5, 0.5]), (60, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit("x")).withColumn("query", F.lit(1)).withColumn("norm", F.lit(None))
    assert near(topk.search(df, F.col("vec_id") % 5 == 0).collect()) == brute_topk(rows)
    assert topk.search(df.where("false"), F.col("vec_id") % 5 == 0).count() == 0
    assert topk.search(df, F.lit(False)).count() == 0


def test_topk_few_and_equal_lengths(spark):
    rows = [(i, [math.cos(i), math.sin(i)]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert near(topk.search(df, F.col("vec_id") % 5 == 0).collect()) == brute_topk(rows)


def test_coordinates_keep_all_that_reach_the_cosine():
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 6))
    b = topk._Bucket(x, np.linalg.norm(x, axis=1))
    for q in r.normal(size=(40, 6)):
        u = q / np.linalg.norm(q)
        for c in (-0.5, 0.1, 0.5, 0.8, 0.95):
            rows = b.by_coordinates(u, c)
            assert set(np.flatnonzero(b.unit @ u >= c)) <= set(rows.tolist())
    assert len(b.by_coordinates(b.unit[3], 0.95)) < 50


# --- manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_leaf(d, text):
    parts = [d["doc_id"], d["source"], d["lang"], d["n_chars"], text]
    return h(*["-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts])


def rise(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, i):
    out = []
    for nodes in levels[:-1]:
        first = i - i % 16
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 16])))
        i //= 16
    return out


def brute_manifest(docs, hit):
    groups = defaultdict(list)
    for d in docs:
        changed = None if d["text"] is None or not hit(d) else re.sub("[A-Z]", lambda m: m[0].lower(), d["text"])
        groups[d["source"]].append((d["doc_id"] is not None, d["doc_id"] or 0, brute_leaf(d, d["text"]), d["doc_id"], None if changed is None else brute_leaf(d, changed)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: rise([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    top = rise([trees[s][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for i, (_, _, leaf, doc_id, other) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path, up = way(trees[s], i) + way(top, n), other or leaf
            for a, b in path:
                up = h(a, up, b)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], h(*[a + b for a, b in path]), up, up == top[-1][0]))
    return near(out)


def tampered(d):
    return d["doc_id"] is not None and crc32(str(d["doc_id"]).encode()) % 5 == 0


def checked(docs):
    hit = F.crc32(docs["doc_id"].cast("string")) % 5 == 0
    return near(manifest.manifest(docs, F.when(hit, manifest.lower_ascii(docs["text"]))).collect())


def test_manifest_of_hard_rows(hard, empty):
    want = brute_manifest([r.asDict() for r in hard.collect()], tampered)
    assert checked(hard) == want and checked(hard.repartition(9)) == want
    assert not all(r[-1] for r in want) and any(r[-1] for r in want)
    assert checked(empty) == []


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 1000])
def test_manifest_heights(spark, n):
    """A source that holds nearly all, one document, and twenty sources of a few."""
    r = random.Random(n)
    docs = [(i * 3 - 50, r.choice(["Ab", None, "ünï X", ""]), "en", "hot", i) for i in range(n)] + [(9, "X", None, None, 1)] + [(10 + i, "T", "de", f"s{i % 20}", 2) for i in range(25 if n > 2 else 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert checked(df) == brute_manifest([x.asDict() for x in df.collect()], tampered)


def test_a_lone_document_is_the_root(spark):
    df = spark.createDataFrame([(1, "A", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    (r,) = manifest.manifest(df).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == h() and r.verified


# --- resampling


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_features(text):
    w = brute_words(text)
    return [crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def brute_resampling(docs, target):
    corpus = Counter(b for d in docs for b in brute_features(d["text"]))
    wanted = Counter(b for t in target for b in brute_features(t))
    big, small = sum(corpus.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (big + 10000) / ((corpus[b] + 1) * (small + 10000)))) for b in corpus}
    rows = []
    for d in docs:
        f, i = brute_features(d["text"]), d["doc_id"]
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        v = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((v + 0.5) / 4294967296))), len(brute_words(d["text"])) >= 20))
    able = sorted([r for r in rows if r[4]], key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(able) * 25 // 100
    return near([r[:4] + (n if n <= drawn else None,) for n, r in enumerate(able, 1)] + [r[:4] + (None,) for r in rows if not r[4]])


@pytest.mark.parametrize("size", [40, 1000, 1 << 16])
def test_resampling_as_brute_force(spark, hard, empty, size):
    """Also where most texts are cut into chunks, some of them of less than a word."""
    target = spark.createDataFrame([(1, "same same Ünï côdé one two"), (2, None), (3, "")], "item_id long, text string")
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in resampling.scores(hard, target, size=size).collect()]
    want = brute_resampling([r.asDict() for r in hard.collect()], [r.text for r in target.collect()])
    assert near(got) == want and any(r[4] for r in want)
    assert resampling.scores(empty, target, size=size).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_chunks_own_every_feature_once(order):
    r = random.Random(order)
    for _ in range(60):
        text = "".join(r.choice(["a", "bc", " ", ",", "é", "\n", "漢字", "x" * 50]) for _ in range(r.randint(0, 150))).encode()
        whole = Counter(resampling.features(text, 0, order)[1].tolist())
        for size in (1, 7, 30):
            parts = [resampling.features(t, c, order) for t, c in resampling.chunks(text, size, order)]
            assert sum((Counter(f.tolist()) for _, f in parts), Counter()) == whole
            assert sum(n for n, _ in parts) == len(brute_words(text.decode()))


def test_draw(hard, spark):
    target = spark.createDataFrame([("same words",)], "text string")
    out = resampling.draw(hard, target)
    ranked = resampling.scores(hard, target).where("rank is not null")
    assert out.columns == hard.columns
    assert sorted(repr(r.doc_id) for r in out.collect()) == sorted(repr(r.doc_id) for r in ranked.collect())
