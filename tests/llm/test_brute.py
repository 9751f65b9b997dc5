"""Operators against brute force on small fixtures, exact round trips, and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillstone.llm import hmm, mixing, packing, quality, sharding, simhash, substrings, toxicity, vectors
from quillstone.llm.queries import fold, tokenizer_path
from tests.llm.conftest import SCHEMA, hard_rows, prose


def words(t):
    return (t or "").encode(errors="surrogatepass").split()


def test_mixing_meets_targets(hard):
    got = mixing.quotas(hard).collect()
    sizes = defaultdict(int)
    for r in hard_rows():
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_ = {s: 0.0 for s in order}, {s for s in order if sizes[s]}
    left = float(sum(sizes.values()))
    while open_:  # shared by weight; what is above three times a size goes round again
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in full} if full else share
        left -= sum(3.0 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
    for s in order:
        assert abs(taken[s] - target[s]) <= max(2, 0.04 * target[s])
    mixed = Counter()
    for r in mixing.mix(hard).collect():
        mixed[r.source] += len(words(r.text))
    assert mixed == +taken


def test_sainte_lague_takes_the_highest_quotients(spark):
    r = random.Random(5)
    for n, blocks in ((1, 7), (5, 3), (9, 100), (40, 55)):
        a = [r.randint(0, 50) for _ in range(n)]
        rows = [(i, float(x), blocks) for i, x in enumerate(a)]
        got = {x.k: x.q for x in mixing.sainte_lague(spark.createDataFrame(rows, "k int, a double, n long"), "a", "n", "k", "q").collect()}
        q = sorted(((-x / (2 * j - 1), i) for i, x in enumerate(a) if x for j in range(1, blocks + 1)))[:blocks]
        want = Counter(i for _, i in q)
        assert got == {i: want[i] for i in range(n)}


def test_lookup_table_is_filled_in_turns(spark):
    import hashlib

    shards, p = sharding.names(7), 251
    h = lambda *x: int(hashlib.md5(":".join(x).encode()).hexdigest()[:15], 16)
    owner, step = {}, [0] * 7
    while len(owner) < p:
        for i, s in enumerate(shards):
            while len(owner) < p:
                slot = (h(s, "offset") % p + step[i] * (h(s, "skip") % (p - 1) + 1)) % p
                step[i] += 1
                if slot not in owner:
                    owner[slot] = i
                    break
    assert {r.slot: r.shard for r in sharding.lookup_table(spark, shards, p).collect()} == owner
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, shards, 250)


def test_hmm_is_exact_and_beats_the_base(spark):
    chain = hmm.Chain.seeded(np.array([0.4, 0.3, 0.2, 0.1]), 3)
    seqs = [[0, 1, 2], [3], [1, 1, 0, 2, 3]]
    flat = np.array(sum(seqs, []))
    begins = np.cumsum([0, *map(len, seqs)])[:-1]
    got = chain.forward(flat, begins, np.array([len(s) for s in seqs]))
    for s, g in zip(seqs, got, strict=True):
        a = chain.start * chain.emit[s[0]]
        for x in s[1:]:
            a = (a @ chain.move) * chain.emit[x]
        assert abs(g - math.log(a.sum())) < 1e-9
    r = random.Random(1)
    a, b = (["".join(r.choice(x) for _ in range(4)) for _ in range(60)] for x in ("abc", "xyz"))
    rows = [(i, prose(r, 80, [a, b][i % 2])) for i in range(300)]
    out = hmm.score(spark.createDataFrame(rows, "doc_id long, text string"), fold(F.col("doc_id")) == 1).collect()
    tally = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            tally.update([*t.lower().split(), ""])
    n, v = sum(tally.values()), len(tally)
    for r in out:
        toks = [*rows[r.doc_id][1].lower().split(), ""]
        assert r.train_tokens == n and r.n_tokens == len(toks) and r.n_known == sum(tally[t] > 0 for t in toks)
        assert abs(r.base_score - sum(math.log10((tally[t] + 0.5) / (n + 0.5 * (v + 1))) for t in toks)) < 1e-6
    held = [r for r in out if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def plain_baum_welch(chain, seqs):
    """Expected counts by the unscaled recursions, token by token; and the sum of ln likelihoods."""
    k, v = len(chain.start), len(chain.emit)
    first, pairs, seen, total = np.zeros(k), np.zeros((k, k)), np.zeros((v, k)), 0.0
    for s in seqs:
        alpha, beta = [chain.start * chain.emit[s[0]]], [np.ones(k)]
        for x in s[1:]:
            alpha.append((alpha[-1] @ chain.move) * chain.emit[x])
        for x in s[:0:-1]:
            beta.insert(0, chain.move @ (chain.emit[x] * beta[0]))
        z = alpha[-1].sum()
        total += math.log(z)
        for t, x in enumerate(s):
            seen[x] += alpha[t] * beta[t] / z
            if t:
                pairs += alpha[t - 1][:, None] * chain.move * (chain.emit[x] * beta[t])[None] / z
        first += alpha[0] * beta[0] / z
    return first, pairs, seen, total


@pytest.mark.parametrize("stretch", [1, 2, 7, 256])
def test_baum_welch_counts_as_written_out(stretch):
    r = np.random.default_rng(4)
    emit, move, start = r.gamma(0.5, 1.0, (6, 4)), r.gamma(0.5, 1.0, (4, 4)), r.gamma(1.0, 1.0, 4)
    chain = hmm.Chain(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    seqs = [r.integers(0, 6, n).tolist() for n in (1, 2, 3, 7, 8, 14, 20, 1, 45)]
    flat, n = np.array(sum(seqs, [])), np.array([len(s) for s in seqs])
    want = plain_baum_welch(chain, seqs)
    for got, w in zip(chain.expect(flat, np.cumsum(n) - n, n, stretch), want, strict=True):
        assert np.allclose(got, w)
    each = [plain_baum_welch(chain, [s])[3] for s in seqs]
    assert np.allclose(chain.forward(flat, np.cumsum(n) - n, n, stretch), each)


def test_hmm_does_not_depend_on_partitions(spark, monkeypatch):
    """Above the sample's size, and with texts of many stretches."""
    monkeypatch.setattr(hmm, "SAMPLE", 20)
    monkeypatch.setattr(hmm, "STRETCH", 16)
    df = spark.createDataFrame([(r[0], r[1]) for r in hard_rows()], "doc_id long, text string")
    read = lambda k: sorted((str(r.doc_id), r.n_tokens, round(r.score, 4)) for r in hmm.score(df.repartition(k), fold(F.col("doc_id")) == 1).collect())
    assert read(2) == read(7)


def test_hmm_scores_as_written_out(spark, monkeypatch):
    """The whole query by plain loops: counts, classes, start, passes over all texts, and the score."""
    monkeypatch.setattr(hmm, "CLASSES", 12)
    monkeypatch.setattr(hmm, "ROUNDS", 2)
    monkeypatch.setattr(hmm, "GAIN", -1e9)
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abc") for _ in range(3)) for _ in range(40)]
    rows = [(i, prose(r, r.randint(0, 60), vocabulary) if i % 7 else None) for i in range(30)]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1}
    toks = {i: [*(t or "").lower().encode().split(), b""] for i, t in rows}
    tally = Counter(t for i in toks if i not in held for t in toks[i])
    n, v = sum(tally.values()), len(tally)
    names = sorted(tally, key=lambda t: (t != b"", -tally[t], t))[:12]
    rare_n, rare_v = n - sum(tally[t] for t in names), v - len(names)
    unigram = np.array([rare_n + 0.5 * (rare_v + 1), *(tally[t] + 0.5 for t in names)])
    unigram /= unigram.sum()
    code = lambda i: [names.index(t) + 1 if t in names else 0 for t in toks[i]]
    chain = hmm.Chain.seeded(unigram, 3)
    for _ in range(2 + 2):  # all texts are in the sample
        first, pairs, seen, _total = plain_baum_welch(chain, [code(i) for i in toks if i not in held])
        start, move, emit = first + 1, pairs + 1, seen + 20 * unigram[:, None]
        chain = hmm.Chain(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    for x in hmm.score(spark.createDataFrame(rows, "doc_id long, text string"), fold(F.col("doc_id")) == 1, states=3, passes=2).collect():
        ln = plain_baum_welch(chain, [code(x.doc_id)])[3]
        within = sum(math.log10((tally[t] + 0.5) / (rare_n + 0.5 * (rare_v + 1))) for t in toks[x.doc_id] if t not in names)
        assert abs(x.score - (ln / math.log(10) + within)) < 1e-6


def test_hmm_tail_is_joined(spark, monkeypatch):
    """With few cached types, the rest come by the join, and nothing changes in the base score."""
    df = spark.createDataFrame([(r[0], r[1]) for r in hard_rows()], "doc_id long, text string")
    read = lambda: {(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in hmm.score(df, fold(F.col("doc_id")) == 1).collect()}
    usual = read()
    monkeypatch.setattr(hmm, "CACHED", 20)
    monkeypatch.setattr(hmm, "CLASSES", 10)
    assert read() == usual


def test_quality_base(hard):
    for r in quality.verdicts(hard).where("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        t = next(x[1] for x in hard_rows() if x[0] == r.doc_id) or ""
        w = [x.decode() for x in words(t)]
        lines = [x for x in t.split("\n") if words(x)]
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
        failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), failed)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (failed and r.kept)


def test_quality_keeps_clean_and_drops_junk(spark):
    r = random.Random(9)
    rows = [(i, prose(r, 120), "en", "s") for i in range(200)]
    rows += [(1000 + i, " ".join(w + r.choice(["###", "&&&", "$$$"]) for w in prose(r, 120).split()), "en", "s") for i in range(20)]
    kept = {x.doc_id for x in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("kept").collect()}
    assert kept == set(range(200))


def test_quality_limits_follow_the_group(spark):
    """The same text is fine where its source writes like that, and not where it does not; few symbols are fine anywhere."""
    r = random.Random(4)
    marked = lambda share: " ".join(w + ("#" if r.random() < share else "") for w in prose(r, 200).split())
    rows = [(i, marked(0.0), "en", "plain") for i in range(100)] + [(100 + i, marked(0.5), "en", "code") for i in range(100)]
    rows += [(900, marked(0.5), "en", "plain"), (901, marked(0.5), "en", "code"), (902, marked(0.0) + " # #", "en", "plain")]
    kept = {x.doc_id for x in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("kept").collect()}
    assert kept == set(range(200)) | {901, 902}


def test_sketches_merge(spark):
    """A language's quantiles from its sources' sketches are those of its documents, within a bucket."""
    r = random.Random(2)
    rows = [(i, prose(r, r.randint(20, 200)) + " *" * r.randint(0, 9), "en", f"s{i % 3}") for i in range(300)]
    m = quality.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    q = quality.quantiles(quality.sketches(m), ["lang"]).where("ratio = 'length'").first()
    values = sorted(len("".join(t.split())) * 100 // len(t.split()) for _, t, _, _ in rows)
    for p, got in ((0.25, q.q25), (0.5, q.q50), (0.75, q.q75)):
        want = values[math.ceil(p * len(values)) - 1]
        assert abs(got / want - 1) < 0.021


def test_packing_round_trip(hard):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    pieces = packing.pack(hard, tokenizer_path(), 64).collect()
    at = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    assert at[0][:2] == (0, 0)
    for a, b in zip(at, at[1:], strict=False):
        assert b[:2] == ((a[0], a[1] + a[2]) if a[1] + a[2] < 64 else (a[0] + 1, 0))
    want = Counter()
    for r in hard_rows():
        want[(r[0], tuple([*t.encode(r[1] or "", add_special_tokens=False).ids, 0]))] += 1
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    for (doc, ids), times in want.items():
        mine = [p for p in by[doc] if p.doc_tokens == len(ids)]
        crc = lambda p: zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())  # noqa: B023, E731
        assert sum(p.length for p in mine if crc(p) == p.ids_crc32) >= times * len(ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_librarys_ids(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    t, (encode, size) = Tokenizer.from_file(path), packing.encoder(path)
    r = random.Random(4)
    assert size == t.get_vocab_size()
    for _ in range(3000):
        x = "".join(r.choice("ab é\n\t  '’s ll 12٣ß漢字\x85<|endoftext|>\x00.!#👍🏽") for _ in range(r.randint(0, 40)))
        assert list(encode(x)) == t.encode(x, add_special_tokens=False).ids


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(n, linked):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_simhash_as_brute_force(spark):
    r = random.Random(6)
    base = [prose(r, 90) for _ in range(40)]
    texts = base + [" ".join(("zz" if r.random() < 0.01 else w) for w in t.split()) for t in base * 4] + ["", None, "a b", "A B", " "]
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)]
    fps = [brute_fingerprint(t) for _, t in rows]
    top = reach(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    least = defaultdict(lambda: 10**9)
    for (i, _), g in zip(rows, top, strict=True):
        least[g] = min(least[g], i)
    want = {(i, f"{f:016x}", least[g]) for (i, _), f, g in zip(rows, fps, top, strict=True)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(x) for x in simhash.near_duplicates(df).collect()} == want
    assert len({x[2] for x in want}) < len(rows)


@pytest.mark.parametrize("few", [True, False])
def test_components_as_brute_force(spark, monkeypatch, few):
    """Chains, stars and random graphs; with minima broadcast, and written."""
    from quillstone.llm import common

    r = random.Random(12)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + r.randint(1, 30)) for _ in range(40)] + [(200 + r.randint(0, 60), 200 + r.randint(0, 60)) for _ in range(40)]
    if not few:
        monkeypatch.setattr(common.DataFrame, "count", lambda self: 10**9)
    got = {x.node: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {frozenset(e) for e in edges}
    nodes = sorted({x for e in edges for x in e})
    top = reach(len(nodes), lambda i, j: frozenset((nodes[i], nodes[j])) in linked)
    assert got == {n: nodes[t] for n, t in zip(nodes, top, strict=True) if nodes[t] != n}


@pytest.mark.parametrize(("distance", "chain"), [(4, 1), (4, 2), (4, 3), (7, 3), (1, 2)])
def test_pigeonring_loses_no_link(spark, distance, chain):
    r = random.Random(distance)
    fps = [r.getrandbits(64) for _ in range(60)]
    for f in fps[:60]:
        for _ in range(4):
            g = f
            for b in r.sample(range(64), r.randint(1, distance + 2)):
                g ^= 1 << b
            fps.append(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(x.a, x.b) for x in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance, chain).collect()}
    want = {tuple(sorted((a, b))) for a in set(signed) for b in set(signed) if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
    assert got == want


def cut_up(text):
    """Sentences, cut further after every word that has the least crc32 (the last of equals) of ten in a row."""
    pieces, out = [], []
    for line in re.split(r"(?<=[.!?…])(?=\s)|(?<=\n)|(?<=[。！？])", text):
        spans = [m.span() for m in re.finditer(r"\s*\S+", line)]
        crc = [zlib.crc32(line[a:z].strip().lower().encode()) for a, z in spans]
        after = {max(range(i, i + 10), key=lambda k: (-crc[k], k)) for i in range(len(spans) - 9)} if len(spans) > 10 else set()
        cuts = [0, *(spans[i][1] for i in sorted(after) if i + 1 < len(spans)), len(line)]
        pieces += [line[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]
    for p in pieces:  # what has no word goes with its neighbour
        if out and p and not (p.split() and out[-1].split()):
            out[-1] += p
        elif p:
            out.append(p)
    return out


def test_substrings_as_brute_force(hard):
    docs = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in hard_rows()})
    seen, want = {}, {}
    for d in docs:
        pieces = cut_up(d[2])
        assert "".join(pieces) == d[2] and pieces == [p for p, _ in substrings.sentences(d[2])]
        gone = set()
        for i in range(len(pieces)):  # the shortest run of three sentences or more and fifteen words or more
            n = next((n for n in range(3, len(pieces) - i + 1) if len(" ".join(pieces[i : i + n]).split()) >= 15), None)
            if n:
                run = tuple(" ".join(p.lower().split()) for p in pieces[i : i + n])
                if seen.setdefault(run, (d, i)) != (d, i):
                    gone |= set(range(i, i + n))
        want[(None if d[0] else d[1], d[2])] = ("".join(p for k, p in enumerate(pieces) if k not in gone), len(gone))
    text = {}
    for r in hard_rows():
        text.setdefault(r[0], r[1])
    for r in substrings.removed(hard).where("doc_id is not null").collect():
        left, n = want[(r.doc_id, text[r.doc_id] or "")]
        assert (r.text or "", r.n_removed) == (left, n)


def test_substrings_catch_planted_passages(spark):
    r = random.Random(8)
    passages = [prose(r, 60) for _ in range(5)]
    rows = []
    for i in range(100):
        t = prose(r, 150).split()
        if i % 4 == 0:
            t[75:75] = passages[i % 5].split()
        rows.append((i, " ".join(t)))
    out = {x.doc_id: x for x in substrings.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for i, t in rows:
        if i % 4 == 0 and first.setdefault(i % 5, i) != i:
            assert len(t.split()) - len(out[i].text.split()) >= 30
        else:
            assert out[i].text == t


def test_toxicity_held_out(spark):
    r = random.Random(7)
    bad = ["grobword", "vilestem"]
    rows, labels = [], []
    for i in range(400):
        t = prose(r, 100).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                t.insert(r.randrange(len(t)), r.choice(bad) + r.choice(["", "s", "en", "ung"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.where(fold(F.col("doc_id")) != 0))
    got = {x.doc_id: x for x in toxicity.passages(docs, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i].score >= 0.5) == bool(y) for i, y in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= x.score <= 1 for x in got.values())
    assert got[0].passages and rows[0][1].split()[got[0].passages[0]["first"]].startswith(tuple(bad))


def best_stretches(x):
    """By the definition: the best stretch, then on to its left and right."""

    def best(lo, hi):
        found = [(sum(x[i : j + 1]), -(j - i), -i) for i in range(lo, hi) for j in range(i, hi)]
        s, length, i = max(found, default=(0, 0, 0))
        if s <= 0:
            return []
        i, j = -i, -i - length
        return [*best(lo, i), (round(s, 6), i, j), *best(j + 1, hi)]

    return best(0, len(x))


def test_segments_are_all_the_maximal_ones():
    r = random.Random(3)
    for _ in range(300):
        x = [r.choice([1.0, 2.0, 0.5]) if r.random() < 0.4 else r.choice([-0.25, -0.75, -2.0]) for _ in range(r.randint(0, 25))]
        assert [(round(s, 6), a, b) for s, a, b in toxicity._segments(x)] == best_stretches(x)


def test_segments_take_linear_time():
    import time

    def took(n):
        x = [1.0, *[-0.5] * 9] * n  # every hit is a segment of its own
        y = [1.0, -0.5] * n + [-0.75] * n  # and here each joins all before it
        began = time.process_time()
        assert len(toxicity._segments(x)) == n and len(toxicity._segments(y)) == 1
        return time.process_time() - began

    took(1000)
    assert took(80_000) < 30 * max(took(8_000), 0.02)


def test_toxic_passages_are_all_found():
    model = toxicity.Model({"vile": 4.0, "nasty": 4.0}, 0.5)
    text = "vile nasty " + "clean " * 200 + "vile nasty"
    assert [(a, b) for _, a, b in model.segments(text, {})[1]] == [(0, 1), (202, 203)]


def test_toxicity_weights_and_score_as_written_out(spark):
    """Shares, evidence, calibration and link, each by plain loops over the same documents."""
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(60)]
    docs = [(" ".join(r.choices(vocabulary[:30] if y else vocabulary[15:], k=25)), y) for y in (0, 1) * 60]
    have = [{u for w in toxicity._words(t) for u in toxicity._units(w)} for t, _ in docs]
    n1, n0 = 60, 60
    tally = {u: (sum(u in h and y for h, (_, y) in zip(have, docs)), sum(u in h and not y for h, (_, y) in zip(have, docs))) for u in set().union(*have)}

    def share(u, prior):
        chain = [u, *(u[:k] + " " for k in (6, 5, 4) if k < len(u) - u.endswith(" ") or (k == len(u) == 4))]
        q, g = 0.5, 0.0
        for x in reversed(chain):
            bad, good = tally[x]
            q = (bad + prior * q) / (bad + good * n1 / n0 + prior)
            g = max(g, 2 * sum(n * math.log(n / ((bad + good) * 0.5)) for n in (bad, good) if n))
        return q, g

    sizes = np.array([[n1], [n0]], float)
    units = sorted(tally)
    counts = toxicity.Counts(units, np.array([[tally[u][0]] for u in units], float), np.array([[tally[u][1]] for u in units], float), sizes)
    for prior, evidence in ((2.0, 4.0), (8.0, 15.0)):
        got = counts.weights(prior, evidence)
        for u, w in zip(units, got, strict=True):
            q, g = share(u, prior)
            assert abs(w - (math.log(q / (1 - q)) if g >= evidence else 0.0)) < 1e-4
    model = toxicity.Model({u: float(w) for u, w in zip(units, counts.weights(2.0, 4.0), strict=True) if w}, 0.5, 0.7, 1.3, (-1.0, 0.8, 0.4))
    rows = [(i, t) for i, (t, _) in enumerate(docs)] + [(900, ""), (901, None)]
    for x in toxicity.scores(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        words = toxicity._words(dict(rows)[x.doc_id])
        scores = [next((model.units[u] for u in toxicity._units(w) if u in model.units), 0.0) - 0.5 for w in words]
        parts = [s for s, _, _ in best_stretches(scores)]
        s = [0.7 * p - 1.3 - math.log(len(words)) for p in parts]
        a, b = (min(max(max(s), -20), 40), math.log(1 + sum(math.exp(-math.exp(-v)) > 0.95 for v in s))) if s else (-20.0, 0.0)
        assert abs(x.score - 1 / (1 + math.exp(1.0 - 0.8 * a - 0.4 * b))) < 1e-4


def cluster_vectors(n, seed, dim=16):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(n // 8, dim))
    v = centers[r.integers(0, len(centers), n)] + r.normal(size=(n, dim)) * r.choice([0.02, 0.15, 0.3], (n, 1))
    v[5] = v[6] = v[7]
    return v.astype(np.float32)


@pytest.mark.parametrize("cap", [4000, 100])
def test_vectors_as_brute_force(spark, cap):
    v = cluster_vectors(900, 1)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    out, recall = vectors.linked(df, cap=cap)
    assert 0.98 <= recall <= 1
    got = {x.vec_id: x for x in out.collect()}
    found = np.array([got[i].n_links for i in range(len(v))])
    true = link.sum(1)
    assert (found <= true).all() and found.sum() >= 0.97 * true.sum()
    if cap == 100:
        top = reach(len(v), lambda i, j: link[i, j])
        assert sum(got[i].component_id == top[i] for i in range(len(v))) >= 0.97 * len(v)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got.values())


def near_groups(texts):
    from tests.llm.test_near_copies import brute

    return brute(texts)


def test_pipeline_stage_by_stage(spark, sf):
    """Each stage against brute force over what it was given."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {}
    for name, stage in cp.STAGES:
        before = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, sf)
        after = [r.asDict() for r in out.collect()]
        held[name] = (before, after)
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(after, docs.schema)
    a, b = held["toxicity"]
    assert len(b) >= 0.7 * len(a) and {r["doc_id"] for r in b} <= {r["doc_id"] for r in a}
    a, b = held["simhash"]
    groups = defaultdict(list)
    for r, g in zip(a, near_groups([r["text"] for r in a]), strict=True):
        groups[g].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in b) == sorted(min(g) for g in groups.values()) and len(b) < len(a)
    a, b = held["substrings"]
    assert {r["doc_id"] for r in a} == {r["doc_id"] for r in b} and all(r["n_chars"] == len(r["text"]) for r in b)
    a, b = held["mixing"]
    q = {x.doc_id: x.taken for x in mixing.quotas(spark.createDataFrame(a, docs.schema)).collect()}
    got = Counter()
    for r in b:
        got[r["doc_id"]] += len(words(r["text"]))
    assert got == Counter({k: v for k, v in q.items() if v})
    a, b = held["packing"]
    encode, _ = packing.encoder(tokenizer_path())
    assert sum(r["length"] for r in b) == sum(len(encode(r["text"])) + 1 for r in a)
    assert max(r["sequence_id"] for r in b) == (sum(r["length"] for r in b) - 1) // 1024


def test_whole_run(spark, sf):
    import corpus_pipeline as cp

    assert cp.run(spark, sf).count() > 0


assert SCHEMA
