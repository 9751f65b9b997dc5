"""The pipeline's near copies against brute force."""

import random

import numpy as np

from tests.llm.conftest import prose

from quillstone.llm import simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def edited(r, text, changes):
    w = text.split()
    for i in r.sample(range(len(w)), changes):
        w[i] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def brute(texts):
    """The least place of each text's group."""
    sets, group = [shingles(t or "") for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def corpus():
    r = random.Random(5)
    texts = [prose(r, r.randint(80, 300)) for _ in range(30)]
    for t in texts[:25]:
        texts += [edited(r, t, k) for k in (1, 2, 3, 5, 8)]
    for _ in range(3):  # chains of which the ends are less alike
        chain = [prose(r, 200)]
        for _ in range(6):
            chain.append(edited(r, chain[-1], 3))
        texts += chain
    texts += [texts[0], texts[1].upper(), "", None, " ", "a b", "A  b", "a c"]
    r.shuffle(texts)
    return texts


def test_near_copies_as_brute_force(spark):
    texts = corpus()
    want = brute(texts)
    assert len(set(want)) < len(texts) - 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in simhash.first_of_each(docs).collect()) == sorted(set(want))


def test_texts_of_near_fingerprints_stay_if_less_alike(spark):
    """Long texts of few different shingles: the fingerprints are near, the sets of shingles are not."""
    r = random.Random(6)
    base = prose(r, 30)
    docs = [(i, " ".join([base] * 40 + [prose(r, 20)])) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert len({x.component_id for x in simhash.near_duplicates(df, shingle=5).collect()}) < 6
    assert len(set(brute([t for _, t in docs]))) == 6
    assert simhash.first_of_each(df).count() == 6


def family(r, words):
    """Many texts that share most of their shingles, and few of which are alike: every one has edits of its own."""
    base = prose(r, words)
    texts = [edited(r, base, r.choice([2, 4, 6, 8])) for _ in range(120)]
    return texts + [edited(r, t, 1) for t in texts[::3]]


def test_no_pair_is_lost_in_a_large_family_whatever_the_partitions(spark):
    r = random.Random(8)
    texts = family(r, 150) + family(r, 60)
    want = brute(texts)
    groups = len(set(want))
    assert 30 < groups < len(texts) - 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (8, 64, 211):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = {x.doc_id: x.group for x in simhash.near_copies(docs.repartition(n % 7 + 1)).collect()}
            first = {}
            for i in sorted(got):
                first.setdefault(got[i], i)
            assert [first[got[i]] for i in range(len(texts))] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_partners_of_one_text_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PARTNERS", 3)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.first_of_each(docs).collect()) == sorted(set(brute(texts)))


def test_near_fingerprints_are_candidates_by_themselves(spark, monkeypatch):
    """Without any band of least hashes, what fingerprints find is linked; what they find in less alike texts is not."""
    monkeypatch.setattr(simhash, "_bands", lambda grams, a, b: [])
    r = random.Random(11)
    texts = [prose(r, 400) for _ in range(5)]
    texts += [t + " end" for t in texts]
    base = prose(r, 30)
    texts += [" ".join([base] * 40 + [prose(r, 20)]) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(set(brute(texts))) == 11
    assert sorted(x.doc_id for x in simhash.first_of_each(docs).collect()) == sorted(set(brute(texts)))


def test_texts_of_a_common_shingle_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    r = random.Random(8)
    texts = family(r, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.first_of_each(docs).collect()) == sorted(set(brute(texts)))


def test_texts_of_a_family_meet_by_what_sets_them_apart(spark, monkeypatch):
    """Texts of one and of three edits share almost all shingles and are not alike: few such pairs are to be compared."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    r = random.Random(21)
    base = prose(r, 150)
    texts = [edited(r, base, 1) for _ in range(40)] + [edited(r, base, 3) for _ in range(100)]
    rows = simhash._shingled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5).collect()
    sets = {x.node: np.frombuffer(x.grams, "<u8") for x in rows}
    one = min(x.node for x in rows if x.doc_id < 40)
    group = {x.node: one if x.doc_id < 40 else x.node for x in rows}
    nodes = spark.createDataFrame([(x.node, x.n, group[x.node]) for x in rows], "node long, n int, c long")
    held = spark.createDataFrame([(x.node, x.grams) for x in rows], "node long, grams binary")
    got = {(x.a, x.b) for x in simhash._candidates(nodes, held, 0.8).collect()}
    agree = {(a, b): len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a in sets for b in sets if a < b}
    alike = {p for p, x in agree.items() if x >= 0.8}

    def groups(pairs):
        of = dict(group)
        for a, b in pairs:
            if of[a] != of[b]:
                old, new = max(of[a], of[b]), min(of[a], of[b])
                of = {k: new if v == old else v for k, v in of.items()}
        return of

    assert groups(got & alike) == groups(alike)
    assert len(got - alike) < 1500


def test_disk_follows_the_sets_not_all_texts_or_pairs(spark, monkeypatch):
    """Sets are kept of texts that meet others, and pairs are compared in turns, in which pairs that are linked already are left out."""
    monkeypatch.setattr(simhash, "TURN", 60)
    kept, compared = {}, []
    write, alike = simhash.written, simhash._alike

    def written(df, name, *args, **more):
        out = write(df, name, *args, **more)
        if "grams" in df.columns:
            kept[name] = kept.get(name, 0) + out.count()
        return out

    def _alike(pairs, sets, least):
        compared.append(pairs.count())
        return alike(pairs, sets, least)

    monkeypatch.setattr(simhash, "written", written)
    monkeypatch.setattr(simhash, "_alike", _alike)
    r = random.Random(31)
    base = prose(r, 150)
    texts = [prose(r, 100) for _ in range(60)] + [edited(r, base, 2) for _ in range(20)] + [base, base]
    docs = spark.createDataFrame([*enumerate(texts), (81, base)], "doc_id long, text string").repartition(4)
    assert sorted(x.doc_id for x in simhash.first_of_each(docs).collect()) == sorted(set(brute(texts)))
    assert kept["sets"] <= 22 and "shingled" not in kept
    assert len(compared) > 2 and sum(compared) < 200
