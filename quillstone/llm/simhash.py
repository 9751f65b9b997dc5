"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits. Two of them link when at most ``distance`` bits differ. The 64 bits lie in
distance + 1 segments on a ring. If the differences sum to at most the distance, some segment begins a
chain whose first l segments differ in at most floor(l * distance / segments) bits, for every l (the
pigeonring principle). So candidates are found by an equi-join on whole chains: each fingerprint is
indexed under its own chain from every segment, and looks up the few variants of it that the budgets of
the chain's prefixes allow. The longer prefixes of the ring prune what is found, before the full check.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import components, join_small, least_of_group, row_key
from quillstone.session import arrow_batches, discard, reclaim, written

SEED = 42
#: Bands of least hashes, and hashes in each.
BANDS = 32
BAND = 6
#: Texts that share a shingle and are met with others of it at once.
BLOCK = 128
#: Partners of a text that a task compares it with.
PARTNERS = 2048
#: Pairs at least that are compared at once.
TURN = 100_000


def _fingerprint(text: bytes | None, shingle: int) -> int:
    """Over half of the shingles' hashes have the bit. bytes.lower() changes A-Z only, bytes.split()
    splits at ASCII white space only."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        h = np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, min(n, at + 65536))], "<u8")
        counts += _bits(h)
    return int(np.packbits(counts * 2 > n).view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp long): a row for each row of docs. A null or empty text has fingerprint zero."""

    def run(batches):
        for b in batches:
            fps = [_fingerprint(x, shingle) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    arrow_batches(docs.sparkSession)
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def _ring(distance: int) -> list[tuple[int, int]]:
    """(offset, width) of the segments."""
    m = distance + 1
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cover(ring: list[tuple[int, int]], start: int, length: int) -> int:
    """The bits of a chain of segments."""
    return sum(((1 << w) - 1) << o for o, w in (ring[(start + j) % len(ring)] for j in range(length)))


def _variants(ring: list[tuple[int, int]], start: int, chain: int, distance: int) -> list[int]:
    """Every difference, as a mask over the 64 bits, that the budgets of a chain's prefixes allow."""
    found = [0]
    for j in range(chain):
        o, w = ring[(start + j) % len(ring)]
        budget = (j + 1) * distance // len(ring)
        found = [
            x | sum(1 << (o + bit) for bit in bits)
            for x in found
            for k in range(budget - x.bit_count() + 1)
            for bits in combinations(range(w), k)
        ]
    return found


def chain_for(n: int, distance: int) -> int:
    """Segments of a chain, for n fingerprints: the fewest with which a chain's key has 64 times as many values as
    there are fingerprints, so that by chance a probe meets few. Links are the same for every chain."""
    ring = _ring(distance)
    bits = [min(_cover(ring, i, c).bit_count() for i in range(len(ring))) for c in range(1, len(ring) + 1)]
    return next((c for c, b in enumerate(bits, 1) if 1 << b >= 64 * n), len(ring))


def links(fps: DataFrame, distance: int = 4, chain: int | None = None) -> DataFrame:
    """(a, b): the pairs a < b of distinct fingerprints at most ``distance`` bits apart, each once."""
    ring = _ring(distance)
    m = len(ring)
    each = fps.select("fp").distinct()
    if chain is None:
        each = written(each, "distinct-fingerprints")
        chain = chain_for(each.count(), distance)
    chain = min(chain, m)
    lit = lambda x: F.lit(_signed(x)).cast("long")
    whole = [F.col("fp").bitwiseAND(lit(_cover(ring, i, chain))) for i in range(m)]
    index = each.select(F.col("fp").alias("b"), F.posexplode(F.array(*whole)).alias("start", "key"))
    probes = F.array(*[F.array(*[k.bitwiseXOR(lit(v)) for v in _variants(ring, i, chain, distance)]) for i, k in enumerate(whole)])
    probe = each.select(F.col("fp").alias("a"), F.posexplode(probes).alias("start", "keys")).select("a", "start", F.explode("keys").alias("key"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    near = F.bit_count(differ) <= distance
    for length in range(chain + 1, m):
        over = F.element_at(F.array(*[lit(_cover(ring, i, length)) for i in range(m)]), F.col("start") + 1)
        near = (F.bit_count(differ.bitwiseAND(over)) <= length * distance // m) & near
    return probe.join(index, ["start", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, chain: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row for each row of docs; component_id is the least doc_id
    that links reach.

    Copies share a fingerprint and are one node, so a group of copies costs nothing but its rows. Null
    and empty texts have fingerprint zero and link like others. Rows without an id take part, but only
    ids can be least; a group in which no row has an id has a null component_id.
    """
    fps = written(fingerprints(docs, shingle), "fingerprints")
    pairs = written(links(fps, distance, chain), "links")
    found = components(pairs)
    discard(pairs)
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    root = first.join(found, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), "first", F.coalesce("component", "fp").alias("root"))
    of = written(least_of_group(root, "first", "component_id").select("_fp", "component_id"), "simhash-groups")
    out = join_small(fps, of, F.col("fp") == F.col("_fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _bits(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def _hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """Hashes of the shingles; a shorter text is one shingle, one without words has none."""
    words, digest = (text or b"").lower().split(), xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))] if words else [], "<u8")


def _distinct(text: bytes | None, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    return np.unique(_hashes(text, shingle))


def _grams(text: bytes | None, shingle: int) -> tuple[np.ndarray, int]:
    """Hashes of the distinct shingles, sorted, and the fingerprint."""
    h = _hashes(text, shingle)
    if not len(h):
        return h, 0
    counts = sum(_bits(h[at : at + 65536]) for at in range(0, len(h), 65536))
    return np.unique(h), int(np.packbits(counts * 2 > len(h)).view("<i8")[0])


def _bands(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    """A hash for every BAND of least values under as many random functions."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 256):
        np.minimum(least, (grams[at : at + 256, None] * a + b).min(0), out=least)
    return [_signed(xxhash.xxh64_intdigest(least[i : i + BAND].tobytes(), SEED)) for i in range(0, len(a), BAND)]


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs["doc_id"], docs["text"]).alias("key"), docs["text"].cast("binary").alias("text"))


def _shingled(docs: DataFrame, shingle: int, held: bool = True) -> DataFrame:
    """(doc_id, key, node, n, fp, bands, grams): a row for each row of docs. Texts of the same shingles are one node. Not ``held``: without
    grams, which are larger than a text; ``_sets`` makes them anew for texts that meet others."""
    r = np.random.default_rng(SEED)
    a, b = (r.integers(0, 1 << 63, BANDS * BAND, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    schema = "doc_id long, key long, node long, n int, fp long, bands array<long>" + ", grams binary" * held
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        for x in batches:
            for k in range(0, x.num_rows, 500):
                part = x.slice(k, 500)
                grams, fps = zip(*(_grams(t, shingle) for t in part.column(2).to_pylist()), strict=True)
                cols = [pa.array([_node(g) for g in grams], pa.int64()), pa.array([len(g) for g in grams], pa.int32()), pa.array(fps, pa.int64())]
                cols += [pa.array([_bands(g, a, b) if len(g) else [] for g in grams], pa.list_(pa.int64()))]
                cols += [pa.array([g.tobytes() for g in grams], pa.binary())] if held else []
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names)

    arrow_batches(docs.sparkSession)
    return _slim(docs).mapInArrow(run, schema)


def _node(grams: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(grams.tobytes(), SEED))


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, grams): a row for each of wanted (node, key, times), of whose key docs have that many rows."""

    def run(batches):
        for x in batches:
            for k in range(0, x.num_rows, 500):
                grams = [_distinct(t, shingle) for t in x.column(0).slice(k, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_node(g) for g in grams], pa.int64()), pa.array([g.tobytes() for g in grams], pa.binary())], ["node", "grams"])

    arrow_batches(docs.sparkSession)
    rows = join_small(_slim(docs), wanted.select(F.col("key").alias("_key"), "times"), F.col("key") == F.col("_key"))
    once = rows.where("times = 1")
    if not wanted.where("times > 1").isEmpty():
        once = once.select("key", "text").unionByName(rows.where("times > 1").select("key", "text").dropDuplicates(["key"]))
    return once.select("text").mapInArrow(run, "node long, grams binary")


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, way, b, grams): the set of a with b null, then those of its partners. Pairs are dealt by a, in tasks of bounded
    size, and the set of a goes before those of its partners, once for each of these tasks."""
    dealt = "a", "way", "b"
    ways = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("long").alias("ways")), "ways")
    lead = ways.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1)).alias("way"), F.lit(None).cast("long").alias("b"))
    lead = lead.join(sets.select(F.col("node").alias("a"), "grams"), "a").select(*dealt, "grams")
    rest = join_small(pairs, ways.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a")).select("a", F.pmod(F.xxhash64("b"), F.col("ways")).alias("way"), "b")
    rest = rest.join(sets.select(F.col("node").alias("b"), "grams"), "b").select(*dealt, "grams")
    return lead.unionByName(rest).repartition("a", "way").sortWithinPartitions("a", "way", F.col("b").asc_nulls_first())


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least that share of their union in common."""

    def run(batches):
        held, of = None, None
        for x in batches:
            a, way, b, sized = x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2).to_pylist(), x.column(3)
            keep = []
            for i in range(x.num_rows):
                grams = np.frombuffer(sized[i].as_py(), "<u8")
                if b[i] is None:
                    held, of = grams, (a[i], way[i])
                    keep.append(False)
                else:
                    assert of == (a[i], way[i])
                    both = len(np.intersect1d(held, grams, assume_unique=True))
                    keep.append(both >= least * (len(held) + len(grams) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(2)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _beside(pairs, sets).mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, least: float, before: DataFrame | None = None) -> DataFrame:
    """(a, b): pairs that are alike, and with them those of ``before``; all groups that the pairs make, not each pair.

    A pair takes its second text's set along. So pairs go in turns of about as many as there are sets, and what a turn has
    shuffled is deleted before the next one: disk follows the sets, not the pairs. Pairs between which earlier ones lead are not compared."""
    spark = pairs.sparkSession
    turns = max(1, -(-pairs.count() // max(TURN, sets.count())))
    found = before
    for t in range(turns):
        part = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(turns)) == t) if turns > 1 else pairs
        if found is not None:
            of = components(found)
            for x in ("a", "b"):
                part = join_small(part, of.select(F.col("node").alias(f"_{x}"), F.col("component").alias(f"_in_{x}")), F.col(x) == F.col(f"_{x}"), "left")
            part = part.where(F.coalesce("_in_a", "a") != F.coalesce("_in_b", "b")).select("a", "b")
        new = _alike(part if found is None else written(part, "apart"), sets, least)
        found = written(new if found is None else found.unionByName(new), "alike")
        reclaim(spark)
    return found


def _differences(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, near, grams): what only one of both sets has, and whether the pair is alike."""
    share = (1 - least) / (1 + least)

    def run(batches):
        held, of = None, None
        for x in batches:
            a, way, b, sized = x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2).to_pylist(), x.column(3)
            out = []
            for i in range(x.num_rows):
                grams = np.frombuffer(sized[i].as_py(), "<i8")
                if b[i] is None:
                    held, of = grams, (a[i], way[i])
                else:
                    assert of == (a[i], way[i])
                    differ = np.setxor1d(held, grams, assume_unique=True)
                    out.append((a[i], b[i], len(differ) <= share * (len(held) + len(grams)) + 1e-9, differ))
            if out:
                cols = [pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())), strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["a", "b", "near", "grams"])

    return _beside(pairs, sets).mapInArrow(run, "a long, b long, near boolean, grams array<long>")


def _candidates(nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of nodes (node, n, c) among which are all of different c that have the share ``least`` in common, but for
    some between which other pairs lead.

    Shingles are put in order of how many of these texts have them, the rarest first. A pair that is alike has one of
    the first n - least * n + 1 of both in common, and enough after the first such one (prefix and positional
    filters, which lose nothing). Texts that are nearly alike would all meet in the shingles that most of them have. So where over
    BLOCK texts meet in a shingle, they are a family, and within it texts meet by what they don't share with its first
    text: two of them differ in what only one of both differences has, so the same filters hold for the differences,
    of which what an edit leaves is rare. A pair whose differences need nothing in common is alike to the first text, both of it, and is
    linked by that."""
    each = join_small(sets, nodes.select(F.col("node").alias("_node"), "n", "c"), F.col("node") == F.col("_node")).select("node", "n", "c", "grams")

    def spread(batches):
        for x in batches:
            for i in range(x.num_rows):
                g = np.frombuffer(x.column(3)[i].as_py(), "<i8")
                rows = x.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(rows.column(k).to_numpy(), len(g))) for k in (0, 1, 2)), pa.array(g)], ["node", "n", "c", "gram"])

    grams = written(each.mapInArrow(spread, "node long, n int, c long, gram long"), "mixed-shingles")
    grams = grams.select(F.lit(0).cast("long").alias("space"), "node", "n", F.col("n").alias("size"), "c", "gram")
    pre = _prefixes(grams, F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    crowded = pre.groupBy(F.col("gram").alias("_gram")).agg(F.count("*").alias("held"), F.min(F.struct("node", "n")).alias("lead")).where(F.col("held") > BLOCK)
    crowded = written(crowded, "crowded")
    if crowded.isEmpty():
        return _meeting(pre.withColumn("family", F.lit(None).cast("long")), least)

    led = join_small(pre, crowded, F.col("gram") == F.col("_gram")).groupBy("node").agg(F.max_by("lead.node", F.struct("held", "gram")).alias("lead"))
    led = written(led, "led")
    of = components(led.select(F.col("node").alias("a"), F.col("lead").alias("b"))).withColumnRenamed("node", "_node")
    led = join_small(led.select("node"), of, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("component", "node").alias("family"))
    size = nodes.select(F.col("node").alias("_node"), F.col("n").alias("_n"))
    first = join_small(led, written(led.select("family").distinct(), "first").join(size, F.col("family") == F.col("_node")).select(F.col("family").alias("_family"), F.col("_n").alias("_most")), F.col("family") == F.col("_family"))
    # A first text that is much longer than another would make its differences long; such a one meets others as they are.
    family = written(join_small(first, size, F.col("node") == F.col("_node")).where(F.col("_most") <= 2 * F.col("_n")).select(F.col("node").alias("_node"), "family"), "families")
    apart = _meeting(join_small(pre, family, F.col("node") == F.col("_node"), "left").drop("_node"), least)
    differ = written(_differences(family.where("_node <> family").select(F.col("family").alias("a"), F.col("_node").alias("b")), sets, least), "differences")
    own = join_small(differ.drop("near"), nodes, F.col("b") == F.col("node")).select(F.col("a").alias("space"), "node", "n", F.size("grams").alias("size"), "c", F.explode("grams").alias("gram"))
    within = _prefixes(written(own, "different-shingles"), F.floor(F.col("n") * (1 - least) / least + 1e-9) + 1)
    within = _meeting(within.withColumn("family", F.lit(None).cast("long")), least)
    return apart.unionByName(within).unionByName(differ.where("near").select("a", "b")).distinct()


def _prefixes(grams: DataFrame, reach: Column) -> DataFrame:
    """(space, node, n, size, c, gram, at): the rarest of each node's shingles, ``reach`` of them, less those that only one group
    of a space has. Those that a single text has are counted, not joined."""
    often = written(grams.groupBy("space", "gram").agg(F.count("*").alias("times"), F.min("c").alias("lo"), F.max("c").alias("hi")), "shingle-counts")
    often = often.where("times > 1").select(F.col("space").alias("_space"), F.col("gram").alias("_gram"), "times", (F.col("lo") < F.col("hi")).alias("crosses"))
    shared = grams.join(often.hint("merge"), (F.col("space") == F.col("_space")) & (F.col("gram") == F.col("_gram"))).drop("_space", "_gram")
    own = Window.partitionBy("node")  # a text's shingles
    alone = F.col("size") - F.count("*").over(own)
    pre = shared.withColumn("at", alone + F.row_number().over(own.orderBy("times", "gram"))).where((F.col("at") <= reach) & F.col("crosses"))
    return written(pre.select("space", "node", "n", "size", "c", "gram", "at"), "prefixes")


def _meeting(pre: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs that share a shingle of a space and can be alike, but for those of one family. Texts of one shingle meet in
    blocks of about BLOCK, each pair of blocks in one step; a family of more has blocks of its own, which don't meet each other."""
    pre = written(pre.withColumn("family", F.coalesce("family", "node")), "met")
    large = pre.groupBy("space", "gram", "family").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK).select(F.col("space").alias("_space"), F.col("gram").alias("_gram"), F.col("family").alias("_family"))
    same = (F.col("space") == F.col("_space")) & (F.col("gram") == F.col("_gram"))
    pre = join_small(pre, written(large, "large"), same & (F.col("family") == F.col("_family")), "left")
    pre = pre.withColumn("pool", F.coalesce("_family", F.lit(0).cast("long"))).drop("_space", "_gram", "_family")
    ways = pre.groupBy("space", "gram", "pool").agg(F.ceil(F.count("*") / BLOCK).alias("ways"))
    ways = ways.select(F.col("space").alias("_space"), F.col("gram").alias("_gram"), F.col("pool").alias("_pool"), "ways")
    dealt = pre.join(ways.hint("merge"), same & (F.col("pool") == F.col("_pool"))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("ways")))
    blocks = written(dealt.groupBy("space", "gram", "pool", "block").agg(F.collect_list(F.struct("node", "n", "size", "c", "family", "at")).alias("x")), "blocks")
    side = lambda pool, block, x: blocks.select("space", "gram", F.col("pool").alias(pool), F.col("block").alias(block), F.col("x").alias(x))
    met = side("s", "i", "p").hint("merge").join(side("t", "j", "q"), ["space", "gram"]).where("s < t or s = 0 and t = 0 and i <= j")
    return met.repartition("space", "gram", "s", "i", "t", "j").select("p", "q").mapInArrow(_meet(least), "a long, b long").distinct()


def _meet(least: float):
    """The pairs of two blocks of texts (node, n, size, c, family, at) that share a shingle, less those that can't be alike or are of
    one group or family. size: how many shingles of the text, or of its difference, there are."""
    share = (1 - least) / (1 + least)

    def run(batches):
        for x in batches:
            out = []
            side = [(c.offsets.to_numpy(), [v.to_numpy() for v in c.values.flatten()]) for c in x.columns]
            for k in range(x.num_rows):
                (pn, pl, ps, pc, pf, pa_), (qn, ql, qs, qc, qf, qa) = ([v[o[k] : o[k + 1]] for v in vs] for o, vs in side)
                pn, pl, ps, pc, pf, pa_ = (v[:, None] for v in (pn, pl, ps, pc, pf, pa_))
                rest = np.minimum(ps - pa_, qs - qa)
                fits = (np.minimum(pl, ql) >= least * np.maximum(pl, ql) - 1e-9) & (rest + 1 >= (ps + qs - share * (pl + ql)) / 2 - 1e-9)
                i, j = np.nonzero(fits & (pc != qc) & (pf != qf))
                out.append(np.stack([np.minimum(pn[i, 0], qn[j]), np.maximum(pn[i, 0], qn[j])]))
            if out:
                a, b = np.unique(np.concatenate(out, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _near_prints(nodes: DataFrame, distance: int) -> DataFrame:
    """(p, q): pairs of nodes (node, n, fp) as structs: the least node of a fingerprint with every other node of it, and with
    the least ones of all fingerprints at most ``distance`` bits apart."""
    nodes = written(nodes, "prints")
    leads = written(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("p")), "leads")
    same = nodes.join(leads.hint("merge"), "fp").where(F.col("node") != F.col("p.node")).select("p", F.struct("node", "n").alias("q"))
    pairs = written(links(leads, distance), "links")
    far = pairs.join(leads.select(F.col("fp").alias("a"), "p"), "a").join(leads.select(F.col("fp").alias("b"), F.col("p").alias("q")), "b")
    return same.unionByName(far.select("p", "q"))


def near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, distance: int = 4) -> DataFrame:
    """(doc_id, key, group): a row for each row of docs. Rows share a group if pairs of texts lead from one
    to the other that have ``least`` of their distinct shingles in common, as counted on the shingles.

    Candidates are texts whose fingerprints differ in ``distance`` bits at most, found as ``near_duplicates`` finds them. At 0.8
    fingerprints differ in too many bits for any key, so texts are candidates too that agree in
    one of BANDS bands of BAND least hashes, which a pair at 0.8 fails to do in 1 of 16,000 cases. Of those that share
    a band, every text is compared with the least one. All are counted out, so near fingerprints alone link nothing. Texts of bands in which this left different groups are then joined
    with each other by prefixes of their rarest shingles, which loses no pair, and what is found is counted out. Groups are the
    same for every number of partitions. Texts without words are one group.
    """
    rows = written(_shingled(docs, shingle, held=False), "shingled")
    times = rows.groupBy("node", "key").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("n", "fp", "bands")])
    nodes = written(times.groupBy("node").agg(F.min_by(F.struct("key", "times", "n", "fp", "bands"), "key").alias("x")), "firsts")
    near = written(_near_prints(nodes.where("x.n > 0").select("node", "x.n", "x.fp"), distance), "near-prints")
    bands = written(nodes.select("node", "x.n", F.posexplode("x.bands").alias("band", "value")), "bands")
    heads = bands.groupBy("band", "value").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("times")).where("times > 1").drop("times")
    heads = written(heads, "heads")
    members = written(bands.join(heads.hint("merge"), ["band", "value"]), "members")
    meet = members.select("node").unionByName(near.select(F.explode(F.array("p.node", "q.node")).alias("node"))).distinct().withColumnRenamed("node", "_node")
    wanted = written(join_small(nodes.select("node", "x.key", "x.times"), written(meet, "meet"), F.col("node") == F.col("_node"), "left_semi"), "wanted")
    slim = written(rows.select("doc_id", "key", "node"), "nodes")
    for used in (rows, nodes, bands, heads):  # the largest tables of the stage
        discard(used)
    reclaim(docs.sparkSession)
    sets = written(_sets(docs, wanted, shingle), "sets")
    reclaim(docs.sparkSession)
    fits = lambda x, y: F.least(x, y) >= least * F.greatest(x, y) - 1e-9
    first = members.where((F.col("node") != F.col("head.node")) & fits(F.col("n"), F.col("head.n"))).select(F.col("head.node").alias("a"), F.col("node").alias("b"))
    by_print = near.where(fits(F.col("p.n"), F.col("q.n"))).select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b"))
    first = written(first.unionByName(by_print).distinct(), "pairs")
    near = _linked(first, sets, least)

    of = components(near).withColumnRenamed("node", "_node")
    placed = written(join_small(members, of, F.col("node") == F.col("_node"), "left").select("band", "value", "node", "n", F.coalesce("component", "node").alias("c")), "placed")
    discard(members)
    mixed = placed.groupBy("band", "value").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select(F.col("band").alias("_band"), F.col("value").alias("_value"))
    open_ = join_small(placed, written(mixed, "mixed"), (F.col("band") == F.col("_band")) & (F.col("value") == F.col("_value")), "left_semi").select("node", "n", "c").distinct()
    more = written(_candidates(written(open_, "open"), sets, least).join(first, ["a", "b"], "left_anti"), "pairs")
    reclaim(docs.sparkSession)
    near = _linked(more, sets, least, near)
    found = components(near)
    for used in (placed, sets, first, more, near):
        discard(used)
    reclaim(docs.sparkSession)
    of = slim.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    return of.select("doc_id", "key", F.coalesce("component", "node").alias("group"))


def first_of_each(docs: DataFrame, **settings) -> DataFrame:
    """A row of docs for each group of near_copies, with its columns: that of the least id (null last), then
    of the least hash of id and text. Of rows that repeat both id and text one stays."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col("key").alias("_key"))
    first = near_copies(docs, **settings).groupBy("group").agg(F.min(place).alias("_first"))
    kept = written(first.select("_first._key"), "kept")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), row_key(docs["doc_id"], docs["text"]).alias("_of"))
    rows = rows.join(kept, F.col("_of") == F.col("_key"), "left_semi")
    place = Window.partitionBy("_of").orderBy(F.xxhash64("_row.text"))
    return rows.withColumn("_place", F.row_number().over(place)).where("_place = 1").select("_row.*")
