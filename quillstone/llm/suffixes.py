"""Byte-level deduplication by longest-previous-factor arrays.

A byte is removed when a string of ``length`` bytes covers it that also starts earlier in the corpus.

1. Of the k-grams in every ``length``-byte window the one with the least hash is its anchor (the leftmost of
   equals). Equal windows pick the same anchor, so a repeated string always repeats an anchor. The windows
   that pick one anchor follow each other; the bytes that they cover are its context.
2. Anchors meet by hash. Where an anchor's whole context occurred before, all of the context is covered.
   Anchors with more than one context stay open: they hold the edges of repeats.
3. Open anchors' windows are suffixes cut at ``length`` bytes. They are put in order: by anchor, then by a hash
   of the cut suffix, which stands for its bytes (only suffixes that agree in all ``length`` bytes have to be
   neighbours), ties in text order. In that order the previous smaller position of a suffix is the row before
   it, if both agree; so the longest previous factor reaches ``length`` there, and the window is a later copy.
4. Covered intervals are united per document.

Every task orders what it has before anything is shuffled, and passes on the first of equals only, so what
equal strings add to one task grows with the number of tasks, not with the number of copies. The windows of
an anchor are dealt to as many tasks as its contexts ask for, by their hash, which equal windows share.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import row_key
from quillstone.session import arrow_batches, discard, written

LENGTH = 100
GRAM = 40
#: Contexts of an anchor for each task that its windows are dealt to.
SPREAD = 64
#: Bytes of text that a task holds anchors of, and bytes of contexts that it holds windows of.
CHUNK = 48_000_000
HELD = 12_000_000
_LAST = np.iinfo(np.int64).max
_MARK = 2
_FIELDS = [("h", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("start", "<i4"), ("size", "<i4"), ("open", "u1")]
_WINDOW = [("h", "<u8"), ("w", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("step", "<i4")]
_MET = "h long, doc long, key long, start int, end int, payload binary, bucket long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _grams(b: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-gram, from those of doubling widths."""
    step, whole, covered = np.uint64(0xD6E8FEB86659FD93), None, 0
    h, width = _mix(b.astype(np.uint64) + np.uint64(1)), 1
    while True:
        if k & 1:
            if whole is None:
                whole, covered = h, width
            else:
                n = len(h) - covered
                whole, covered = _mix(whole[:n] * step + h[covered:]), covered + width
        k >>= 1
        if not k:
            return whole
        h, width = _mix(h[:-width] * step + h[width:]), width * 2


def anchors(b: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of each anchor of a text of at least ``length`` bytes."""
    window, low = length - gram + 1, np.uint64((1 << 24) - 1)
    places, hashes, firsts, lasts = [], [], [], []
    for at in range(0, len(b) - length + 1, 8_000_000):
        g = _grams(b[at : at + 8_000_000 + length - 1], gram)
        x, width = (g & ~low) | np.arange(len(g), dtype=np.uint64), 1
        while width * 2 <= window:
            x, width = np.minimum(x[:-width], x[width:]), width * 2
        if width < window:
            x = np.minimum(x[: len(x) - (window - width)], x[window - width :])
        p, first, n = np.unique(x & low, return_index=True, return_counts=True)  # the least moves on, never back
        p = p.astype(np.int64)
        places.append(p + at)
        hashes.append(g[p])
        firsts.append(first + at)
        lasts.append(first + n - 1 + at)
    p, h, lo, hi = (np.concatenate(x) for x in (places, hashes, firsts, lasts))
    if len(places) > 1:  # an anchor of windows on both sides of a cut
        _, first = np.unique(p, return_index=True)
        h, lo, hi = h[first], lo[first], hi[np.append(first[1:], len(p)) - 1]
    return h, lo, hi


def _pack(cols: list[np.ndarray]) -> bytes:
    raw = b"".join(np.ascontiguousarray(c).tobytes() for c in cols)
    return np.array([len(cols[0])], "<i8").tobytes() + zstandard.compress(raw, 1)


def _unpack(payload: bytes, fields: list[tuple[str, str]]) -> list[np.ndarray]:
    n, raw, at, out = int(np.frombuffer(payload[:8], "<i8")[0]), zstandard.decompress(payload[8:]), 0, []
    for _, kind in fields:
        size = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


def _united(doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Intervals per document, with those that touch made one."""
    order = np.lexsort((start, key, doc))
    doc, key, start, end = doc[order], key[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(key):
        return [doc, key, start.astype("<i4"), end.astype("<i4")]
    base = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))]) << 33  # so documents don't overlap
    reach = np.maximum.accumulate(base + end)
    new = np.concatenate([[True], base[1:] + start[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(key)]]) - 1
    return [doc[at], key[at], start[at].astype("<i4"), (reach[last] - base[at]).astype("<i4")]


def earlier_and_later(h, content, doc, key, start) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are the first of their content, in the order given; rows whose content starts earlier as well).

    Rows are ordered by content, ties by place: a row's previous smaller position with an equal content is
    then the row before. Rows at one place are one."""
    both = _mix(h) ^ content
    order = np.argsort(both)
    same = both[order[1:]] == both[order[:-1]]
    repeats = np.zeros(len(order), bool)
    repeats[order[1:][same]] = repeats[order[:-1][same]] = True
    rows = np.flatnonzero(repeats)
    rows = rows[np.lexsort((start[rows], key[rows], doc[rows], content[rows], h[rows]))]
    before, here = rows[:-1], rows[1:]
    new = np.ones(len(rows), bool)
    new[1:] = (h[here] != h[before]) | (content[here] != content[before])
    origin = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))] if len(rows) else rows
    there = (doc[rows] == doc[origin]) & (key[rows] == key[origin]) & (start[rows] == start[origin])
    return np.sort(np.concatenate([np.flatnonzero(~repeats), rows[new]])), rows[~new & ~there]


def _rows(h=None, spans=None, payloads=None) -> pa.RecordBatch:
    """Rows of the schema _MET: open anchors (h), covered intervals, or payloads (bucket, bytes)."""
    n = len(payloads) if payloads is not None else len(spans[0])
    none = lambda t: pa.nulls(n, t)
    place = [pa.array(c, t) for c, t in zip(spans, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)] if spans else [none(pa.int64()), none(pa.int64()), none(pa.int32()), none(pa.int32())]
    tail = [pa.array([x for _, x in payloads], pa.binary()), pa.array([x for x, _ in payloads], pa.int64())] if payloads is not None else [none(pa.binary()), place[1]]
    return pa.RecordBatch.from_arrays([none(pa.int64()) if h is None else pa.array(h.view("<i8")), *place, *tail], ["h", "doc", "key", "start", "end", "payload", "bucket"])


def _by_bucket(bucket: np.ndarray, cols) -> list[tuple[int, bytes]]:
    """A payload for each bucket; cols(rows) gives the columns of some rows, in their order."""
    order = np.argsort(bucket, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
    return [(int(bucket[p[0]]), _pack(cols(p))) for p in parts if len(p)]


def _anchored(docs: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """Payloads of anchors, and intervals that are covered."""

    def flush(held):
        h, ctx, doc, key, start, size = (np.concatenate([x[i] for x in held]) for i in range(6))
        first, later = earlier_and_later(h, ctx, doc, key, start)
        if len(later):
            yield _rows(spans=_united(doc[later], key[later], start[later], start[later] + size[later]))
        # An anchor with one context here goes to its own bucket, to meet others. One with several is known to be
        # open: its contexts are dealt out by themselves, and a mark tells its bucket.
        first = first[np.argsort(h[first], kind="stable")]
        begins = np.flatnonzero(np.concatenate([[True], h[first][1:] != h[first][:-1]]))
        sizes = np.diff(np.append(begins, len(first)))
        several = np.repeat(sizes > 1, sizes)
        mark = first[begins[sizes > 1]]
        pick = np.concatenate([first, mark])
        bucket = np.concatenate([np.where(several, _mix(h[first] + _mix(ctx[first])), _mix(h[first])), _mix(h[mark])]) % np.uint64(buckets)
        flag = np.concatenate([several.astype("u1"), np.full(len(mark), _MARK, "u1")])
        yield _rows(payloads=_by_bucket(bucket, lambda p: [h[pick[p]], ctx[pick[p]], doc[pick[p]], key[pick[p]], start[pick[p]], size[pick[p]].astype("<i4"), flag[p]]))

    def run(batches):
        held, total, digest = [], 0, xxhash.xxh64_intdigest
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                for doc, key, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if len(text) < length:
                        continue
                    h, lo, hi = anchors(np.frombuffer(text, np.uint8), length, gram)
                    hi = hi + length
                    ctx = np.array([digest(text[a:z]) for a, z in zip(lo.tolist(), hi.tolist(), strict=True)], "<u8")
                    held.append((h, ctx, np.full(len(h), doc), np.full(len(h), key), lo.astype("<i4"), (hi - lo).astype("<i4")))
                    total += len(text)
                    if total > CHUNK:
                        yield from flush(held)
                        held, total = [], 0
        if held:
            yield from flush(held)

    return docs.select("doc", "key", "text").mapInArrow(run, _MET)


def _met(table: DataFrame) -> DataFrame:
    """Anchors that are open, each with its context's first place (h not null), and covered intervals."""

    def run(batches):
        parts = []
        for b in batches:
            for payload, *span in zip(b.column(5).to_pylist(), *(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                parts.append(_unpack(payload, _FIELDS) if payload is not None else span)
        spans = [p for p in parts if not isinstance(p[0], np.ndarray)]
        parts = [p for p in parts if isinstance(p[0], np.ndarray)]
        if spans:
            yield _rows(spans=list(zip(*spans, strict=True)))
        if not parts:
            return
        h, ctx, doc, key, start, size, flag = (np.concatenate([p[i] for p in parts]) for i in range(7))
        parts.clear()
        known = np.unique(h[flag > 0])
        keep = flag < _MARK
        h, ctx, doc, key, start, size = (c[keep] for c in (h, ctx, doc, key, start, size))
        first, later = earlier_and_later(h, ctx, doc, key, start)
        if len(later):
            yield _rows(spans=_united(doc[later], key[later], start[later], start[later] + size[later]))
        first = first[np.argsort(h[first], kind="stable")]
        if not len(first):
            return
        of = h[first]
        new = np.concatenate([[True], of[1:] != of[:-1]])
        sizes = np.diff(np.append(np.flatnonzero(new), len(of)))
        pick = first[(np.repeat(sizes, sizes) > 1) | np.isin(of, known)]
        for at in range(0, len(pick), 50_000):
            p = pick[at : at + 50_000]
            yield _rows(h[p], [doc[p], key[p], start[p], start[p] + size[p]])

    return table.repartition("bucket").mapInArrow(run, _MET).drop("payload", "bucket")


def _windows(docs: DataFrame, met: DataFrame, length: int, buckets: int) -> DataFrame:
    """Payloads of the windows of open anchors, and intervals that are covered."""
    open_ = met.where("h is not null")
    ways = open_.groupBy("h").agg(F.count("*").alias("contexts")).where(F.col("contexts") > SPREAD)
    ways = written(ways.select(F.col("h").alias("_h"), F.ceil(F.col("contexts") / SPREAD).cast("int").alias("ways")), "ways")  # a table: so the join can be split
    dealt = open_.join(ways.hint("merge"), F.col("h") == F.col("_h"), "left")
    lists = dealt.groupBy(F.col("doc").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_list(F.struct("h", "start", "end", F.coalesce("ways", F.lit(1)).alias("ways"))).alias("asked"))
    texts = docs.join(lists.hint("merge"), (F.col("key") == F.col("_key")) & (F.col("doc") == F.col("_doc")))

    def flush(pieces, held):
        h, doc, key, start, ways = (np.array(c, np.int64) for c in zip(*held, strict=True))
        n = np.array([len(x) for x in pieces], np.int64)
        flat, base, n = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(n) - n, n - length + 1
        of = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        w = _grams(flat, length)[base[of] + within]
        h, doc, key, start = h[of].view("<u8"), doc[of], key[of], start[of] + within
        first, later = earlier_and_later(h, w, doc, key, start)
        if len(later):
            yield _rows(spans=_united(doc[later], key[later], start[later], start[later] + length))
        share = _mix(w[first]) % ways[of[first]].astype(np.uint64)
        bucket = _mix(h[first] + _mix(share)) % np.uint64(buckets)
        yield _rows(payloads=_by_bucket(bucket, lambda p: [c[first[p]] for c in (h, w, doc, key)] + [np.diff(start[first[p]], prepend=0).astype("<i4")]))

    def run(batches):
        pieces, held, total = [], [], 0
        for b in batches:
            for k in range(0, b.num_rows, 100):
                part = b.slice(k, 100)
                for doc, key, text, asked in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    for a in asked:
                        pieces.append(text[a["start"] : a["end"]])
                        held.append((a["h"], doc, key, a["start"], a["ways"]))
                        total += a["end"] - a["start"]
                        if total > HELD:
                            yield from flush(pieces, held)
                            pieces, held, total = [], [], 0
        if held:
            yield from flush(pieces, held)

    return texts.select("doc", "key", "text", "asked").mapInArrow(run, _MET)


def _copies(table: DataFrame, length: int) -> DataFrame:
    """(doc, key, start, end): intervals that are covered, those found before among them."""

    def run(batches):
        parts, spans = [], []
        for b in batches:
            for payload, *span in zip(b.column(5).to_pylist(), *(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if payload is None:
                    spans.append(span)
                else:
                    parts.append(_unpack(payload, _WINDOW))
        if spans:
            yield _spans(list(zip(*spans, strict=True)))
        if parts:
            h, w, doc, key = (np.concatenate([p[i] for p in parts]) for i in range(4))
            start = np.concatenate([np.cumsum(p[4], dtype=np.int32) for p in parts])
            parts.clear()
            _, later = earlier_and_later(h, w, doc, key, start)
            if len(later):
                yield _spans(_united(doc[later], key[later], start[later], start[later] + length))

    return table.repartition("bucket").mapInArrow(run, "doc long, key long, start int, end int")


def _spans(cols) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc", "key", "start", "end"])


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, key, spans): of each document that has any, its removed stretches (start, end), as found; they may
    overlap. docs has doc, key and text in bytes, none of them null."""
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = written(_met(_anchored(docs, length, gram, buckets)), "met")
    edges = _copies(_windows(docs, met, length, buckets), length)
    every = written(edges.unionByName(met.where("h is null").select("doc", "key", "start", "end")), "covered")
    discard(met)
    return every.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept, if asked for): a row for each row.

    Documents come in order of doc_id, null last. Null texts are empty. Rows that repeat both id and text
    are one document and get one result; rows that share an id but not the text come in the order of a
    hash. Texts below ``length`` bytes lose nothing. A cut may fall within a character: kept is bytes.
    Strings of ``length`` bytes count as equal if two 64-bit hashes agree, that of the string and that of
    its anchor; documents are told apart by their id and, where they share it, by a 64-bit hash of the text.
    """
    arrow_batches(docs.sparkSession)
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    doc = docs["doc_id"].cast("long")
    slim = docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(int(_LAST))).alias("doc"), row_key(docs["doc_id"], docs["text"]).alias("key"), text.alias("text"))
    found = covered(slim, length, gram).withColumnsRenamed({"doc": "_doc", "key": "_key"})
    joined = slim.join(found.hint("merge"), (F.col("key") == F.col("_key")) & (F.col("doc") == F.col("_doc")), "left").select("doc_id", "text", "spans")

    def cut(batches):
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part, rows = b.slice(k, 500), []
                for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    rest, at, removed, stretches = [], 0, 0, 0
                    if spans:
                        one = np.zeros(len(spans), np.int64)
                        *_, starts, ends = _united(one, one, np.array([s["start"] for s in spans]), np.array([s["end"] for s in spans]))
                        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                            rest.append(text[at:s])
                            removed, stretches, at = removed + e - s, stretches + 1, e
                    rest = b"".join([*rest, text[at:]])
                    rows.append((len(text), removed, stretches, hashlib.sha256(rest).hexdigest(), rest))
                cols = list(zip(*rows, strict=True))[: 5 if kept else 4]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if kept else 5]
    kinds = ["long", "long", "long", "long", "string", "binary"]
    return joined.mapInArrow(cut, ", ".join(f"{n} {t}" for n, t in zip(names, kinds, strict=False)))
