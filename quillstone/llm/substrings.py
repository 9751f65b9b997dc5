"""Substring deduplication by sliding sentence spans.

A text is cut into sentences; a sentence of over ``WINDOW`` words is cut further, after the word of the least
hash in each window of so many words. So the cuts are the same wherever the passage stands, but for those
before the first and after the last of its own windows, and no piece is longer than a window: 51 words have
31 or more between cuts that they have everywhere, and three pieces at most 30. From every sentence on, the shortest run of at least
``several`` sentences and ``words`` words is hashed. Runs are counted over all documents. A sentence that
any run covers which is not the first of its kind, in order of document and place, is removed.
"""

from __future__ import annotations

import re
import struct
import zlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import row_key
from quillstone.session import arrow_batches, written

SEVERAL = 3
WORDS = 15
#: A sentence is cut after the word of the least hash in each so many words.
WINDOW = 10
_CUT = re.compile(r"(?<=[.!?…])(?=\s)|(?<=\n)|(?<=[。！？])")
_WORDS = re.compile(r"\s*\S+")


def _least(words: list[str], window: int) -> list[int]:
    """The places that have the least hash (the last of equal ones) in some window of so many words."""
    hashes = [zlib.crc32(w.encode(errors="surrogatepass")) for w in words]
    out, low = [], -1
    for end in range(window, len(words) + 1):
        if low < end - window:
            low = end - window
            for i in range(low + 1, end):
                if hashes[i] <= hashes[low]:
                    low = i
            out.append(low)
        elif hashes[end - 1] <= hashes[low]:
            low = end - 1
            out.append(low)
    return out


def sentences(text: str, window: int = WINDOW) -> list[tuple[str, list[str]]]:
    """(piece, its words in lower case); the pieces joined are the text, and each has a word, if any has."""
    out: list[tuple[str, list[str]]] = []

    def add(piece: str, words: list[str]) -> None:
        if not words and out:
            out[-1] = (out[-1][0] + piece, out[-1][1])
        elif words and out and not out[-1][1]:
            out[-1] = (out[-1][0] + piece, words)
        else:
            out.append((piece, words))

    for piece in _CUT.split(text):
        words = piece.lower().split()
        if len(words) <= window:
            if piece:
                add(piece, words)
            continue
        parts, at = _WORDS.findall(piece), 0
        for i in _least(words, window):
            if i + 1 < len(words):
                add("".join(parts[at : i + 1]), words[at : i + 1])
                at = i + 1
        add("".join(parts[at:]) + piece[sum(map(len, parts)) :], words[at:])
    return out


def _spans(pieces: list[tuple[str, list[str]]], several: int, least: int) -> list[tuple[int, int, int, int]]:
    """(hash of 96 bits in two numbers, first sentence, sentences) of the run from each sentence on."""
    words = [" ".join(w).encode(errors="surrogatepass") for _, w in pieces]
    counts = [len(w) for _, w in pieces]
    out, end, total = [], 0, 0
    for i in range(len(pieces)):
        while end < len(pieces) and (end - i < several or total < least):
            total += counts[end]
            end += 1
        if end - i < several or total < least:
            break
        out.append((*struct.unpack("<qi", xxhash.xxh3_128_digest(b"\n".join(words[i:end]))[:12]), i, end - i))
        total -= counts[i]
    return out


def spans(docs: DataFrame, several: int = SEVERAL, words: int = WORDS) -> DataFrame:
    """(h1, h2, doc_id, key, first, n): a row for every run."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                cols: list[list] = [[] for _ in range(6)]
                for doc, key, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    found = _spans(sentences(text or ""), several, words)
                    if found:
                        for c, v in zip(cols, (*zip(*found, strict=True),), strict=False):
                            c.extend(v)
                        cols[4].extend([doc] * len(found))
                        cols[5].extend([key] * len(found))
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["h1", "h2", "first", "n", "doc_id", "key"])

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs["doc_id"], docs["text"]).alias("key"), docs["text"])
    return slim.mapInArrow(run, "h1 long, h2 int, first int, n int, doc_id long, key long")


def deduplicate(docs: DataFrame, several: int = SEVERAL, words: int = WORDS) -> DataFrame:
    """docs with the sentences removed from text; a row for each row of docs, with the columns of docs.

    The first occurrence is that of the least doc_id (null last), then of the first sentence. Null and
    empty texts stay as they are, as do texts of fewer than ``several`` sentences. Rows that repeat both
    id and text are one document, and each of them keeps what it keeps. Of copies under different ids, the
    least keeps its text, and the others keep the last sentences of a text that is too short for a run. Runs are
    equal if 96-bit hashes are (of 10^12 runs, two different ones share one with a chance of 6 in a million); rows are told apart by id and, where they share it, by a 64-bit hash of the text.
    """
    return _cut(docs, several, words).select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def removed(docs: DataFrame, several: int = SEVERAL, words: int = WORDS) -> DataFrame:
    """(doc_id, n_removed, text): how many sentences went, and what is left."""
    return _cut(docs, several, words).select(F.col("_row.doc_id").alias("doc_id"), F.col("_removed").alias("n_removed"), "text")


def _cut(docs: DataFrame, several: int, words: int) -> DataFrame:
    """(_row, text, _removed): _row has docs' other columns, so their names can't clash."""
    arrow_batches(docs.sparkSession)
    runs = written(spans(docs, several, words), "spans")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "first")
    seen = runs.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(place).alias("origin")).where("times > 1")
    # Runs of a very frequent passage share a key. As the other side is a table of its own, both sides of the
    # join are plain shuffles, of which adaptive execution splits the skewed partitions.
    seen = written(seen.select("h1", "h2", "origin"), "repeated")
    again = runs.join(seen.hint("merge"), ["h1", "h2"]).where(place != F.col("origin"))
    gone = again.groupBy("key", "doc_id").agg(F.collect_set(F.struct("first", "n")).alias("_gone")).withColumnsRenamed({"key": "_of", "doc_id": "_of_id"})

    names = docs.columns
    keyed = docs.select(F.struct(*[docs[c] for c in names if c != "text"]).alias("_row"), docs["text"], docs["doc_id"].cast("long").alias("_id"), row_key(docs["doc_id"], docs["text"]).alias("_key"))
    joined = keyed.join(gone, (F.col("_key") == F.col("_of")) & F.col("_id").eqNullSafe(F.col("_of_id")), "left").select("_row", "text", "_gone")

    def cut(batches):
        for b in batches:
            texts, removed = [], []
            for text, runs_gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                drop = {i for r in runs_gone or () for i in range(r["first"], r["first"] + r["n"])}
                if drop:
                    text = "".join(p for i, (p, _) in enumerate(sentences(text)) if i not in drop)
                texts.append(text)
                removed.append(len(drop))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["_row", "text", "_removed"])

    return joined.mapInArrow(cut, joined.select("_row", "text").schema.add("_removed", "long"))
