"""Importance resampling towards a target distribution, with overlap chunking of long texts.

Features are runs of 1 to n consecutive words, hashed into buckets. A bucket's gain is the log ratio of its share in
the target texts to its share in the corpus. A document weighs the mean gain of its features; adding Gumbel noise,
fixed by a hash of its id, makes the highest scores a sample without replacement.

A text of more than ``size`` bytes is split at word boundaries. A chunk owns the features that start in it, and
carries the next n - 1 words besides, so every feature is counted once, in one chunk. Chunks are dealt out to all tasks,
and their counts and gains are summed by document. Shorter texts stay where they are read.
"""

from __future__ import annotations

import math
import re
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import row_key
from quillstone.operators.bounds import numbered
from quillstone.session import arrow_batches, written

#: Words are what stands between ASCII signs, after A-Z are lower-cased: on UTF-8 bytes as on characters.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
BUCKETS = 10_000
ORDER = 2
SIZE = 1 << 16
LEAST_WORDS = 20
PERCENT = 25
SEED = 7


def chunks(text: bytes, size: int = SIZE, order: int = ORDER) -> list[tuple[bytes, int]]:
    """(chunk, words at its end that it only carries): chunks are cut at the first gap after ``size`` bytes. The text is lower-cased."""
    at, out = 0, []
    while at < len(text) or not out:
        gap = _GAP.search(text, at + size)
        end = gap.start() if gap else len(text)
        carry = [m.end() for m in islice(_WORD.finditer(text, end), order - 1)] if end < len(text) else []
        out.append((text[at : carry[-1] if carry else end], len(carry)))
        at = end
    return out


def features(text: bytes, carry: int = 0, order: int = ORDER, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(words owned, buckets of the features that start at them). A run's hash goes on from that of the run a word shorter."""
    words = _WORD.findall(text)
    own, hashes = len(words) - carry, list(map(crc32, words))
    every, spaced = hashes[:own], [b" " + w for w in words]
    for n in range(1, order):
        hashes = list(map(crc32, spaced[n:], hashes))
        every += hashes[:own]
    return own, np.array(every, np.int64) % buckets


def _pieces(texts: DataFrame, size: int, order: int) -> tuple[DataFrame, DataFrame]:
    """(texts that are a piece of their own, chunks of the longer ones): doc, carry, text. texts: doc struct, text binary."""

    def split(batches):
        for b in batches:
            for at in range(b.num_rows):
                parts = chunks(b.column(1)[at].as_py().lower(), size, order)
                for lo in range(0, len(parts), 256):
                    some = parts[lo : lo + 256]
                    row = b.column(0).take(pa.array([at] * len(some)))
                    yield pa.RecordBatch.from_arrays([row, pa.array(range(lo, lo + len(some)), pa.int32()), pa.array([c for _, c in some], pa.int32()), pa.array([t for t, _ in some], pa.binary())], ["doc", "piece", "carry", "text"])

    schema = f"doc {texts.schema['doc'].dataType.simpleString()}, piece int, carry int, text binary"
    whole = texts.where(F.octet_length("text") <= size).select("doc", F.lit(0).alias("carry"), "text")
    long = texts.where(F.octet_length("text") > size).withColumn("doc", F.col("doc").withField("row", F.monotonically_increasing_id()))
    return whole, long.mapInArrow(split, schema).repartition("doc.row", "piece").select("doc", "carry", "text")


def bucket_counts(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS, size: int = SIZE) -> np.ndarray:
    """How many features of all texts each bucket has. A task adds up its own; what comes together is a number of
    buckets from each, and of those the driver gets one."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for text, carry in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total += np.bincount(features(text.lower(), carry, order, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    whole, long = _pieces(docs.select(F.struct(F.lit(0).cast("long").alias("row")).alias("doc"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text")), size, order)
    each = whole.select("text", "carry").unionByName(long.select("text", "carry")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most a row for each bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of shares, with one added to every count, rounded down."""
    n, big, small = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (big + n) / ((s + 1.0) * (small + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, order: int = ORDER, size: int = SIZE) -> DataFrame:
    """(doc_id, key, n_words, n_features, total): a row for each row of docs, with the sum of its features' gains."""

    def run(batches):
        for b in batches:
            words, count, total = [], [], []
            for text, carry in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True):
                own, f = features(text.lower(), carry, order, len(gain))
                words.append(own)
                count.append(len(f))
                total.append(int(gain[f].sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (words, count, total))], ["doc", "n_words", "n_features", "total"])

    row = F.struct(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs["doc_id"], docs["text"]).alias("key"), F.lit(None).cast("long").alias("row"))
    whole, long = _pieces(docs.select(row.alias("doc"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text")), size, order)
    schema = "doc struct<doc_id:bigint,key:bigint,row:bigint>, n_words long, n_features long, total long"
    summed = long.mapInArrow(run, schema).groupBy("doc").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "total")])
    return whole.mapInArrow(run, schema).unionByName(summed).select("doc.doc_id", "doc.key", "n_words", "n_features", "total")


def scores(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, size: int = SIZE) -> DataFrame:
    """(doc_id, key, n_words, n_features, weight, score, rank): a row for each row of docs. rank counts the drawn from 1,
    highest scores first, ties to the smaller id (null last), then to the hash of id and text; it is null for others.

    Null texts are empty: no features, weight 0, never drawn while least_words is above 0. Rows without an id have the noise of an empty
    id; rows that repeat are drawn each by itself. An empty target gives gains by rarity alone, an empty table no rows."""
    arrow_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, order, buckets, size), bucket_counts(target, order, buckets, size))
    rows = written(weigh(docs, gain, order, size), "weights")
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0).cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = rows.withColumn("weight", weight).withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "scores")
    able = F.col("n_words") >= least_words
    n = rows.where(able).count() * percent // 100
    order_by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("key"), F.col("row")]
    ranked = numbered(rows.where(able), order_by, "place").withColumn("rank", F.when(F.col("place") < n, F.col("place") + 1)).drop("place")
    return ranked.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long"))).drop("row", "total")


def draw(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn rows of docs, with their columns. Rows that repeat id and text follow each other in the ranking, so only
    those of one key can be drawn in part; as they are equal, any of them are."""
    every = written(scores(docs, target, **settings).select("key", "rank"), "ranks")
    keys = written(every.groupBy("key").agg(F.count("*").alias("n"), F.count("rank").alias("drawn")).where("drawn > 0"), "drawn")
    of = row_key(docs["doc_id"], docs["text"])
    out = docs.join(keys.where("drawn = n").select(F.col("key").alias("_key")), of == F.col("_key"), "left_semi")
    for r in keys.where("drawn < n").collect():  # one at most
        out = out.unionByName(docs.where(of == r.key).limit(r.drawn))
    return out
