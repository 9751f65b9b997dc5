"""Packing by concatenating and cutting.

Pass one tokenizes every document once, and writes its ids with its place among its partition's tokens.
A prefix sum over the partitions' totals (a row each) then gives every document its place in the one
long sequence of all tokens. Pass two cuts that sequence into windows of fixed length. Each piece is a
record: a document that crosses a boundary has several. Only the last window can have room left.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import join_small
from quillstone.session import arrow_batches, written

END = 0


#: How byte-level BPE splits a text before merging. A fixed value: ids depend on it.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def encoder(path: str):
    """(text -> ids, vocabulary size) of a tokenizers file, without special tokens added.

    If the file is a plain byte-level BPE, whose merges are numbered in their order, merging by rank gives
    the same ids several times faster. Any other file, and any text that holds an added token, goes
    through the tokenizers library itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    whole = Tokenizer.from_file(path)
    slow = lambda text: whole.encode(text, add_special_tokens=False).ids
    size, model, before = whole.get_vocab_size(), spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    plain = plain and not spec.get("normalizer") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model.get("merges", [])]
    at = [model["vocab"].get(a + b, -1) for a, b in merges]
    if not plain or at != list(range(256, 256 + len(at))):
        return slow, size
    # Byte-level files write a printable byte as itself, and the others, in order, from U+0100 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte[c] for c in word): i for word, i in model["vocab"].items() if i < 256 + len(at)}
    import tiktoken

    fast = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
    added = [x["content"] for x in spec.get("added_tokens", [])]
    return (lambda text: slow(text) if any(x in text for x in added) else fast.encode_ordinary(text)), size


def tokenized(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """(doc_id, part, start, n, ids): ids as little-endian unsigned 16-bit numbers, or 32-bit ones if the
    vocabulary is larger, closed by the end id; start counts the tokens before it in its partition."""

    def run(batches):
        encode, size = encoder(tokenizer)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            for k in range(0, b.num_rows, 256):
                ids = [np.array([*encode(x or ""), end], kind) for x in b.column(1).slice(k, 256).to_pylist()]
                n = np.array([len(x) for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(k, 256), pa.array([part] * len(n), pa.int64()), pa.array(starts), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["doc_id", "part", "start", "n", "ids"],
                )

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return slim.mapInArrow(run, "doc_id long, part long, start long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row for each piece.

    A null text is an empty one, and has the end id alone. Repeated rows are packed as often as they
    occur, each for itself. An empty table gives no pieces.
    """
    arrow_batches(docs.sparkSession)
    tokens = written(tokenized(docs, tokenizer, end), "tokens")
    parts = tokens.groupBy("part").agg(F.sum("n").alias("total"))  # a row for each partition of the input
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = written(parts.select(F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).alias("base")), "bases")
    placed = join_small(tokens, parts, F.col("part") == F.col("_part"), rows=1_000_000)

    def cut(batches):
        for b in batches:
            rows = []
            for doc, at, n, ids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                x = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                pos = 0
                while pos < n:
                    seq, off = divmod(at + pos, length)
                    k = min(length - off, n - pos)
                    rows.append((doc, pos, k, zlib.crc32(x[pos : pos + k].tobytes()), n, seq, off))
                    pos += k
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.select("doc_id", (F.col("base") + F.col("start")).alias("at"), "n", "ids").mapInArrow(cut, ", ".join(f"{c} long" for c in names))
