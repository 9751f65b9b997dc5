"""A hidden Markov language model, trained by Baum-Welch over all partitions.

Tokens are counted over all training texts. The most frequent types are classes of their own; all others
form one class, within which a token's chance is its smoothed share, whatever the state. So the model is a
proper distribution over all tokens, unseen ones included (they share one place, as in the base score).

Training: each pass runs forward and backward over every whole training text, and the expected counts are added
up per state and class across partitions; what comes to the driver has states x classes numbers, whatever the
corpus. The start is fitted on a bounded sample, chosen by a hash of the row. Passes over the whole corpus end
when its likelihood hardly gains. Scoring: the scaled forward recursion over each whole text gives its exact
log-likelihood.

Long texts are run in stretches side by side: the product of a stretch's transfer matrices tells what enters
and leaves it, so the recursions over the stretches are those over the whole text.
"""

from __future__ import annotations

import logging
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import about
from quillstone.session import arrow_batches, written

log = logging.getLogger(__name__)

#: Classes of one type each; types whose counts every worker holds; the rest are joined by a shuffle.
CLASSES = 4_095
CACHED = 150_000
STATES = 8
#: Passes over the whole corpus, at most; and the gain in nats a token below which there is no further one.
PASSES = 3
GAIN = 0.002
#: Texts that the start is fitted on, and rounds.
SAMPLE = 800
ROUNDS = 12
STRETCH = 256
END = b""


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words (bytes.lower() changes A-Z only), then the end."""
    return [*(text or b"").lower().split(), END]


def count(texts: DataFrame) -> DataFrame:
    """(token, c) over a column text of bytes."""

    def run(batches):
        tally: Counter = Counter()
        for b in batches:
            for k in range(0, b.num_rows, 200):
                for t in b.column(0).slice(k, 200).to_pylist():
                    tally.update(tokens(t))
                if len(tally) > 400_000:
                    yield out(tally)
                    tally = Counter()
        yield out(tally)

    def out(tally):
        return pa.RecordBatch.from_arrays([pa.array(tally.keys(), pa.binary()), pa.array(tally.values(), pa.int64())], ["token", "c"])

    return texts.mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Chain:
    """Start, transition and emission probabilities; emission[class, state]. Class 0 is the rare one."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def seeded(unigram: np.ndarray, states: int) -> Chain:
        noise = np.random.default_rng(7).gamma(1.0, 1.0, (len(unigram), states)) + 0.1
        emit = unigram[:, None] * noise
        return Chain(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(0))

    @staticmethod
    def from_counts(first: np.ndarray, pairs: np.ndarray, seen: np.ndarray, unigram: np.ndarray) -> Chain:
        """Expected counts, smoothed by Dirichlet priors: even ones, and the unigram for emissions."""
        start, move = first + 1, pairs + 1
        emit = seen + 20 * unigram[:, None]
        return Chain(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def _run(self, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ln of the mass, the normed mass at the end) of sequences whose first token has the forward values alpha."""
        order = np.argsort(-lengths, kind="stable")
        begins, lengths, a = begins[order], lengths[order], alpha[order]
        total, end = np.zeros(len(order)), np.empty_like(a)
        ends = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right") if len(order) else []
        for t, active in enumerate(ends):
            if t:
                a = (a[:active] @ self.move) * self.emit[flat[begins[:active] + t]]
            scale = a.sum(1)
            total[:active] += np.log(scale)
            a = a / scale[:, None]
            end[:active] = a
        back = np.argsort(order)
        return total[back], end[back]

    def _transfers(self, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(matrices of sum 1, ln of their scale): what each stretch makes of the mass of the token before it."""
        k = len(self.start)
        order = np.argsort(-lengths, kind="stable")
        begins, lengths = begins[order], lengths[order]
        p, total = np.repeat(np.eye(k)[None], len(order), 0), np.zeros(len(order))
        for t, active in enumerate(np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right") if len(order) else []):
            x = (p[:active] @ self.move) * self.emit[flat[begins[:active] + t]][:, None, :]
            scale = x.sum((1, 2))
            total[:active] += np.log(scale)
            p[:active] = x / scale[:, None, None]
        back = np.argsort(order)
        return p[back], total[back]

    def _joined(self, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, stretch: int, both: bool):
        """(ln likelihood of each text; begin, length, place and incoming mass of each stretch; what is to come
        behind each stretch, if ``both``)."""
        pieces = -(-lengths // stretch)
        first = np.cumsum(pieces) - pieces
        of = np.repeat(np.arange(len(begins)), pieces)
        nth = np.arange(len(of)) - first[of]
        b, n = begins[of] + nth * stretch, np.minimum(stretch, lengths[of] - nth * stretch)
        heads, rest = np.flatnonzero(nth == 0), np.flatnonzero(nth > 0)
        k = len(self.start)
        came, after = np.zeros((len(of), k)), np.ones((len(of), k))
        total, mass = self._run(flat, b[heads], n[heads], self.start * self.emit[flat[b[heads]]])
        matrix = np.zeros((len(of), k, k) if len(rest) else (0, k, k))
        scales = np.zeros(len(of))
        if len(rest):
            matrix[rest], scales[rest] = self._transfers(flat, b[rest], n[rest])
        for j in range(1, int(pieces.max(initial=1))):
            texts = np.flatnonzero(pieces > j)
            at = first[texts] + j
            came[at] = mass[texts]
            new = np.einsum("nk,nkl->nl", mass[texts], matrix[at])
            scale = new.sum(1)
            total[texts] += np.log(scale) + scales[at]
            mass[texts] = new / scale[:, None]
        if both:
            for j in range(int(pieces.max(initial=1)) - 1, 0, -1):
                at = first[np.flatnonzero(pieces > j)] + j
                new = np.einsum("nkl,nl->nk", matrix[at], after[at])
                after[at - 1] = new / new.sum(1, keepdims=True)
        return total, b, n, nth, came, after

    def forward(self, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, stretch: int | None = None) -> np.ndarray:
        """ln likelihood of each sequence flat[begin : begin + length]; every length is 1 or more."""
        return self._joined(flat, begins, lengths, stretch or STRETCH, False)[0]

    def expect(self, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, stretch: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, transitions and emissions of whole sequences, and the sum of their ln likelihoods."""
        k, v = len(self.start), len(self.emit)
        first, pairs, seen = np.zeros(k), np.zeros((k, k)), np.zeros((v, k))
        total, begins, lengths, nth, came, after = self._joined(flat, begins, lengths, stretch or STRETCH, True)
        order = np.argsort(-lengths, kind="stable")
        for at in range(0, len(order), 1024):
            o = order[at : at + 1024]
            b, n, h = begins[o], lengths[o], nth[o] == 0
            before, behind = came[o], after[o]
            ends = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")
            alphas, scales, ids = [], [], []
            a = np.where(h[:, None], self.start, before @ self.move)
            for t, active in enumerate(ends):
                x = flat[b[:active] + t]
                a = (a[:active] @ self.move if t else a) * self.emit[x]
                s = a.sum(1, keepdims=True)
                a = a / s
                alphas.append(a)
                scales.append(s)
                ids.append(x)
            gammas = [np.empty(0)] * len(ends)
            beta = np.ones((0, k))
            for t in range(len(ends) - 1, -1, -1):
                if len(beta) < ends[t]:  # stretches that end here
                    new = behind[len(beta) : ends[t]]
                    beta = np.concatenate([beta, new / (alphas[t][len(beta) :] * new).sum(1, keepdims=True)])
                gammas[t] = alphas[t] * beta
                w = self.emit[ids[t]] * beta / scales[t]
                if t:
                    pairs += alphas[t - 1][: ends[t]].T @ w
                    beta = w @ self.move.T
                else:
                    pairs += before[~h].T @ w[~h]
            first += gammas[0][h].sum(0)
            x, g = np.concatenate(ids), np.concatenate(gammas)
            for j in range(k):
                seen[:, j] += np.bincount(x, weights=g[:, j], minlength=v)
        return first, pairs * self.move, seen, float(total.sum())


def _flat(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x, "<u2") for x in column.to_pylist()]
    n = np.array([len(x) for x in parts], np.int64)
    return (np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)), np.cumsum(n) - n, n


def _pass(encoded: DataFrame, chain: Chain, unigram: np.ndarray) -> tuple[Chain, float]:
    """One round of Baum-Welch over all training texts: the new chain, and the old one's ln likelihood."""
    k, v = len(chain.start), len(unigram)

    def run(batches):
        first, pairs, seen, total = np.zeros(k), np.zeros((k, k)), np.zeros((v, k)), 0.0
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                flat, begins, lengths = _flat(b.column(0).slice(at, 1000))
                if len(begins):
                    *parts, ln = chain.expect(flat, begins, lengths)
                    total += ln
                    for sums, part in zip((first, pairs, seen), parts, strict=True):
                        sums += part
        values = np.concatenate([[total], first, pairs.ravel(), seen.ravel()])
        at = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(values[at])], ["at", "value"])

    rows = encoded.select("ids").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    values = np.zeros(1 + k + k * k + v * k)
    values[rows["at"].to_numpy(np.int64)] = rows["value"].to_numpy(float)
    total, values = float(values[0]), values[1:]
    return Chain.from_counts(values[:k], values[k : k + k * k].reshape(k, k), values[k + k * k :].reshape(v, k), unigram), total


def train(encoded: DataFrame, unigram: np.ndarray, texts: int, tokens: int, states: int, passes: int) -> tuple[Chain, list[float]]:
    """A chain from encoded texts (key, ids), and the corpus's ln likelihood a token before each pass over it."""
    chain, history = Chain.seeded(unigram, states), []
    sample = about(encoded, SAMPLE, texts, F.col("key")).dropDuplicates(["key"]).orderBy("key").select("ids").toArrow()  # bounded: repeated rows come once
    if not sample.num_rows:
        return chain, history
    flat, begins, lengths = _flat(sample.column(0))
    for _ in range(ROUNDS):
        *parts, _total = chain.expect(flat, begins, lengths)
        chain = Chain.from_counts(*parts, unigram)
    for _ in range(passes):
        chain, total = _pass(encoded, chain, unigram)
        history.append(total / max(1, tokens))
        log.info("Baum-Welch: ln likelihood a token %.4f", history[-1])
        if len(history) > 1 and history[-1] - history[-2] < GAIN:
            break
    return chain, history


def score(docs: DataFrame, held_out, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row for each row of docs.

    held_out: a boolean Column over docs; those rows teach nothing. Null texts are empty ones: one token,
    the end. Repeated rows count, and are scored, each for itself. Without training texts, every token
    is unseen; an empty table gives no rows. Neither the order of rows nor their partitions change the model,
    but for the last digits of sums.
    """
    arrow_batches(docs.sparkSession)
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), docs["text"].cast("binary").alias("text"), F.xxhash64("doc_id", "text").alias("key"))
    counts = written(count(slim.where(~F.col("held_out")).select("text")), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = int(total[0]), int(total[1])
    # The most frequent types, and the end, which is a class always: a bounded table, whatever the corpus. Types
    # are counted by the logarithm of their frequency first, so only those that are held come to the driver.
    grade = F.floor(F.log("c") * 100)
    grades = counts.groupBy(grade.alias("grade")).count().orderBy(F.desc("grade")).toPandas()
    fit = grades["grade"][grades["count"].cumsum() <= CACHED]
    top = counts.where((grade >= (int(fit.min()) if len(fit) else 1 << 40)) | (F.length("token") == 0)).toPandas()
    held = sorted(((bytes(t), int(k)) for t, k in zip(top["token"], top["c"], strict=True)), key=lambda x: (x[0] != END, -x[1], x[0]))
    names, c = [t for t, _ in held], np.array([k for _, k in held], np.int64)
    classes = min(CLASSES, len(c))
    rare_n, rare_v = n - int(c[:classes].sum()), v - classes
    table = docs.sparkSession.sparkContext.broadcast((names, c))

    def encode(batches):
        names, c = table.value
        index = {w: i for i, w in enumerate(names)}
        logs, get = np.append(np.log10(c + 0.5), 0.0), index.get
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                cols: list[list] = [[] for _ in range(8)]
                for t in part.column(2).to_pylist():
                    words = tokens(t)
                    at = np.array([get(w, -1) for w in words], np.int64)
                    tail = Counter([w for w, i in zip(words, at.tolist(), strict=True) if i < 0])
                    held = logs[at]
                    rare = (at >= classes) | (at < 0)
                    for col, x in zip(cols, (row, len(words), int((at >= 0).sum()), float(held.sum()), float(held[rare].sum()), int(rare.sum()), np.where(rare, 0, at + 1).astype("<u2").tobytes(), list(tail.items())), strict=True):
                        col.append(x)
                    row += 1
                kinds = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.int64(), pa.binary(), pa.map_(pa.binary(), pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], schema.split(";"))

    schema = "doc_id;held_out;key;row;n_tokens;known;held;held_rare;rare;ids;tail"
    encoded = written(slim.mapInArrow(encode, "doc_id long, held_out boolean, key long, row long, n_tokens long, known long, held double, held_rare double, rare long, ids binary, tail map<binary,long>"), "encoded")

    unigram = np.concatenate([[rare_n + 0.5 * (rare_v + 1)], c[:classes] + 0.5]).astype(float)
    unigram /= unigram.sum()
    texts = int(c[0]) if names and names[0] == END else 0
    chain, _ = train(encoded.where(~F.col("held_out")), unigram, texts, n, states, passes)

    def likelihood(batches):
        for b in batches:
            parts = []
            for at in range(0, b.num_rows, 1000):
                parts.append(chain.forward(*_flat(b.column(6).slice(at, 1000))))
            ln = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(ln / np.log(10))], names=[*b.schema.names[:6], "chain"])

    slots = "row", "doc_id", "held_out", "n_tokens", "known", "rare", "ids", "held", "held_rare"
    scored = encoded.select(*slots).mapInArrow(lambda batches: _with(batches, likelihood), "row long, doc_id long, held_out boolean, n_tokens long, known long, rare long, chain double, held double, held_rare double")
    # The tail: tokens that are not in the table, each text's with its count.
    tail = encoded.select("row", F.explode("tail").alias("token", "times")).join(counts.withColumnRenamed("token", "_token").hint("merge"), F.col("token") == F.col("_token"), "left")
    known = F.coalesce("c", F.lit(0))
    tail = tail.groupBy("row").agg(F.sum(F.col("times") * F.log10(known + 0.5)).alias("tail"), F.sum(F.when(known > 0, F.col("times")).otherwise(0)).alias("tail_known")).withColumnRenamed("row", "_row")
    joined = scored.join(tail, F.col("row") == F.col("_row"), "left").na.fill(0, ["tail", "tail_known"])
    whole, rest = float(np.log10(n + 0.5 * (v + 1))), float(np.log10(rare_n + 0.5 * (rare_v + 1)))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("tail_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("held") + F.col("tail") - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("chain") + F.col("held_rare") + F.col("tail") - F.col("rare") * rest).alias("score"),
    )


def _with(batches, f):
    """f over each batch, with the batch's last two columns behind what f returns."""
    for b in batches:
        for out in f(iter([b])):
            yield pa.RecordBatch.from_arrays([*out.columns, *b.columns[-2:]], names=[*out.schema.names, *b.schema.names[-2:]])
