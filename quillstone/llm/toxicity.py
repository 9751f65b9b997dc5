"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values.

1. In labelled documents, every word and its first 4, 5 and 6 characters are counted by class. A unit's toxic
   share has a Beta prior (a two-class Dirichlet) centred on its shorter prefix's share, and that of the
   shortest on one half. So inflected forms that training never saw get their stem's log-odds. A unit speaks,
   for either side, if it or a prefix of it has evidence: a log-likelihood ratio against chance.
2. A document's words score their log-odds less a constant drift. One linear scan (Ruzzo and Tompa) finds
   all maximal segments.
3. Under chance, the best segment of n words follows an extreme-value law: lambda * S - ln(K n) is
   standard Gumbel. lambda and K are fitted to labelled clean documents. Segments that chance gives to
   fewer than 1 in 20 documents are significant.
4. A logistic link, fitted to labelled documents, turns the best calibrated segment and the number of
   significant ones into a score from 0 to 1.

Labelled documents fall into folds. For 3 and 4 a document is scored by what the other folds have counted, as
a new one would be; and so are prior, drift and evidence chosen: those with the least log loss.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import about
from quillstone.session import arrow_batches, discard, written

#: About how many labelled rows of each class the classifier is fitted to, at most.
SAMPLE = 20_000
#: Units that the model holds, at most: those with the strongest evidence.
UNITS = 100_000
FOLDS = 4
#: What is tried: the prior's weight in documents, the drift, and the evidence that a unit needs.
PRIORS = (2.0, 8.0, 32.0)
DRIFTS = (0.25, 0.5, 1.0)
EVIDENCES = (4.0, 15.0)
SIGNIFICANT = 0.05
_EDGES = ".,;:!?\"'()[]{}<>*_~-"
_PREFIXES = (6, 5, 4)


def _words(text: str | None) -> list[str]:
    return [w for x in (text or "").lower().split() if (w := x.strip(_EDGES))]


def _units(word: str) -> list[str]:
    """The word itself, then ever shorter prefixes, marked by a blank, which words have not."""
    return [word, *[word[:k] + " " for k in _PREFIXES if len(word) > k], *([word + " "] if len(word) == 4 else [])]


def _segments(scores) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last) of a list of scores, by the scan of Ruzzo and Tompa. Each
    candidate knows the last one before it with a lower sum on its left, so every step back is taken once."""
    scores = np.asarray(scores, float)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    left: list[float] = []
    right: list[float] = []
    first: list[int] = []
    lower: list[int] = []
    last: list[int] = []
    for k in np.flatnonzero(scores > 0).tolist():
        lo, hi, at, j = float(sums[k]), float(sums[k + 1]), k, len(left) - 1
        while True:
            while j >= 0 and left[j] >= lo:
                j = lower[j]
            if j < 0 or right[j] >= hi:
                break
            lo, at, top, j = left[j], first[j], j, lower[j]
            del left[top:], right[top:], first[top:], lower[top:], last[top:]
        left.append(lo)
        right.append(hi)
        first.append(at)
        lower.append(j)
        last.append(k)
    return [(r - x, a, z) for x, r, a, z in zip(left, right, first, last, strict=True)]


def _looked_up(words: list[str], model: dict, memo: dict, missing) -> list:
    """For each word what the model has of its most specific known unit."""
    out = []
    for w in words:
        s = memo.get(w)
        if s is None:
            if len(memo) > 400_000:
                memo.clear()
            s = memo[w] = next((model[u] for u in _units(w) if u in model), missing)
        out.append(s)
    return out


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic): about ``rows`` labelled documents of each class, chosen by a hash of their id."""
    marked = labels.select(labels["doc_id"].alias("_of"), labels["toxic"].cast("int").alias("toxic")).where("toxic in (0, 1) and _of is not null").distinct()
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    chosen = [about(marked.where(F.col("toxic") == x), rows, sizes.get(x, 0), F.col("_of")) for x in (0, 1)]
    chosen = written(chosen[0].unionByName(chosen[1]), "toxic-labels")  # about twice ``rows`` rows at most
    slim = docs.select(docs["doc_id"].alias("_id"), docs["text"])
    return slim.join(F.broadcast(chosen), F.col("_id") == F.col("_of")).select("text", "toxic")


class Model:
    """Log-odds of units, the drift, and the calibration: lambda, ln K and three logistic weights."""

    def __init__(self, units: dict[str, float], drift=1.0, scale=1.0, offset=0.0, link=(-4.0, 1.0, 0.0)):
        self.units, self.drift, self.scale, self.offset, self.link = units, drift, scale, offset, link

    def segments(self, text: str | None, memo: dict) -> tuple[int, list[tuple[float, int, int]]]:
        """(words, segments) of a text."""
        words = _words(text)
        return len(words), _segments(np.array(_looked_up(words, self.units, memo, 0.0)) - self.drift) if words else []

    def features(self, n: int, segments: list[tuple[float, int, int]]) -> tuple[float, float]:
        """The best segment's calibrated score, and ln(1 + significant segments)."""
        if not segments:
            return -20.0, 0.0
        shift = self.offset + math.log(max(n, 1))
        s = [self.scale * x[0] - shift for x in segments]
        bound = -math.log(-math.log1p(-SIGNIFICANT))
        return min(max(max(s), -20.0), 40.0), math.log1p(sum(x > bound for x in s))

    def score(self, n: int, segments: list[tuple[float, int, int]]) -> float:
        a, b = self.features(n, segments)
        z = self.link[0] + self.link[1] * a + self.link[2] * b
        return 1 / (1 + math.exp(-min(max(z, -500), 500)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton's method from the base rate; the ridge keeps separable classes finite."""
    x = np.column_stack([np.ones(len(y)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _gumbel(best: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """lambda and ln K by the method of moments, over clean documents that have a segment."""
    clean = (toxic == 0) & (best > 0)
    if clean.sum() >= 30 and best[clean].std() > 0:
        scale = float(np.clip(math.pi / (best[clean].std() * math.sqrt(6)), 0.2, 2.0))
        return scale, float(scale * best[clean].mean() - 0.5772 - np.log(np.maximum(n[clean], 1)).mean())
    return 1.0, -math.log(max(1.0, float(n.mean())))  # log-odds in nats: lambda is 1 by definition


def _log_loss(a: np.ndarray, toxic: np.ndarray) -> float:
    w = _logistic(a[:, None], toxic)
    p = np.clip(1 / (1 + np.exp(-np.clip(w[0] + w[1] * a, -30, 30))), 1e-9, 1 - 1e-9)
    return float(-(toxic * np.log(p) + (1 - toxic) * np.log(1 - p)).mean())


class Counts:
    """Documents of each class that have a unit, by fold; the columns of bad and good are folds."""

    def __init__(self, units: list[str], bad: np.ndarray, good: np.ndarray, sizes: np.ndarray):
        self.units, self.bad, self.good, self.sizes = units, bad, good, sizes
        at = {u: i for i, u in enumerate(units)}
        above = lambda u: [u[:k] + " " for k in _PREFIXES if k < len(u) - 1] if u.endswith(" ") else _units(u)[1:]
        self.parent = np.array([next((at[p] for p in above(u) if p in at), -1) for u in units], np.int64)
        level = np.array([len(u) - 1 if u.endswith(" ") else 99 for u in units], np.int64)  # short prefixes first, words last
        self.levels = [np.flatnonzero(level == k) for k in (*sorted(_PREFIXES), 99)]

    def weights(self, prior: float, evidence: float, without: int | None = None) -> np.ndarray:
        """The log-odds of each unit from all folds but one; 0 for those without evidence."""
        folds = [f for f in range(self.bad.shape[1]) if f != without]
        bad, good, (n1, n0) = self.bad[:, folds].sum(1), self.good[:, folds].sum(1), self.sizes[:, folds].sum(1)
        if not n1 or not n0:
            return np.zeros(len(self.units), np.float32)
        base = n1 / (n0 + n1)
        term = lambda n, rate: np.where(n > 0, n * np.log(np.maximum(n, 1e-9) / np.maximum((bad + good) * rate, 1e-9)), 0.0)
        g, q, even = 2 * (term(bad, base) + term(good, 1 - base)), np.full(len(bad), 0.5), good * (n1 / n0)
        for rows in self.levels:
            p = self.parent[rows]
            above = np.where(p >= 0, q[p], 0.5)
            q[rows] = (bad[rows] + prior * above) / (bad[rows] + even[rows] + prior)
            g[rows] = np.maximum(g[rows], np.where(p >= 0, g[p], 0.0))
        return np.where(g >= evidence, np.log(q / (1 - q)), 0.0).astype(np.float32)


def _counts(sample: DataFrame, sizes: np.ndarray, units: int) -> Counts:
    """The units with the strongest evidence, ``units`` at most."""
    slots = 2 * FOLDS

    def count(batches):
        tally: Counter = Counter()
        for b in batches:
            for text, toxic, fold in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                # Documents, not occurrences: one that repeats a word is not more evidence.
                tally.update((u, 2 * fold + toxic) for u in {u for w in set(_words(text)) for u in _units(w)})
            if len(tally) > 300_000:
                yield out(tally)
                tally.clear()
        yield out(tally)

    def out(tally):
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in tally], pa.string()), pa.array([k for _, k in tally], pa.int32()), pa.array(tally.values(), pa.int64())], ["unit", "slot", "n"])

    each = sample.select("text", "toxic", "fold").mapInArrow(count, "unit string, slot int, n long")
    table = each.groupBy("unit").agg(*[F.sum(F.when(F.col("slot") == k, F.col("n")).otherwise(0)).cast("double").alias(f"n{k}") for k in range(slots)])
    bad, good = (sum((F.col(f"n{k}") for k in range(x + 2, slots, 2)), F.col(f"n{x}")) for x in (1, 0))
    base = float(sizes[0].sum() / sizes.sum())
    term = lambda n, rate: F.when(n > 0, n * F.log(n / ((bad + good) * rate))).otherwise(0.0)
    table = table.where(bad + good > 1).withColumn("g", 2 * (term(bad, base) + term(good, 1 - base))).where(F.col("g") >= min(EVIDENCES))
    rows = table.orderBy(F.desc("g"), "unit").limit(units).drop("g").toArrow()
    n = np.column_stack([rows.column(f"n{k}").to_numpy() for k in range(slots)]) if rows.num_rows else np.zeros((0, slots))
    return Counts(rows.column("unit").to_pylist(), n[:, 1::2], n[:, 0::2], sizes)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, units: int = UNITS) -> Model:
    """A model from the labelled documents among docs. Without labels of both classes, every score is
    below one half."""
    arrow_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    # Copies are one piece of evidence, and of one fold: else the words of a text that was copied often would pass for toxic.
    sample = _sample(docs, labels, rows).dropDuplicates(["text", "toxic"])
    sample = written(sample.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(FOLDS)).cast("int")), "toxic-sample")
    texts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if max(texts.values(), default=0) > 2 * rows:  # ids that many different texts share
        fewer = [about(sample.where(F.col("toxic") == x), rows, n, F.col("text")) for x, n in sorted(texts.items())]
        sample, all_of_them = written(reduce(DataFrame.unionByName, fewer), "toxic-sample"), sample
        discard(all_of_them)
    sizes = np.zeros((2, FOLDS))
    for r in sample.groupBy("toxic", "fold").count().collect():
        sizes[1 - r["toxic"], r["fold"]] = r["count"]
    if not sizes.sum(1).all():
        return Model({})
    counts = _counts(sample, sizes, units)
    tried = list(product(PRIORS, EVIDENCES))
    table = context.broadcast((counts.units, [np.array([counts.weights(p, e, f) for p, e in tried]) for f in range(FOLDS)]))

    def best(batches):
        names, weights = table.value
        index, memo = {u: i for i, u in enumerate(names)}, {}
        for b in batches:
            out = []
            for text, fold in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids = np.array(_looked_up(_words(text), index, memo, -1), np.int64)
                w = np.where(ids >= 0, weights[fold][:, ids], 0.0) if len(names) and len(ids) else np.zeros((len(tried), len(ids)))
                out.append([len(ids), *(max((x[0] for x in _segments(row - d)), default=0.0) for row in w for d in DRIFTS)])
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1:] for x in out], pa.list_(pa.float64()))], ["toxic", "fold", "n", "best"])

    seen = sample.select("text", "toxic", "fold").mapInArrow(best, "toxic int, fold int, n long, best array<double>").toArrow()  # numbers of the bounded sample
    toxic, n = seen.column("toxic").to_numpy(), seen.column("n").to_numpy()
    by = np.array(seen.column("best").to_pylist(), float)
    losses = []
    for k in range(by.shape[1]):
        scale, offset = _gumbel(by[:, k], n, toxic)
        losses.append(_log_loss(np.clip(np.where(by[:, k] > 0, scale * by[:, k] - offset - np.log(np.maximum(n, 1)), -20.0), -20.0, 40.0), toxic))
    k = int(np.argmin(losses))
    (prior, evidence), drift = tried[k // len(DRIFTS)], DRIFTS[k % len(DRIFTS)]
    scale, offset = _gumbel(by[:, k], n, toxic)

    def features(batches):
        names, weights = table.value
        models = [Model({u: float(x) for u, x in zip(names, w[k // len(DRIFTS)], strict=True)}, drift, scale, offset) for w in weights]
        memos: list[dict] = [{} for _ in models]
        for b in batches:
            out = [models[f].features(*models[f].segments(t, memos[f])) for t, f in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.float64())], ["toxic", "a", "b"])

    seen = sample.select("text", "toxic", "fold").mapInArrow(features, "toxic int, a double, b double").toArrow()
    link = _logistic(np.column_stack([seen.column("a").to_numpy(), seen.column("b").to_numpy()]), seen.column("toxic").to_numpy().astype(float))
    table.destroy()
    discard(sample)
    final = counts.weights(prior, evidence)
    return Model({u: float(w) for u, w in zip(counts.units, final, strict=True) if w}, drift, scale, offset, link)


def _scanned(docs: DataFrame, model: Model) -> DataFrame:
    """(_row, text, _score, _passages): _row has docs' other columns, so their names can't clash."""
    arrow_batches(docs.sparkSession)
    slim = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("_row"), docs["text"])
    passage = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("score", T.DoubleType())])
    schema = slim.select("_row", "text").schema.add("_score", "double").add("_passages", T.ArrayType(passage))
    arrow = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        memo: dict = {}
        for b in batches:
            scores, found = [], []
            for t in b.column(1).to_pylist():
                n, s = model.segments(t, memo)
                scores.append(model.score(n, s))
                found.append([{"first": a, "last": z, "score": x} for x, a, z in s if model.features(n, [(x, a, z)])[1] > 0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array(found, arrow)], names=["_row", "text", "_score", "_passages"])

    return slim.mapInArrow(run, schema)


def _columns(docs: DataFrame) -> list:
    return [F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns]


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages), a row for each row of docs: the significant segments as (first word, last
    word, score), in order. Null and empty texts have no words; they get the score of a text without hits."""
    return _scanned(docs, model).select(F.col("_row.doc_id").alias("doc_id"), F.col("_score").alias("score"), F.col("_passages").alias("passages"))


def clean(docs: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The rows of docs that score less, with their columns."""
    return _scanned(docs, model).where(F.col("_score") < below).select(*_columns(docs))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): a row for each row of docs; only the id and the text are read."""
    return passages(docs.select("doc_id", "text"), model).select("doc_id", "score")
