"""Exact top-k by inner product, with norm-bucketed retrieval.

Vectors are ordered by length, the longest first, and cut into segments of a few buckets. A query's score with a
bucket's vectors is at most the product of its own length and that of the bucket's longest one. So:

1. Every query meets the segment of the longest vectors; its k-th best score there is its first bound.
2. Queries are put into blocks by the length that a vector needs to reach their bound; a block meets those segments
   only whose longest vector has the length that its least demanding query needs.
3. In a bucket, bound / (length of the query * length of the longest vector) is the cosine that a vector needs. Low ones
   are left to length pruning: only the bucket's prefix of vectors that are long enough is multiplied. High ones go
   by coordinates: in the dimensions where the query is largest, a vector's coordinate has to lie in a narrow interval, read
   off sorted lists. From which cosine on coordinates serve better is measured on a few of the block's queries, bucket by bucket.
4. What is left is verified by its whole product, and bounds rise as better vectors are found.

Scores are integers, so bounds are held half a unit low and rounding loses nothing. A task holds a block of queries
and a segment of vectors; lists of k go to the merge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import join_small
from quillstone.operators.bounds import numbered
from quillstone.session import written

K = 20
SCALE = 64
#: Vectors of a segment and of a bucket, queries of a block: bounds on what a task holds.
SEGMENT = 8192
BUCKET = 1024
BLOCK = 2048
#: Dimensions whose lists are read, and queries on which a bucket's choice is measured.
FOCUS = 3
TRIED = 8
_LONG = (1 << 63) - 1


def scaled(vectors: DataFrame, asked: Column, scale: int = SCALE) -> DataFrame:
    """(vec_id, asked, v, width, norm): floor(scale * x) of every component, as doubles, which hold them exactly. Vectors that
    are null or hold null or non-finite components are left out."""

    def one(x):
        if x is None or any(v is None for v in x):
            return None
        v = np.floor(np.array(x, np.float64) * scale)
        return v if np.isfinite(v).all() else None

    def run(batches):
        for b in batches:
            out = [one(x) for x in b.column(2).to_pylist()]
            top = [max(np.abs(v).max(initial=0), 1) if v is not None else 1 for v in out]
            norm = [None if v is None else float(t * np.sqrt(((v / t) ** 2).sum())) for v, t in zip(out, top, strict=True)]
            width = [None if v is None else len(v) for v in out]
            fine = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.float64())), pa.array(width, pa.int32()), pa.array(norm, pa.float64())], ["vec_id", "asked", "v", "width", "norm"])
            yield fine.filter(pa.array([v is not None for v in out], pa.bool_()))

    slim = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), F.coalesce(asked, F.lit(False)).alias("asked"), vectors["embedding"].cast("array<double>").alias("embedding"))
    return slim.mapInArrow(run, "vec_id long, asked boolean, v array<double>, width int, norm double")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products of rows, as longs. Where doubles could round, Python's integers are used, and what no long holds stays at its ends."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < 1 << 53:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    exact = whole(q) @ whole(x).T if q.shape[1] else np.zeros((len(q), len(x)), object)
    return np.array([[max(-_LONG - 1, min(_LONG, v)) for v in row] for row in exact], np.int64).reshape(len(q), len(x))


class _Best:
    """The k best of each query of a block. ``low`` is what a score must reach, half a unit below the k-th best."""

    def __init__(self, k: int, low: np.ndarray, own: np.ndarray, ties: np.ndarray, places: np.ndarray) -> None:
        self.k, self.low, self.own, self.ties, self.places = k, low.copy(), own, ties, places
        self.at = [np.zeros(0, np.int64) for _ in low]
        self.score = [np.zeros(0, np.int64) for _ in low]

    def add(self, q: int, at: np.ndarray, score: np.ndarray) -> None:
        fine = (score >= self.low[q]) & (self.places[at] != self.own[q])
        if not fine.any():
            return
        at, score = np.concatenate([self.at[q], at[fine]]), np.concatenate([self.score[q], score[fine]])
        if len(at) > self.k:
            reach = score >= np.partition(score, -self.k)[-self.k]
            at, score = at[reach], score[reach]
            first = np.lexsort((self.places[at], self.ties[at], ~score))[: self.k]  # ~ turns the order, and no long overflows
            at, score = at[first], score[first]
        self.at[q], self.score[q] = at, score
        if len(at) == self.k:
            self.low[q] = max(self.low[q], _lower(float(score.min())))


def _lower(score: float) -> float:
    return score - max(0.5, abs(score) * 1e-12)


def _intervals(unit: np.ndarray, cosine: float, dims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between which values a unit vector's coordinates lie if its cosine with ``unit`` is at least that: two unit
    vectors an angle apart have angles to an axis that differ by as much at most."""
    angle, wide = np.arccos(np.clip(unit[dims], -1, 1)), np.arccos(np.clip(cosine, -1, 1))
    return np.cos(np.minimum(np.pi, angle + wide)) - 1e-9, np.cos(np.maximum(0, angle - wide)) + 1e-9


class _Bucket:
    """Vectors of about one length, with a sorted list of a dimension's coordinates once it is asked for."""

    def __init__(self, x: np.ndarray, norm: np.ndarray) -> None:
        self.x, self.norm = x, norm
        self.unit = x / np.where(norm > 0, norm, 1)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_length(self, length: float, low: float) -> int:
        """How many vectors are long enough."""
        return len(self.norm) if low <= 0 or length <= 0 else int(np.searchsorted(-self.norm, -low / length * (1 - 1e-12), "right"))

    def by_coordinates(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Rows whose coordinates are in all intervals: the shortest list is read, the others are looked up."""
        dims = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        lo, hi = _intervals(unit, cosine, dims)
        spans = []
        for f, a, b in zip(dims.tolist(), lo, hi, strict=True):
            if f not in self.lists:
                order = np.argsort(self.unit[:, f], kind="stable")
                self.lists[f] = order, self.unit[order, f]
            spans.append((np.searchsorted(self.lists[f][1], a, "left"), np.searchsorted(self.lists[f][1], b, "right")))
        short = min(range(len(spans)), key=lambda j: spans[j][1] - spans[j][0])
        rows = self.lists[int(dims[short])][0][spans[short][0] : spans[short][1]]
        near = self.unit[rows][:, dims]
        return rows[((near >= lo) & (near <= hi)).all(1)]


def _switch(bucket: _Bucket, unit: np.ndarray, length: np.ndarray, low: np.ndarray, cosine: np.ndarray, ask: np.ndarray) -> float:
    """The local cosine from which on coordinates leave less than a quarter of what length does, as measured on a few queries."""
    some = ask[np.argsort(-cosine[ask], kind="stable")]
    best = np.inf
    for q in some[np.unique(np.linspace(0, len(some) - 1, min(TRIED, len(some))).astype(int))].tolist():
        if cosine[q] <= 0 or 4 * len(bucket.by_coordinates(unit[q], cosine[q])) >= bucket.by_length(length[q], low[q]):
            break
        best = cosine[q]
    return best


def _meet(q: np.ndarray, q_norm: np.ndarray, x: np.ndarray, x_norm: np.ndarray, best: _Best, bucket: int = BUCKET) -> None:
    """Adds what a segment has for a block of queries. Rows of x go from long to short."""
    unit = q / np.where(q_norm > 0, q_norm, 1)[:, None]
    for at in range(0, len(x), bucket):
        b = _Bucket(x[at : at + bucket], x_norm[at : at + bucket])
        reach = q_norm * b.norm[0]
        ask = np.flatnonzero(reach * (1 + 1e-12) >= best.low)
        if not len(ask):
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(reach > 0, best.low / reach, -1.0) - 1e-9
        if q.shape[1]:
            switch = _switch(b, unit, q_norm, best.low, cosine, ask)
            for i in ask[cosine[ask] >= switch].tolist():
                rows = b.by_coordinates(unit[i], cosine[i])
                best.add(i, at + rows, _products(q[i : i + 1], b.x[rows])[0])
            ask = ask[cosine[ask] < switch]
        prefix = np.array([b.by_length(q_norm[i], best.low[i]) for i in ask.tolist()], np.int64)
        for lo in range(0, len(ask), 256):
            some, upto = ask[lo : lo + 256], prefix[lo : lo + 256]
            found = _products(q[some], b.x[: upto.max()])
            for i, n, s in zip(some.tolist(), upto.tolist(), found, strict=True):
                best.add(i, at + np.arange(n), s[:n])


def _lists(queries: DataFrame, vectors: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(query, query_id, vec_id, tie, place, score): the k best of each query in each segment that its block meets."""

    def run(key, left, right):
        if not len(left) or not len(right):
            return pa.table({"query": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "place": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        width = key[0].as_py()
        left = left.take(pa.array(np.argsort(left.column("place").to_numpy(), kind="stable")))
        right = right.take(pa.array(np.argsort(right.column("place").to_numpy(), kind="stable")))
        places, own = right.column("place").to_numpy(), left.column("place").to_numpy()
        best = _Best(k, left.column("low").to_numpy(), own, right.column("tie").to_numpy(), places)
        _meet(_matrix(left.column("v"), width), left.column("norm").to_numpy(), _matrix(right.column("v"), width), right.column("norm").to_numpy(), best)
        at = np.concatenate(best.at)
        of = np.repeat(np.arange(len(own)), [len(a) for a in best.at])
        return pa.table({"query": own[of], "query_id": left.column("vec_id").take(pa.array(of)), "vec_id": right.column("vec_id").take(pa.array(at)), "place": places[at], "score": np.concatenate(best.score)})

    asked = join_small(queries.alias("l"), pairs.select("width", "block", "segment").alias("r"), (F.col("l.width") == F.col("r.width")) & (F.col("l.block") == F.col("r.block")))
    asked = asked.select("l.width", "l.block", "r.segment", "l.vec_id", "l.place", "l.v", "l.norm", "l.low")
    met = join_small(vectors.alias("l"), pairs.select("width", "block", "segment").alias("r"), (F.col("l.width") == F.col("r.width")) & (F.col("l.segment") == F.col("r.segment")))
    met = met.select("l.width", "r.block", "l.segment", "l.vec_id", F.coalesce("l.vec_id", F.lit(_LONG)).alias("tie"), "l.place", "l.v", "l.norm")
    keys = ["width", "block", "segment"]
    return asked.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(run, "query long, query_id long, vec_id long, place long, score long")


def _first(lists: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "place")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, asked: Column, k: int = K, scale: int = SCALE, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest integer product for each row of which ``asked`` holds, ties to the
    smaller vec_id (null last); all, if there are fewer.

    Vectors that are null or hold null or non-finite components take no part. Vectors meet those of their own length
    only; empty ones meet each other, with a score of 0, and zero vectors score 0 with all. A row is left out of its own
    list only: rows that repeat a vec_id or a vector stand in each other's, and each asks for itself. A score that
    no long holds is given as the nearest long. An empty table, or nothing asked, gives no rows."""
    rows = written(scaled(vectors, asked, scale).withColumn("row", F.monotonically_increasing_id()), "scaled")
    placed = numbered(rows, [F.col("width"), F.col("norm").desc(), F.col("row")], "place").drop("row")
    placed = written(placed.withColumn("segment", F.floor(F.col("place") / segment).cast("long")), "by-length")
    segments = written(placed.groupBy("width", "segment").agg(F.max("norm").alias("top")), "segments")
    longest = segments.groupBy("width").agg(F.min("segment").alias("segment"))

    asking = placed.where("asked").select("vec_id", "place", "v", "width", "norm")
    queries = numbered(asking, [F.col("width"), F.col("place")], "nth").withColumn("block", F.floor(F.col("nth") / block).cast("long"))
    queries = written(queries.withColumn("low", F.lit(float("-inf"))).drop("nth"), "queries")
    blocks = queries.select("width", "block").distinct()
    pairs = written(join_small(blocks, longest.withColumnRenamed("width", "_width"), F.col("width") == F.col("_width")).drop("_width"), "pairs")
    first = written(_first(_lists(queries, placed, pairs, k), k), "first-lists")

    bound = first.where(F.col("rank") == k).select(F.col("query").alias("_query"), F.col("score").cast("double").alias("bound"))
    low = F.coalesce(F.col("bound") - F.greatest(F.lit(0.5), F.abs("bound") * 1e-12), F.lit(float("-inf")))
    bounded = written(queries.drop("low", "block").join(bound, F.col("place") == F.col("_query"), "left").withColumn("low", low).drop("_query", "bound"), "bounded")
    needs = F.when((F.col("norm") > 0) & (F.col("low") > 0), F.col("low") / F.col("norm") * (1 - 1e-12)).otherwise(0.0)
    again = numbered(bounded.withColumn("needs", needs), [F.col("width"), F.col("needs").desc(), F.col("place")], "nth")
    again = written(again.withColumn("block", F.floor(F.col("nth") / block).cast("long")).drop("nth"), "queries")
    least = again.groupBy("width", "block").agg(F.min("needs").alias("needs"))
    rest = segments.join(longest.select(F.col("width").alias("_width"), F.col("segment").alias("_segment")), (F.col("width") == F.col("_width")) & (F.col("segment") == F.col("_segment")), "left_anti")
    rest = rest.select(F.col("width").alias("_width"), "segment", "top")
    pairs = written(join_small(least, rest, (F.col("width") == F.col("_width")) & (F.col("top") >= F.col("needs"))).select("width", "block", "segment"), "pairs")
    more = _lists(again, placed, pairs, k)
    every = first.drop("rank").unionByName(more)
    return _first(every, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
