"""Search and ranking: an inverted index, BM25, exact vector search, fusion, passages and token budgets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators.bounds import is_small, small
from quillstone.session import arrow_batches, discard, written

#: Asked terms up to which they are a filter, not a join.
PUSHED = 2_000


def _counted(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, term, f0, f1, ...): how often a term occurs in each field of a row. Repeats are counted before
    anything is shuffled."""
    tag = lambda i: lambda t: F.struct(t.alias("term"), F.lit(i).alias("field"))
    tagged = [F.transform(tx.terms(F.coalesce(F.col(f), F.lit(""))), tag(i)) for i, f in enumerate(fields)]
    each = rows.select(key, F.explode(F.concat(*tagged) if len(tagged) > 1 else tagged[0]).alias("t"))
    return each.groupBy(key, F.col("t.term").alias("term")).agg(*[F.count_if(F.col("t.field") == i).alias(f"f{i}") for i in range(len(fields))])


def postings(rows: DataFrame, key: str, fields: dict[str, float]) -> DataFrame:
    """(key, term, tf): how often a term occurs in a row's fields, weighted by field."""
    tf = sum((F.col(f"f{i}") * float(w) for i, w in enumerate(fields.values())), F.lit(0.0))
    return _counted(rows, key, list(fields)).select(key, "term", tf.alias("tf"))


@dataclass
class Index:
    """An index in the shared folder: a row for each key with its fields' lengths l0, l1, ... and its terms, each with how often
    it occurs in every field. single: every key was one row when it was indexed."""

    key: str
    fields: list[str]
    docs: DataFrame
    stats: dict[str, float]
    single: bool = True

    @property
    def postings(self) -> DataFrame:
        """(key, term, f0, ..., l0, ...). Those of a key follow one another."""
        sizes = [f"l{i}" for i in range(len(self.fields))]
        return self.docs.select(self.key, *sizes, F.explode("p").alias("p")).select(self.key, "p.*", *sizes)


def _indexed(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The rows of an index, each from its own row: nothing is shuffled."""
    kind, m = rows.schema[key].dataType.simpleString(), len(fields)
    slim = rows.select(key, *[tx.terms(F.coalesce(F.col(f), F.lit(""))).alias(f"t{i}") for i, f in enumerate(fields)])
    of = ", ".join(f"f{i}: long" for i in range(m))

    def run(batches):
        for b in batches:
            n = b.num_rows
            values = pa.concat_arrays([b.column(1 + i).flatten() for i in range(m)]).dictionary_encode()
            long = [np.diff(b.column(1 + i).offsets.to_numpy()) for i in range(m)]
            row = np.concatenate([np.repeat(np.arange(n), x) for x in long])
            field = np.repeat(np.arange(m), [int(x.sum()) for x in long])
            v = max(1, len(values.dictionary))
            found, place = np.unique(row * v + values.indices.to_numpy(), return_inverse=True)
            counts = [pa.array(np.bincount(place[field == i], minlength=len(found)), pa.int64()) for i in range(m)]
            terms = pa.StructArray.from_arrays([values.dictionary.take(pa.array(found % v)), *counts], ["term", *(f"f{i}" for i in range(m))])
            ends = pa.array(np.searchsorted(found // v, np.arange(n + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in long), pa.ListArray.from_arrays(ends, terms)], [key, *(f"l{i}" for i in range(m)), "p"])

    arrow_batches(rows.sparkSession)
    return slim.mapInArrow(run, f"{key} {kind}, {', '.join(f'l{i} long' for i in range(m))}, p array<struct<term: string, {of}>>")


def _merged(docs: DataFrame, key: str, m: int) -> DataFrame:
    """Rows that repeat a key have one list of terms, and each its own lengths."""
    each = docs.select(key, F.explode("p").alias("p")).groupBy(key, "p.term").agg(*[F.sum(f"p.f{i}").alias(f"f{i}") for i in range(m)])
    terms = each.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("term", *[f"f{i}" for i in range(m)])).alias("p"))
    return docs.drop("p").join(terms, F.col(key) == F.col("_key")).drop("_key")


def build_index(rows: DataFrame, key: str, fields: list[str]) -> Index:
    """Tokenizes rows once, for any number of searches, scopes and weights."""
    docs = written(_indexed(rows, key, fields), "index")
    single = docs.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).isEmpty()
    one = docs.agg(F.count("*").cast("double").alias("n"), *[F.coalesce(F.sum(f"l{i}"), F.lit(0)).cast("double").alias(f"l{i}") for i in range(len(fields))]).first()
    if not single:
        each, docs = docs, written(_merged(docs, key, len(fields)), "index")
        discard(each)
    return Index(key, fields, docs, one.asDict(), single)


def idf(n: Column, df: Column) -> Column:
    """ln((N - n + 0.5) / (n + 0.5)), at least a millionth."""
    x = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(x <= 0, F.lit(1e-6)).otherwise(x)


def asked_postings(index: Index, terms: DataFrame, fields: list[int] | None = None) -> DataFrame:
    """The index's rows for the distinct terms (term) asked, with a count in one of the fields."""
    hit = F.lit(False)
    for i in range(len(index.fields)) if fields is None else fields:
        hit = hit | (F.col(f"f{i}") > 0)
    found = index.postings.where(hit)
    few = [r["term"] for r in terms.limit(PUSHED + 1).collect()]  # bounded
    if len(few) <= PUSHED:
        return found.where(F.col("term").isin(few)) if few else found.where("false")
    return found.join(small(terms), "term", "left_semi")


def bm25(rows: DataFrame | Index, key: str, fields: dict[str, float], queries: DataFrame, k: int, scope: DataFrame | None = None, digits: int = 8) -> DataFrame:
    """(query_id, key, score, rank): the k best rows for each query (query_id, terms).

    rows: an Index, or rows to be indexed for this search. Corpus size and mean length cover all rows, also under a
    scope (key), which restricts before ranking. Ties go to the lesser key, after rounding.
    """
    index = rows if isinstance(rows, Index) else build_index(rows, key, list(fields))
    at = {f: index.fields.index(f) for f in fields}
    asked = queries.select("query_id", F.explode("terms").alias("term")).distinct()
    tf = sum((F.col(f"f{i}") * float(fields[f]) for f, i in at.items()), F.lit(0.0))
    size = sum((F.col(f"l{i}") for i in at.values()), F.lit(0))
    found = asked_postings(index, asked.select("term").distinct(), list(at.values()))
    df = written(found.groupBy("term").agg((F.count("*") if index.single else F.count_distinct(key)).alias("df")), "frequencies")  # no more rows than asked terms
    asked, same = _alike(asked.join(df.select("term"), "term", "left_semi"))
    few = is_small(asked)
    send = F.broadcast if few else (lambda x: x)
    if scope is not None:  # before postings are listed, so that a key's stay together
        inside = Index(key, index.fields, index.docs.join(small(scope.select(key).distinct()), key, "left_semi"), index.stats, index.single)
        found = asked_postings(inside, df.select("term"), list(at.values()))
    found = found.select(key, "term", tf.alias("tf"), size.alias("len"))
    n, mean = index.stats["n"], sum(index.stats[f"l{i}"] for i in at.values()) / max(1.0, index.stats["n"])
    weight = idf(F.lit(n), F.col("df")) * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.lit(mean)))
    part = found.join(send(df), "term").select(key, "term", weight.alias("w")).join(send(asked), "term").select("query_id", key, "w")
    if few and index.single and all(t == "bigint" for t in (x[1] for x in part.dtypes[:2])):
        part = part.mapInArrow(_best(key, k, digits), f"query_id long, {key} long, w double")  # broadcasts keep a key's rows together
    scored = part.groupBy("query_id", key).agg(F.round(F.sum("w"), digits).alias("score"))
    best = top(scored, ["query_id"], [F.desc("score"), F.asc(key)], k)
    return best.withColumnRenamed("query_id", "_first").join(small(same), "_first").select("query_id", key, "score", "rank")


def _alike(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked, same): of queries (query_id, term) that ask the same terms the first alone, and the first (_first) of each query.
    Terms that no row has are left out before, as they change nothing."""
    sets = written(asked.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms")), "asked-sets")
    first = written(sets.groupBy("terms").agg(F.min("query_id").alias("_first")), "alike")
    return first.select(F.col("_first").alias("query_id"), F.explode("terms").alias("term")), sets.join(small(first), "terms").select("_first", "query_id")


def _best(key: str, k: int, digits: int, rows: int = 200_000):
    """Sums w of (query_id, key, w), a key's rows in a row, and keeps the k best of a task for each query."""

    def summed(q, d, w):
        run = np.concatenate([[0], np.cumsum(d[1:] != d[:-1])])
        names, code = np.unique(q, return_inverse=True)
        pair, at = np.unique(run * len(names) + code, return_inverse=True)
        return names[pair % len(names)], d[np.searchsorted(run, pair // len(names))], np.bincount(at, weights=w)

    def cut(q, d, w):
        order = np.lexsort((d, -np.round(w, digits), q))
        q, d, w = q[order], d[order], w[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], d[keep], w[keep]

    def run(batches):
        best, held, count = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64)), [], 0

        def settle(last: bool):
            nonlocal best, held, count
            q, d, w = (np.concatenate(x) for x in zip(*held, strict=True))
            end = len(d) if last else int(np.flatnonzero(d != d[-1]).max(initial=-1)) + 1
            if end:
                best = cut(*(np.concatenate(x) for x in zip(best, summed(q[:end], d[:end], w[:end]), strict=True)))
            held, count = [(q[end:], d[end:], w[end:])], 0

        for b in batches:
            if b.num_rows:
                held.append(tuple(c.to_numpy() for c in b.columns))
                count += b.num_rows
                if count >= rows:
                    settle(False)
        if held:
            settle(True)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["query_id", key, "w"])

    return run


def containing(index: Index, texts: DataFrame, needles: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, key): rows of texts (key, text) that contain a needle (query_id, needle), found by the index.

    A term within a needle, first and last aside, stands in every text that contains it; the rarest is looked up,
    and the few rows that have it are read. Needles without such a term are compared with all texts."""
    inner = needles.select("query_id", "needle", F.array_distinct(F.slice(tx.terms(F.col("needle")), 2, F.greatest(F.size(tx.terms(F.col("needle"))) - 2, F.lit(0)))).alias("inner"))
    asked = inner.select("query_id", F.explode("inner").alias("term"))
    # Written, as each count of what may be broadcast would read the index again.
    found = written(asked_postings(index, asked.select("term").distinct()).select(index.key, "term"), "asked")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    rare = asked.join(small(df), "term").groupBy("query_id").agg(F.min(F.struct("df", "term")).alias("r")).select("query_id", "r.term")
    pairs = written(found.join(small(rare), "term").join(small(needles), "query_id").select(index.key, "query_id", "needle"), "pairs")
    near = texts.select(index.key, text).join(small(pairs), index.key)
    bare = inner.where(F.size("inner") == 0).select("query_id", "needle")
    out = near.where(F.contains(F.col(text), F.col("needle"))).select("query_id", index.key)
    if not bare.isEmpty():
        out = out.unionByName(texts.join(small(bare), F.contains(F.col(text), F.col("needle"))).select("query_id", index.key))
    return out


def top(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank from 1. Partitions drop all but k before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def _blocks(rows: DataFrame, key: str, vector: str, prefix: str, block: int) -> DataFrame:
    """(width, n, ids, flat): vectors of one length, up to ``block`` to a row. Built within partitions."""

    def run(batches):
        for b in batches:
            sizes = np.array([len(x) if x is not None else 0 for x in b.column(1)], np.int64)
            for w in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == w)
                for at in range(0, len(rows), block):
                    part = pa.array(rows[at : at + block])
                    yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([b.column(0).take(part).to_pylist()], pa.list_(pa.int64())), pa.array([b.column(1).take(part).flatten().to_pylist()], pa.list_(pa.float64()))], [f"{prefix}width", f"{prefix}ids", f"{prefix}flat"])

    slim = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and not exists(v, x -> x is null)")
    return slim.mapInArrow(run, f"{prefix}width int, {prefix}ids array<long>, {prefix}flat array<double>")


def dense(vectors: DataFrame, key: str, queries: DataFrame, k: int, digits: int = 6, block: int = 512) -> DataFrame:
    """(query_id, key, score, rank): exact inner products, k best for each query (query_id, vector).

    Blocks of queries meet blocks of vectors of their length, each pair one matrix product of which only the k best
    per query go on. Vectors are read once, whatever the queries; nothing comes to the driver. Vectors without an id,
    or with a null component, take no part.
    """
    asked = _blocks(queries, "query_id", "vector", "q_", block)
    held = _blocks(vectors, key, "embedding", "v_", block)
    pairs = held.join(small(asked, max(1, 20_000_000 // (block * 512))), F.col("q_width") == F.col("v_width")).select("q_ids", "q_flat", "v_ids", "v_flat")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, keys = (b.column(c)[i].values.to_numpy() for c in (0, 2))
                q, x = (b.column(c)[i].values.to_numpy().reshape(n, -1) for c, n in ((1, len(ids)), (3, len(keys))))
                s = np.round(x @ q.T, digits)
                order = np.lexsort((np.broadcast_to(keys[:, None], s.shape), -s), axis=0)[:k]
                cols, pick = np.repeat(np.arange(len(ids))[None, :], len(order), 0).ravel(), order.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(ids[cols]), pa.array(keys[pick]), pa.array(s[pick, cols] + 0.0)], ["query_id", key, "score"])

    out = pairs.mapInArrow(run, f"query_id long, {key} long, score double")
    return top(out, ["query_id"], [F.desc("score"), F.asc(key)], k)


def fuse(lists: DataFrame, key: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, list_id, key, rank from 1): the sum of
    1 / (k + rank); ties go to the first list, then the first rank in it."""
    seen = F.min(F.struct("list_id", "rank"))
    fused = lists.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 10).alias("score"), seen.alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first.list_id", "first.rank", key)
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).select("query_id", key, "score", "rank")


def interleave(a: DataFrame, b: DataFrame, by: list[str], k: int) -> DataFrame:
    """Rows of two rankings (by, ..., rank) in turn: a1, b1, a2, b2, ..., at most k of each group."""
    both = a.withColumn("source", F.lit(0)).unionByName(b.withColumn("source", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("rank", "source")).cast("long")
    return both.withColumn("place", place).where(F.col("place") <= k)


def overlap(query_terms: Column, text_terms: Column) -> Column:
    """The share of a query's distinct terms that a text has: the default scorer where no model is given."""
    q = F.array_distinct(query_terms)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, text_terms)) / F.size(q)).otherwise(0.0)


def sigmoid_if_needed(score: Column) -> Column:
    """Scores outside [0, 1] through a sigmoid, its argument held within 50."""
    return F.when((score < 0) | (score > 1), 1 / (1 + F.exp(-F.least(F.greatest(score, F.lit(-50.0)), F.lit(50.0))))).otherwise(score)


def rerank(candidates: DataFrame, scorer, schema: str) -> DataFrame:
    """candidates through a scorer of Arrow batches that the caller gives (a model's client, say)."""
    return candidates.mapInArrow(scorer, schema)


def budget_prefix(rows: DataFrame, by: list[str], order: list[Column], tokens: str, budget: int) -> DataFrame:
    """Rows in order while they fit the budget; the first always. Stops at the first that doesn't fit."""
    w = Window.partitionBy(*by).orderBy(*order)
    used = F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))
    taken = rows.withColumn("used", used.cast("long")).withColumn("_nth", F.row_number().over(w))
    return taken.where((F.col("used") <= budget) | (F.col("_nth") == 1)).drop("_nth")


def budget_skip(items: Column, budget: int) -> Column:
    """Of an ordered array of (key, tokens), the keys that fit one after the other: one that doesn't fit is
    skipped, and a later, smaller one may still fit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("kept"))
    fits = lambda s, x: s["used"] + x["tokens"] <= budget
    step = lambda s, x: F.struct(
        F.when(fits(s, x), s["used"] + x["tokens"]).otherwise(s["used"]).alias("used"),
        F.when(fits(s, x), F.concat(s["kept"], F.array(x["key"]))).otherwise(s["kept"]).alias("kept"),
    )
    return F.aggregate(items, start, step, lambda s: s["kept"])


def islands(rows: DataFrame, by: list[str], ordinal: str) -> DataFrame:
    """Adds island: rows of a group whose ordinals follow one another share it."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(ordinal))
    return rows.withColumn("island", F.col(ordinal) - nth)


def passages(rows: DataFrame, by: list[str], ordinal: str, text: str, overlap_chars: str | None = None) -> DataFrame:
    """Consecutive chunks as one passage (by, first, last, text); a chunk's leading overlap with the one
    before, given in characters, is left out."""
    marked = islands(rows, by, ordinal)
    w = Window.partitionBy(*by, "island").orderBy(ordinal)
    body = F.col(text)
    if overlap_chars:
        body = F.when(F.row_number().over(w) > 1, F.substring(F.col(text), F.col(overlap_chars) + 1, F.lit(2**31 - 1))).otherwise(body)
    parts = F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col("_body").alias("t"))))
    grouped = marked.withColumn("_body", body).groupBy(*by, "island").agg(F.min(ordinal).alias("first"), F.max(ordinal).alias("last"), parts.alias("_parts"))
    return grouped.select(*by, "first", "last", F.array_join(F.transform("_parts", lambda p: p["t"]), "\n").alias("text"))


def neighbours(hits: DataFrame, chunks: DataFrame, by: list[str], ordinal: str, window: int = 1) -> DataFrame:
    """Chunks within ``window`` ordinals of a hit in the same group: an equi-join on (group, ordinal), each
    hit fanned out to the ordinals that it asks for, so no range join."""
    asked = hits.select(*by, F.explode(F.sequence(F.col(ordinal) - window, F.col(ordinal) + window)).alias(ordinal)).distinct()
    return chunks.join(asked, [*by, ordinal], "left_semi")
