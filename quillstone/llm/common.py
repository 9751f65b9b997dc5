"""What several operators share: words, row keys, size-checked joins and connected components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.session import discard, written

#: A word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text; none in a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(doc_id: Column, text: Column) -> Column:
    """One long for a document: rows with the same id and the same text share it."""
    return F.xxhash64(doc_id, text)


def md5_long(*parts: Column) -> Column:
    """60 bits of an MD5 as a long: a seeded hash that other SQL engines have as well."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def about(df: DataFrame, want: int, total: int, *key: Column) -> DataFrame:
    """About ``want`` of ``total`` rows, chosen by a hash of their key; all, if there are no more. Each
    partition decides for itself, so what comes together is bounded, whatever the number of partitions."""
    if total <= want:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("about"), *key), F.lit(1 << 30)) < F.lit(math.ceil(want / total * (1 << 30))))


def join_small(left: DataFrame, small: DataFrame, on: Column, how: str = "inner", rows: int = 200_000) -> DataFrame:
    """Join with a table that is expected to be small: broadcast only after counting its rows, else a
    shuffled join, in which adaptive execution splits hot keys."""
    return left.join(F.broadcast(small) if small.count() <= rows else small.hint("merge"), on, how)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as columns a, b: component is the least node that
    can be reached. Nodes that are the least of theirs, or have no edge, aren't listed.

    Alternates large-star and small-star steps, each a grouped minimum and a join; every round is a
    written table, so neither lineage nor the driver grows with the graph. Of a graph of few edges, as counted,
    minima are broadcast. Otherwise they are written before they are joined, so that the join is of two plain
    shuffles, and a node of very many edges can be split.
    """
    a, b = F.col("a"), F.col("b")
    e = written(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    n, last = e.count(), None
    for _ in range(most):
        used, few = [e], n <= 100_000

        def table(df: DataFrame, few=few, used=used) -> DataFrame:
            if few:
                return df
            used.append(written(df, "minima"))
            return used[-1]

        hint = F.broadcast if few else (lambda x: x.hint("merge"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = table(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")))
        large = table(both.join(hint(low), F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = table(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u"))
        small = large.join(hint(low), F.col("u") == F.col("_u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(low.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        for x in used:
            discard(x)
        e, now = new, new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        n = now[0]
        if now == last or not n:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def least_of_group(nodes: DataFrame, first: str, name: str) -> DataFrame:
    """nodes (root, first, ...) with the least ``first`` of each root as ``name``. Both sides of the join are
    tables, so one group that holds most nodes can be split."""
    nodes = written(nodes, "nodes")
    least = written(nodes.groupBy("root").agg(F.min(first).alias(name)).withColumnRenamed("root", "_root"), "least")
    return join_small(nodes, least, F.col("root") == F.col("_root")).drop("_root")
