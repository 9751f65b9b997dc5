"""Merkle manifest of a dataset by higher-order SQL over blocks.

A document's leaf is a digest of its columns. Leaves of a source stand in order of their ids; every 16 consecutive
nodes become their digest, until one is left, the source's subroot. Subroots, in order of sources, give the root.

Leaves are numbered within their source by range partitions and prefix sums, and gathered into ordered arrays
of 256, so a source is as many rows as it has blocks. Two levels collapse inside an array: a sequence of runs is
transformed, each run a slice that an aggregate joins. Block roots are leaves of the next round, in a 256th of the
rows. On the way back each round hands its blocks what stands left and right of them on every level above, so a
document's proof and its recomputed root are folds over a path of a few entries; paths of documents are never stored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import join_small
from quillstone.operators.bounds import small
from quillstone.session import written

#: Nodes of a run, and levels that collapse within a block.
FAN = 16
LEVELS = 2
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
_PATH = "array<struct<left:string,right:string>>"


def leaf(*values: Column) -> Column:
    """Digest of columns: each is `-` if null, else its count of UTF-8 bytes, a colon, and its value as text."""
    sized = [F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")) for v in values]
    return F.sha2(F.concat(*[F.coalesce(v, F.lit("-")) for v in sized]).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def _same(keys: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def ordinals(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """A written table with its rows' place i among those of the same keys (from 0), and n, how many these are. Rows
    are dealt by ranges of keys and order, so a key of very many rows is split."""
    part = written(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = part.groupBy(*keys, "_part").agg(F.count("*").alias("_rows"))
    group = Window.partitionBy(*keys)  # a row for each range partition that has rows of the key
    before = counts.select(*keys, "_part", (F.sum("_rows").over(group.orderBy("_part")) - F.col("_rows")).alias("_before"), F.sum("_rows").over(group).alias("n"))
    nth = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    out = part.withColumn("_nth", nth).alias("l").join(small(before).alias("r"), _same([*keys, "_part"], "l", "r"))
    return out.select("l.*", "r._before", "r.n").withColumn("i", (F.col("_before") + F.col("_nth") - 1).cast("long")).drop("_part", "_before", "_nth")


def _joined(nodes: Column) -> Column:
    return F.aggregate(nodes, F.lit(""), lambda a, x: F.concat(a, x))


def _collapsed(nodes: Column) -> Column:
    """The level above: a digest of every run."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda r: F.sha2(_joined(F.slice(nodes, r * FAN + 1, FAN)).cast("binary"), 256))


def _blocks(nodes: DataFrame, keys: list[str], load: list[str]) -> DataFrame:
    """(keys, b, n, items, level1.., top): the nodes in ordered arrays, with the levels above them that the block holds.
    A level exists if the key has several nodes below it, so all blocks of a key rise as far."""
    item = F.struct("i", "node", *load)
    out = nodes.groupBy(*keys, F.floor(F.col("i") / FAN**LEVELS).cast("long").alias("b")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(item)).alias("items"))
    out, top = out.withColumn("level0", F.col("items.node")), F.col("level0")
    for k in range(LEVELS):
        out = out.withColumn(f"level{k + 1}", F.when(F.col("n") > FAN**k, _collapsed(F.col(f"level{k}"))))
        top = F.coalesce(F.col(f"level{k + 1}"), top)
    return out.withColumn("top", top[0]).drop("level0", f"level{LEVELS}")


def _path(place: Column) -> Column:
    """What stands left and right of a block's item on each of the block's levels."""
    steps = []
    for k in range(LEVELS):
        nodes = F.col("items.node") if k == 0 else F.col(f"level{k}")
        at = F.floor(place / FAN**k).cast("int")
        first = at - at % FAN
        steps.append(F.struct(_joined(F.slice(nodes, first + 1, at % FAN)).alias("left"), _joined(F.slice(nodes, at + 2, FAN - 1 - at % FAN)).alias("right")))
    levels = reduce(lambda a, b: a + b, [(F.col("n") > FAN**k).cast("int") for k in range(LEVELS)])
    return F.slice(F.array(*steps), F.lit(1), levels)


def climb(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, top, path): the root of every node's key, and the way up there. nodes: keys, i, n, node."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    if most <= 1:
        return nodes.select(*keys, "i", F.col("node").alias("top"), F.array().cast(_PATH).alias("path"))
    blocks = written(_blocks(nodes, keys, []), "blocks")
    above = climb(blocks.select(*keys, F.col("b").alias("i"), F.ceil(F.col("n") / FAN**LEVELS).alias("n"), F.col("top").alias("node")), keys)
    both = blocks.drop("top").alias("l").join(above.withColumnRenamed("i", "b").alias("r"), _same([*keys, "b"], "l", "r")).select("l.*", "r.top", "r.path")
    each = F.transform("items", lambda x, p: F.struct(x["i"].alias("i"), F.concat(_path(p), F.col("path")).alias("path")))
    return both.select(*keys, "top", F.inline(each)).select(*keys, "i", "top", "path")


def manifest(docs: DataFrame, changed: Column | None = None, columns: list[str] = COLUMNS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): a row for each row of docs.

    ``changed`` is the text as it is found when the manifest is checked, null where it is as it was; its document's
    leaf is made anew from it, and folded up the path of the original siblings. proof_sha256 is a digest of these.

    Sources may be null (first in order), and so may any column of a leaf. Ids that repeat stand in order of their
    leaves, null ids first; rows that repeat wholly have places of their own. A lone document is subroot
    and root, and its proof that of nothing. An empty table gives no rows. Other columns are not read."""
    other = leaf(*[F.coalesce(changed, docs["text"]) if c == "text" else docs[c] for c in columns]) if changed is not None else F.lit(None)
    found = F.when(changed.isNotNull(), other) if changed is not None else F.lit(None).cast("string")
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].alias("source"), leaf(*[docs[c] for c in columns]).alias("node"), found.alias("found"))
    leaves = written(slim.withColumn("row", F.monotonically_increasing_id()), "leaves")
    nodes = ordinals(leaves, ["source"], [F.col("doc_id"), F.col("node"), F.col("row")])
    blocks = written(_blocks(nodes, ["source"], ["doc_id", "found"]), "blocks")
    above = written(climb(blocks.select("source", F.col("b").alias("i"), F.ceil(F.col("n") / FAN**LEVELS).alias("n"), F.col("top").alias("node")), ["source"]), "subroots")
    subroots = above.where("i = 0").select(F.lit(0).alias("all"), "source", F.col("top").alias("node"))
    subroots = written(ordinals(subroots, ["all"], [F.col("source")]), "sources")
    roots = climb(subroots, ["all"]).select("i", F.col("top").alias("root"), F.col("path").alias("rest"))
    roots = subroots.select("source", "i").join(roots, "i").select("source", "root", "rest")
    above = join_small(above.alias("l"), roots.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select("l.source", F.col("l.i").alias("b"), F.col("l.top").alias("subroot"), "r.root", F.concat("l.path", "r.rest").alias("path"))
    both = blocks.drop("top").alias("l").join(above.alias("r"), _same(["source", "b"], "l", "r")).select("l.*", "r.subroot", "r.root", "r.path")

    def checked(x: Column, p: Column) -> Column:
        fold = F.aggregate(
            F.concat(_path(p), F.col("path")),
            F.struct(F.coalesce(x["found"], x["node"]).alias("up"), F.lit("").alias("proof")),
            lambda a, s: F.struct(F.sha2(F.concat(s["left"], a["up"], s["right"]).cast("binary"), 256).alias("up"), F.concat(a["proof"], s["left"], s["right"]).alias("proof")),
            lambda a: F.struct(a["up"].alias("folded_root"), F.sha2(a["proof"].cast("binary"), 256).alias("proof_sha256")),
        )
        return F.struct(x["doc_id"].alias("doc_id"), x["node"].alias("leaf"), fold.alias("fold"))

    out = both.select("subroot", "root", F.inline(F.transform("items", checked)))
    return out.select("doc_id", "leaf", "subroot", "root", "fold.proof_sha256", "fold.folded_root", (F.col("fold.folded_root") == F.col("root")).alias("verified"))
