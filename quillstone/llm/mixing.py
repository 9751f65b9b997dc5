"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Every source gets a target in tokens: its weight's share of all tokens, at most ``max_epochs`` times
   its own size; what is above that is shared again by weight (water-filling, in closed form).
2. The mix is cut into equal blocks. Blocks go to sources by the highest quotients amount / (2k - 1).
3. Each source's documents fall into seeded shards of bounded size, about as many to a group as a source has
   groups. The source's blocks go to its groups, and a group's to its shards, by the same rule: integer quotas
   per shard.
4. A shard's documents stand in seeded order on a ring of tokens; the shard takes its quota of blocks
   from a seeded block onwards, round the ring as often as the quota asks for.

All of it is DataFrame expressions. Windows are over a shard's documents, over a group's shards, over a source's
groups, and over sources; never over a source's documents. With sources of 10^13 words, there are 12,000 groups of as
many shards; sources are taken to be few enough to be sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import join_small, md5_long, n_words
from quillstone.session import written


def by_rank(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, to the sources by code point, null last."""
    at = F.row_number().over(Window.orderBy(F.col("_s").isNull(), "_s"))
    return sources.withColumn("_rank", at.cast("long")).withColumn("_w", ((F.col("_rank") - 1) % 3 + 1).cast("double"))


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Adds _target: the total of _size shared by weight _w, at most max_epochs * _size each."""
    cap, w = F.col("_size") * float(max_epochs), F.col("_w")
    order = Window.orderBy("_full", "_rank")
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("_total") - F.col("_before")) / F.col("_rest")
    return (
        sources.withColumn("_full", cap / w)
        .withColumn("_total", F.sum("_size").over(whole).cast("double"))
        .withColumn("_before", F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum(w).over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", F.when(level <= F.col("_full"), level))
        .withColumn("_target", F.least(cap, w * F.coalesce(F.max("_level").over(whole), F.max("_full").over(whole))))
        .drop("_full", "_total", "_before", "_rest", "_level")
    )


def sainte_lague(items: DataFrame, amount: str, blocks: str, key: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``out``: how many of ``blocks`` each item gets by the highest quotients amount / (2k - 1);
    ties go to the lesser key. ``blocks`` is the same in all rows of a group.

    No list of all quotients is made: with S items, all quotients above that of the divisor of
    blocks - S/2 are certain to win, and none beyond that of blocks + S/2 can, so about 3 S remain.
    """
    group = Window.partitionBy(*by)
    a, n = F.col(amount).cast("double"), F.col(blocks).cast("double")
    total, half = F.col("_sum"), F.col("_items") / 2.0
    rank = Window.partitionBy(*by).orderBy(F.col("_quotient").desc(), F.col(key))
    share = lambda of: F.when(total > 0, F.floor(a * F.greatest(of, F.lit(0.0)) / total + 0.5)).otherwise(0)
    ready = (
        items.withColumn("_sum", F.sum(a).over(group))
        .withColumn("_items", F.count(F.lit(1)).over(group))
        .withColumn("_base", F.when(n > half, share(n - half)).otherwise(0).cast("long"))
        .withColumn("_top", share(n + half).cast("long") + 1)
        .withColumn("_left", F.col(blocks) - F.sum("_base").over(group))
    )
    tried = ready.withColumn("_k", F.explode(F.sequence(F.col("_base") + 1, F.greatest(F.col("_top"), F.col("_base") + 1))))
    won = tried.withColumn("_quotient", a / (2 * F.col("_k") - 1)).withColumn("_won", (F.row_number().over(rank) <= F.col("_left")) & (a > 0))
    kept = items.columns
    return won.groupBy(*kept, "_base").agg(F.sum(F.col("_won").cast("long")).alias("_more")).select(*kept, (F.col("_base") + F.col("_more")).alias(out))


def _plan(docs: DataFrame, slim: DataFrame, weigh, max_epochs: int, block_tokens: int, shard_tokens: int, seed: str) -> DataFrame:
    """docs (_id, _s, _n, more columns) with _size, _target, _at (its first token on its shard's ring of
    _len tokens), _epochs, _off and _rem: the ring is taken _epochs times, and _rem tokens from _off on."""
    sources = water_fill(weigh(slim.groupBy("_s").agg(F.sum("_n").alias("_size"))), max_epochs)
    whole = Window.partitionBy()
    least = F.min(F.when(F.col("_target") >= 1, F.col("_target"))).over(whole)
    # Blocks are small enough that rounding to whole ones is small against the smallest target.
    block = F.greatest(F.lit(1), F.least(F.lit(block_tokens), F.floor(F.coalesce(least, F.lit(1.0)) / 32))).cast("long")
    sources = sources.withColumn("_block", block).withColumn("_all", F.round(F.sum("_target").over(whole) / F.col("_block")).cast("long"))
    sources = sainte_lague(sources, "_target", "_all", "_rank", "_quota")
    shards = F.greatest(F.lit(1), F.ceil(F.col("_size") / shard_tokens)).cast("long")
    groups = F.ceil(F.sqrt(shards.cast("double"))).cast("long")
    sources = sources.withColumn("_groups", groups).withColumn("_shards", F.ceil(shards / F.col("_groups")).cast("long"))
    sources = written(sources, "mix-sources")

    def placed(df: DataFrame) -> DataFrame:
        of = sources.select(F.col("_s").alias("_of"), "_rank", "_groups", "_shards")
        out = join_small(df, of, F.col("_s").eqNullSafe(F.col("_of"))).drop("_of").withColumn("_h", md5_long(F.lit(seed), F.col("_id"), F.col("_text_hash")))
        return out.withColumn("_group", F.col("_h") % F.col("_groups")).withColumn("_shard", F.expr("_h div _groups") % F.col("_shards"))

    lens = written(placed(slim).groupBy("_rank", "_group", "_shard").agg(F.sum("_n").alias("_len")), "mix-shards")
    parts = lens.groupBy("_rank", "_group").agg(F.sum("_len").alias("_words"))
    parts = join_small(parts, sources.select(F.col("_rank").alias("_r"), "_quota", "_block", "_size", "_target"), F.col("_rank") == F.col("_r")).drop("_r")
    parts = sainte_lague(parts, "_words", "_quota", "_group", "_share", by=("_rank",)).select(F.col("_rank").alias("_r"), F.col("_group").alias("_g"), "_share", "_block", "_size", "_target")
    lens = join_small(lens, written(parts, "mix-groups"), (F.col("_rank") == F.col("_r")) & (F.col("_group") == F.col("_g"))).drop("_r", "_g")
    lens = sainte_lague(lens, "_len", "_share", "_shard", "_q", by=("_rank", "_group")).drop("_share")
    length, tokens = F.col("_len"), F.least(F.col("_q") * F.col("_block"), F.col("_len") * max_epochs)
    first = F.when(length > 0, md5_long(F.lit(seed), F.lit("first"), F.col("_rank"), F.col("_group"), F.col("_shard")) % F.ceil(length / F.col("_block"))).otherwise(0)
    lens = (
        lens.withColumn("_epochs", F.when(length > 0, F.floor(tokens / length)).otherwise(0).cast("long"))
        .withColumn("_rem", tokens - F.col("_epochs") * length)
        .withColumn("_off", (first * F.col("_block")).cast("long"))
        .select("_rank", "_group", "_shard", "_len", "_epochs", "_rem", "_off", "_size", "_target")
    )
    ring = Window.partitionBy("_rank", "_group", "_shard").orderBy("_h", "_id", "_n", "_text_hash").rowsBetween(Window.unboundedPreceding, 0)
    return placed(docs).join(lens, ["_rank", "_group", "_shard"]).withColumn("_at", F.sum("_n").over(ring) - F.col("_n"))


def _cuts() -> tuple[Column, Column, Column, Column]:
    """The two stretches of a document's words that the last, incomplete round takes: from, to, from, to."""
    at, n, off, end = F.col("_at"), F.col("_n"), F.col("_off"), F.col("_off") + F.col("_rem")
    clip = lambda x: F.least(n, F.greatest(F.lit(0), x))
    return clip(off - at), clip(F.least(end, F.col("_len")) - at), F.lit(0).cast("long"), clip(end - F.col("_len") - at)


def _slim(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(docs["doc_id"].alias("_id"), docs["source"].alias("_s"), n_words(docs["text"]).alias("_n"), F.md5(docs["text"].cast("binary")).alias("_text_hash"), *more)


SETTINGS = {"weigh": by_rank, "max_epochs": 3, "block_tokens": 64, "shard_tokens": 65_536, "seed": "mix"}


def quotas(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken), a row for each row of docs.

    size: words (null text: 0). target: of its source. taken: words the mix takes, repeats counted; never
    over max_epochs times its size; reruns agree. Sources are taken as they are, null one of them. A
    document without words, and any in a source without words, has taken 0. Repeated rows each count.
    An empty table gives an empty result.
    """
    slim = written(_slim(docs), "mix-sizes")
    a, b, c, d = _cuts()
    taken = F.col("_epochs") * F.col("_n") + F.greatest(F.lit(0), b - a) + (d - c)
    return _plan(slim, slim, **SETTINGS | settings).select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("size"), F.col("_s").alias("source"), F.col("_size").alias("source_size"),
        F.col("_target").alias("target"), taken.cast("long").alias("taken"),
    )


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed documents, with the columns of docs: a row for every time a document is taken whole, and
    a row with a part of its text where a shard's run of blocks begins or ends in it. Documents that the
    mix does not take, and those without words, are left out.
    """
    row = F.struct(*[docs[c] for c in docs.columns])
    planned = _plan(_slim(docs, row.alias("_row")), _slim(docs), **SETTINGS | settings)
    a, b, c, d = _cuts()
    piece = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    pieces = F.concat(F.array_repeat(piece(F.lit(0), F.col("_n")), F.col("_epochs").cast("int")), F.array(piece(a, b), piece(c, d)))
    out = planned.withColumn("_piece", F.explode(F.filter(pieces, lambda p: p["y"] > p["x"])))
    words = F.regexp_extract_all(F.col("_row.text"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    part = F.array_join(F.slice(words, (F.col("_piece.x") + 1).cast("int"), (F.col("_piece.y") - F.col("_piece.x")).cast("int")), "")
    text = F.when((F.col("_piece.x") == 0) & (F.col("_piece.y") == F.col("_n")), F.col("_row.text")).otherwise(part)
    return out.select(*[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])
