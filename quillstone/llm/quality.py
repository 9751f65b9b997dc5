"""Quality rules with thresholds that adapt to each language and source.

Every document's ratios go into mergeable quantile sketches: counts of logarithmic buckets, one sketch for
each language, source and ratio. Counts add up, so sketches merge exactly, in any order, and those of a
language's sources make up the language's. A quantile is known to within the bucket's width of 2 percent.
A sketch also adds up what its ratio counts (hits) and what it counts in (units). Groups with few documents use
the sketch of their language, and that of all documents, if the language has few. Documents then meet their group's
sketch in a join. No cutoff is fixed; a ratio is fine if

* it lies within SPREADS quartile distances of the median. A bucket's width is added to a distance, which is known to that
  only, and it is wider for documents shorter than the group's mean, by the root of the quotient, as short documents vary
  more; or
* for shares, its hits are within Bernstein's bound of those that the group's share promises for so many units:
  promised + s * sqrt(promised) + s^2 / 6, with s = SPREADS. This is for ratios that are zero in most documents, whose
  quartiles say nothing. The share is a trimmed one: of the lowest buckets that hold TRIM of the documents, so that
  junk does not vouch for itself.

All of it is DataFrame expressions. Windows are over a sketch's buckets, whose number is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import BLANK, join_small
from quillstone.session import written

#: Width of a bucket; documents that a group's own sketch needs; spreads from the median to a limit; documents
#: that make up a group's share.
GAMMA = 1.02
LEAST = 50
SPREADS = 6.0
TRIM = 0.9
#: The ratios: hits, units, hits a how many units, and whether it is a mean, of which too little is as bad as too much.
RATIOS = {"symbols": ("n_symbols", "word_chars", 1000, False), "same": ("n_same", "n_words", 1000, False), "lines": ("n_dup_lines", "n_lines", 1000, False), "length": ("word_chars", "n_words", 100, True)}
RUN = 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame) -> DataFrame:
    """(_row, _lang, _source, measures): _row has docs' columns, so their names can't clash; then _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words, _n_lines, _n_same (words
    equal to the one before) and _base_failed."""
    text = F.coalesce(docs["text"], F.lit(""))
    row = F.struct(*[docs[c] for c in docs.columns])
    solid = F.regexp_replace("_text", BLANK, "")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.transform(F.sequence(F.lit(0), F.size("_words") - RUN), lambda i: F.xxhash64(F.slice("_words", i + 1, RUN)))
    a = docs.select(row.alias("_row"), text.alias("_text"))
    a = a.withColumn("_words", F.array_remove(F.split("_text", BLANK), "")).withColumn("_lines", lines)
    a = a.withColumn("_hashes", F.when(F.size("_words") >= RUN, windows).otherwise(F.array().cast("array<bigint>")))
    a = a.withColumn("_repeats", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    a = a.withColumn("_pairs", F.when(F.col("_repeats"), F.sort_array(F.transform("_hashes", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda k, j: F.coalesce(F.get("_pairs", k)["h"] == F.get("_pairs", j)["h"], F.lit(False))
    at = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size("_pairs") - 1), lambda k: same(k, k - 1) | same(k, k + 1)), lambda k: F.get("_pairs", k)["i"]))
    a = a.withColumn("_at", F.when(F.col("_repeats"), at))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("n"), F.lit(-RUN).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(RUN), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    equal = F.size(F.filter(F.sequence(F.lit(1), F.size("_words") - 1), lambda i: F.get("_words", i) == F.get("_words", i - 1)))
    a = a.select(
        "_row",
        F.size("_words").cast("long").alias("_n_words"),
        F.length(solid).cast("long").alias("_word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("_n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("_n_repeat_words"),
        F.size("_lines").cast("long").alias("_n_lines"),
        F.when(F.size("_words") > 1, equal).otherwise(0).cast("long").alias("_n_same"),
    )
    failed = (F.col("_n_words") < 20) | (100 * F.col("_n_repeat_words") > 30 * F.col("_n_words"))
    return a.select("_row", F.col("_row.lang").alias("_lang"), F.col("_row.source").alias("_source"), *a.columns[1:], failed.alias("_base_failed"))


def _ratios() -> dict[str, Column]:
    """Whole numbers, so that all engines put them into the same buckets."""
    return {k: F.floor(F.col("_" + hits) * times / F.greatest(F.col("_" + units), F.lit(1))) for k, (hits, units, times, _) in RATIOS.items()}


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n, hits, units) of the documents that the base rules pass; bucket -1 holds zeros."""
    values = _ratios()
    part = lambda k, hits, units: F.struct(F.lit(k).alias("ratio"), values[k].alias("value"), F.col("_" + hits).cast("long").alias("hits"), F.col("_" + units).cast("long").alias("units"))
    pairs = F.array(*[part(k, hits, units) for k, (hits, units, *_) in RATIOS.items()])
    each = measured.where(~F.col("_base_failed")).select(F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.explode(pairs).alias("_p")).select("lang", "source", "_p.*")
    bucket = F.when(F.col("value") > 0, F.floor(F.log(F.col("value").cast("double")) / F.log(F.lit(GAMMA)))).otherwise(-1)
    return each.groupBy("lang", "source", "ratio", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("hits").alias("hits"), F.sum("units").alias("units"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ratio, docs, q25, q50, q75, total, hits, units) of sketches merged by keys: total is all units; hits and units
    are of the lowest buckets, up to the one that reaches TRIM of the documents."""
    merged = sketch.groupBy(*keys, "ratio", "bucket").agg(*[F.sum(c).alias(c) for c in ("n", "hits", "units")])
    group = Window.partitionBy(*keys, "ratio")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.withColumn("_upto", upto).withColumn("_all", F.sum("n").over(group))
    value = F.when(F.col("bucket") >= 0, F.pow(F.lit(GAMMA), F.col("bucket") + 0.5)).otherwise(0.0)
    at = lambda q: F.min(F.when(F.col("_upto") >= q * F.col("_all"), value))
    return ranked.groupBy(*keys, "ratio").agg(F.max("_all").alias("docs"), at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"), F.sum("units").alias("total"), *[F.sum(F.when(F.col("_upto") - F.col("n") < TRIM * F.col("_all"), F.col(c))).alias(c) for c in ("hits", "units")])


def limits(sketch: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, and for each ratio mid_*, up_*, down_*, hits_*, units_*, mean_*): a row for each language and source of
    the sketch. up and down are quartile distances, mean the units of a document."""
    whole, lang, own = (quantiles(sketch, k) for k in ([], ["lang"], ["lang", "source"]))
    rename = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in df.columns])
    found = own.join(rename(lang, "l_"), F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("ratio") == F.col("l_ratio")))
    found = found.join(rename(whole, "w_"), F.col("ratio") == F.col("w_ratio"))
    pick = lambda q: F.when(F.col("docs") >= least, F.col(q)).when(F.col("l_docs") >= least, F.col("l_" + q)).otherwise(F.col("w_" + q))
    found = found.select("lang", "source", "ratio", *[pick(q).alias(q) for q in ("docs", "q25", "q50", "q75", "total", "hits", "units")])
    width = F.lit(GAMMA - 1) * F.col("q50")
    parts = {
        "mid": F.col("q50"),
        "up": F.col("q75") - F.col("q50") + width,
        "down": F.col("q50") - F.col("q25") + width,
        "hits": F.col("hits").cast("double"),
        "units": F.greatest("units", F.lit(1)).cast("double"),
        "mean": F.col("total").cast("double") / F.col("docs").cast("double"),
    }
    return found.groupBy("lang", "source").agg(*[F.max(F.when(F.col("ratio") == k, v)).alias(f"{name}_{k}") for k in RATIOS for name, v in parts.items()])


def _fine(k: str, value: Column, spreads: float) -> Column:
    """Whether a document's ratio is within its group's limits."""
    hits, units, _, mean = RATIOS[k]
    own = F.greatest(F.col("_" + units), F.lit(1)).cast("double")
    reach = F.lit(spreads) * F.greatest(F.lit(1.0), F.sqrt(F.col(f"mean_{k}") / own))
    high = value <= F.col(f"mid_{k}") + reach * F.col(f"up_{k}")
    if mean:
        return high & (value >= F.col(f"mid_{k}") - reach * F.col(f"down_{k}"))
    promised = F.col(f"hits_{k}") * own / F.col(f"units_{k}")
    return high | (F.col("_" + hits) <= promised + F.lit(spreads) * F.sqrt(promised) + F.lit(spreads * spreads / 6))


def _judge(measured: DataFrame, table: DataFrame, spreads: float) -> DataFrame:
    """measured with _kept. A document whose group has no limits has failed the base rules."""
    other = table.withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    out = join_small(measured, other, F.col("_lang").eqNullSafe(F.col("t_lang")) & F.col("_source").eqNullSafe(F.col("t_source")), "left")
    fine = F.lit(True)
    for k, v in _ratios().items():
        fine = fine & _fine(k, v, spreads)
    return out.withColumn("_kept", ~F.col("_base_failed") & F.coalesce(fine, F.lit(False)))


def verdicts(docs: DataFrame, least: int = LEAST, spreads: float = SPREADS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept): a row for
    each row of docs. Null and empty texts have no words, and fail. Null languages and sources are values
    like others. Repeated rows count each. Two different runs of words share a 64-bit hash within one text
    with a chance of about n^2 / 10^19."""
    measured = measure(docs.select("doc_id", "lang", "source", "text"))
    measured = written(measured.withColumn("_row", F.struct("_row.doc_id")), "measures")
    table = written(limits(sketches(measured), least), "limits")
    return _judge(measured, table, spreads).select("_row.doc_id", *[F.col("_" + c).alias(c) for c in BASE], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep(docs: DataFrame, least: int = LEAST, spreads: float = SPREADS) -> DataFrame:
    """The rows of docs that are kept, with their columns. Rows are written once with their measures, so that
    nothing is measured twice."""
    measured = written(measure(docs), "measures")
    table = written(limits(sketches(measured), least), "limits")
    return _judge(measured, table, spreads).where("_kept").select("_row.*")
