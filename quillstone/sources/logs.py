"""Delimited logs that grow by appended files, in a current layout and older ones."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.bounds import small

#: Bytes of a file that is read, and what a replaced file's copy is called. Fixed values of the format.
MOST = 20_000_000
BACKUP = ".yedek"
SEPARATOR = ";"
# The current columns and those of the older layout, of which the written tokens are the total now.
COLUMNS = ["zaman", "kullanici", "bilgisayar", "soru", "sonuc", "dogrulama", "sure_sn", "toplam_token", "model_cagrisi", "token_tahmini", "model"]
OLD_COLUMNS = ["zaman", "kullanici", "bilgisayar", "soru", "sonuc", "dogrulama", "sure_sn", "istem_token", "uretilen_token", "dusunme_token", "toplam_token", "model_cagrisi", "token_tahmini", "model"]


@dataclass(frozen=True)
class Layout:
    """Columns of a header line, and how columns of the current layout follow from them where the names aren't enough."""

    columns: tuple[str, ...]
    made: dict[str, Column] = field(default_factory=dict)


def usage_layouts() -> list[Layout]:
    """The current layout first."""
    tokens = F.coalesce(F.col("uretilen_token").try_cast("long"), F.col("toplam_token").try_cast("long"), F.lit(0)).cast("string")
    return [Layout(tuple(COLUMNS)), Layout(tuple(OLD_COLUMNS), {"toplam_token": tokens})]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("pathGlobFilter", "*.csv").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    return raw.withColumn("value", F.regexp_replace("value", "^﻿|\r$", ""))


def _headed(lines: DataFrame, layouts: list[Layout]) -> DataFrame:
    """(file, layout): which layout's header a file has; a file with several headers goes by the older one."""
    head = reduce(lambda a, k: a.when(F.replace("value", F.lit('"'), F.lit("")) == SEPARATOR.join(layouts[k].columns), k), range(1, len(layouts)), F.when(F.replace("value", F.lit('"'), F.lit("")) == SEPARATOR.join(layouts[0].columns), 0))
    return lines.select("file", head.alias("layout")).where("layout is not null").groupBy("file").agg(F.max("layout").alias("layout"))


def read(spark: SparkSession, path: str, layouts: list[Layout], most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(rows in the current layout, with file and layout; problems: file, problem, lines).

    A file's layout is that of its header line, wherever Spark splits the file. Larger files than ``most`` bytes, files
    without a known header, and lines that hold no text or not as many cells as the header are problems, not rows: too_large,
    unknown_layout, not_text, torn. A line is a row; cells may be quoted. Empty lines and repeated headers count as nothing."""
    lines = _lines(spark, path)
    fine = lines.where((F.col("size") <= most) & (F.trim("value") != ""))
    known = fine.join(small(_headed(fine, layouts)), "file", "left")
    parts, torn = [], []
    for k, layout in enumerate(layouts):
        schema = ", ".join(f"{c} STRING" for c in layout.columns) + ", _torn STRING"
        own = known.where((F.col("layout") == k) & (F.replace("value", F.lit('"'), F.lit("")) != SEPARATOR.join(layout.columns)))
        cells = own.select("file", "layout", "value", F.from_csv("value", schema, {"sep": SEPARATOR, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn", "escape": '"'}).alias("_c"))
        broken = F.col("_c._torn").isNotNull() | F.contains("value", F.lit("�"))
        parts.append(cells.where(~broken).select("file", "layout", "_c.*").select("file", "layout", *[layout.made.get(c, F.col(c) if c in layout.columns else F.lit(None).cast("string")).alias(c) for c in layouts[0].columns]))
        torn.append(cells.where(broken).select("file", F.when(F.contains("value", F.lit("�")), "not_text").otherwise("torn").alias("problem")))
    odd = lines.where(F.col("size") > most).select("file", F.lit("too_large").alias("problem")).unionByName(known.where("layout is null").select("file", F.lit("unknown_layout").alias("problem")))
    problems = reduce(DataFrame.unionByName, torn, odd).groupBy("file", "problem").agg(F.count("*").alias("lines"))
    return reduce(DataFrame.unionByName, parts), problems


def append(rows: DataFrame, path: str, layout: Layout, most: int = MOST) -> None:
    """Adds rows as new files in a layout, each with its header. What is there stays as it is; a write that fails leaves nothing behind.
    Files take as many rows as fit ``most`` bytes even if all were as long as the longest, so that readers pass over none."""
    slim = rows.select(*layout.columns)
    widest = sum((F.coalesce(F.octet_length(F.col(c).cast("string")) * 2, F.lit(0)) + 3 for c in layout.columns), F.lit(1))  # every character a quote
    longest = slim.agg(F.max(widest)).first()[0] or 1
    room = most - len(SEPARATOR.join(layout.columns)) - 1
    slim.write.mode("append").option("maxRecordsPerFile", max(1, room // longest)).option("sep", SEPARATOR).option("header", True).option("escape", '"').csv(path)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration())


def upgrade(spark: SparkSession, path: str, layouts: list[Layout]) -> int:
    """Brings files of older layouts to the current one, and returns how many. Their rows are written to a folder that readers
    pass over; then each file is renamed to a copy (an earlier copy is never overwritten), and what was written takes
    its place. Files of which a line can't be read stay as they are, until somebody mends them. An upgrade that breaks off before
    the first copy changes nothing, and begins anew; one that breaks off later leaves the rows of files already renamed in its
    folder and in their copies only, where no reader looks: rename the copies back, and upgrade again."""
    rows, problems = read(spark, path, layouts)
    old = rows.where("layout > 0").select("file").distinct().join(problems.select("file").distinct(), "file", "left_anti")
    names = [r.file for r in old.collect()]  # files of an older layout: no more than there were writers
    if not names:
        return 0
    folder = f"{path.rstrip('/')}/_upgraded-{uuid.uuid4().hex}"
    append(rows.join(small(spark.createDataFrame([(n,) for n in names], "file string")), "file", "left_semi"), folder, layouts[0])
    fs, at = _files(spark, path), spark._jvm.org.apache.hadoop.fs.Path
    for n in names:
        copy = n + BACKUP
        fs.rename(at(n), at(f"{n}.{uuid.uuid4().hex[:8]}{BACKUP}") if fs.exists(at(copy)) else at(copy))
    for s in fs.listStatus(at(folder)):
        if s.getPath().getName().endswith(".csv"):
            fs.rename(s.getPath(), at(f"{path.rstrip('/')}/{s.getPath().getName()}"))
    fs.delete(at(folder), True)
    return len(names)


def summary(rows: DataFrame) -> DataFrame:
    """(user, questions, tokens, avg_tokens, last) by who asked."""
    tokens = F.coalesce(F.col("toplam_token").try_cast("long"), F.lit(0))
    g = rows.groupBy(F.col("kullanici").alias("user")).agg(F.count("*").alias("questions"), F.sum(tokens).alias("tokens"), F.max("zaman").alias("last"))
    return g.select("user", "questions", "tokens", F.round(F.col("tokens") / F.col("questions")).cast("long").alias("avg_tokens"), "last")
