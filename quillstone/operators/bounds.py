"""Broadcasting only what has been counted, and numbering rows without gathering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import written

#: Rows up to which a side may be sent to every executor.
ROWS = 100_000


def is_small(df: DataFrame, rows: int = ROWS) -> bool:
    """df has ``rows`` rows at most. The count stops one row beyond the bound."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """df, to be broadcast if it is counted to have ``rows`` rows at most; else as it is, and the join shuffles."""
    return F.broadcast(df) if is_small(df, rows) else df


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds a dense number from 0 in the given order. Rows are sorted by range and written; a partition's
    rows are numbered by themselves, from what the partitions before it count up to."""
    part = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = part.groupBy("_part").agg(F.count("*").alias("_rows"))  # a row a partition
    before = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return part.join(small(before), "_part").withColumn(name, (F.col("_before") + nth - 1).cast("long")).drop("_part", "_before")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out, if its scan has fewer partitions than there are cores: a file in one piece would keep the
    others idle. Inputs of many files or splits stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys, in as many partitions as a shuffle has, for Python's work: few bytes may be much of it, so adaptive
    execution, which goes by bytes, must not merge them. Grouping by these keys needs no further shuffle."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)
