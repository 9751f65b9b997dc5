"""Event streams: windows, sessions, running totals, and exactly-once intake."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.session import shared_dir


def timed(events: DataFrame, at: str = "ts") -> DataFrame:
    """Event time as a timestamp with zone: watermarks don't take one without."""
    return events.withColumn(at, F.col(at).cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total)."""
    g = timed(events).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, stop, n)."""
    g = timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total): running totals, for update or complete mode."""
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def once(events: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def split_thoughts(pieces: DataFrame) -> DataFrame:
    """(stream_id, answer, thoughts): texts that arrive in pieces (stream_id, at, text), parted at <think> and </think>,
    wherever the pieces are cut. For batches, and for streams in complete mode: a stream's pieces are joined in their order."""
    whole = pieces.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "").alias("t"))
    closed = F.regexp_replace("t", r"(?s)<think>.*?(?:</think>|$)", "")
    return whole.select("stream_id", closed.alias("answer"), F.array_join(F.regexp_extract_all("t", F.lit(r"(?s)<think>(.*?)(?:</think>|$)"), F.lit(1)), "").alias("thoughts"))


def run_available(spark: SparkSession, path: str, transform, mode: str = "append", files: int | None = None) -> DataFrame:
    """What a stream over a folder of Parquet files yields once all that is there is read, ``files`` of them in a
    micro-batch, in the order in which they were written (none given: all in one). The result is a
    table in the shared folder; state and progress are kept there as well, so a lost executor costs a retry."""
    schema = spark.read.parquet(path).schema
    base = f"{shared_dir(spark)}/quillstone/stream-{uuid.uuid4().hex}"
    # A single file is a table too: the glob limits the stream to it.
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{folder}/{name}*")
    out = transform(stream)

    def keep(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(f"{base}/out")
        else:
            batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")
