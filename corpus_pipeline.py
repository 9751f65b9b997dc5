"""The corpus pipeline: toxic documents go, one document of each group of near copies stays, repeated
passages keep their first occurrence, sources are mixed to their weights, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
docs. Stages that change a text set n_chars, where there is such a column, to the text's new length.

Null texts count as empty ones everywhere: they score as clean, are one group of near copies (of which one stays,
with other texts without words), lose no passage, and are not taken by the mix, as they have no words. Null ids come
last among equals. Rows that repeat id and text are near copies. Columns may have any names; an empty table gives
empty results. Without labels of both classes no document is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import mixing, packing, simhash, substrings, toxicity
from quillstone.llm.queries import fold, tokenizer_path
from quillstone.session import discard, scratch, written


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score one half or more go. Learns from the labels that op7 may learn from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id")) != 0))
    return toxicity.clean(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that texts link of which 0.8 of the five-word shingles agree, the document of the least id stays."""
    return simhash.first_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of repeated runs go, but for the first occurrence. Every document stays."""
    return _sized(substrings.deduplicate(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in part where it takes a part."""
    return _sized(mixing.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", toxic), ("simhash", near_copies), ("substrings", passages), ("mixing", mixed), ("packing", packed)]

#: No SQL: fingerprints, learned scores and tokenizers are beyond it. tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order, each over what the one before has written. What a stage writes in between is
    deleted with its end, its input too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch():
            out = written(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
