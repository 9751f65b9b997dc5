"""The queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.llm import hmm, manifest, mixing, packing, quality, resampling, sharding, simhash, substrings, suffixes, topk, toxicity, vectors
from quillstone.llm.common import read
from quillstone.llm.oracles import ORACLES  # noqa: F401


def tokenizer_path() -> str:
    """The public tokenizer's vocabulary file, as installed on driver and executors alike."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def fold(doc_id):
    """crc32 of the id as text, modulo 5; that of an empty text for a row without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 5


def op1_mixing(spark, sf_dir):
    return mixing.quotas(read(spark, sf_dir, "documents"))


def op2_sharding(spark, sf_dir):
    return sharding.place(read(spark, sf_dir, "documents").select("doc_id")).select("row.doc_id", "slot", "shard")


def op3_hmm(spark, sf_dir):
    return hmm.score(read(spark, sf_dir, "documents"), fold(F.col("doc_id")) == 1)


def op4_quality(spark, sf_dir):
    return quality.verdicts(read(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op6_substrings(spark, sf_dir):
    """The text that is left of every document, and how many sentences went."""
    return substrings.removed(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_toxicity(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id")) != 0))
    return toxicity.scores(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_simhash(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_vectors(spark, sf_dir):
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op10_suffixes(spark, sf_dir):
    return suffixes.deduplicate(read(spark, sf_dir, "documents"))


def op11_topk(spark, sf_dir):
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_manifest(spark, sf_dir):
    """Tampered: texts lower-cased in A-Z, of the ids whose crc32 is divisible by 5."""
    docs = read(spark, sf_dir, "documents")
    return manifest.manifest(docs, F.when(fold(F.col("doc_id")) == 0, manifest.lower_ascii(F.col("text"))))


def op13_resampling(spark, sf_dir):
    rows = resampling.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_sharding, op3_hmm, op4_quality, op5_packing, op6_substrings, op7_toxicity, op8_vectors, op9_simhash, op10_suffixes, op11_topk, op12_manifest, op13_resampling)}
