"""The engine's functions for SQL, and its tables as views."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import text, units
from quillstone.operators import chunking, verify

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()



def _scrubbed() -> str:
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    out = "t"
    for pattern, new in [*text.SCRUB, (r"[ \t\n\r]+", " ")]:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(new)})"
    return f"substring(trim({out}), 1, 300)"


#: SQL bodies: expanded by the optimizer where they are used, so they cost no more than being written out.
SQL_FUNCTIONS = {
    "estimate_tokens": ("(t STRING) RETURNS BIGINT", r"greatest(floor(length(t) / 4), floor(size(regexp_extract_all(t, '\\S+', 0)) * 1.3D))"),
    "lower_safe": ("(t STRING) RETURNS STRING", "lower(replace(t, 'İ', 'i'))"),
    "fold_letters": ("(t STRING) RETURNS STRING", "lower(translate(t, 'çÇğĞıIİöÖşŞüÜâîû', 'ccggiiioossuuaiu'))"),
    "fts_terms": (
        "(t STRING) RETURNS ARRAY<STRING>",
        r"slice(array_distinct(filter(regexp_extract_all(lower(replace(t, 'İ', 'i')), '[\\p{L}\\p{N}_]+', 0), x -> length(x) >= 2 and not array_contains(array(" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "), x))), 1, 48)",
    ),
    "scrub": ("(t STRING) RETURNS STRING", _scrubbed()),
    "strip_thinking": ("(t STRING) RETURNS STRING", r"btrim(regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>', ''), '(?s)^.*?</think>', ''), ' \t\r\n')"),
}


def register(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Temporary functions find_quantities, parse_claims, parse_citations, scrub and chunk_text (a table function, its rows moved
    by Arrow), those of SQL_FUNCTIONS, and, with a folder, its tables as views."""
    spark.udf.register("find_quantities", units.find_quantities)
    spark.udf.register("parse_claims", verify.parse_claims)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def chunk_texts(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [c["text"] for c in chunking.chunk([(1, p, "text", "") for p in (t or "").split("\n\n") if p.strip()])])

    spark.udf.register("chunk_texts", chunk_texts)

    @F.udtf(returnType="ordinal int, text string", useArrow=True)
    class ChunkText:
        def eval(self, given: str):
            for c in chunking.chunk([(1, p, "text", "") for p in (given or "").split("\n\n") if p.strip()]):
                yield c["ordinal"], c["text"]

    spark.udtf.register("chunk_text", ChunkText)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def parse_citations(t: pd.Series) -> pd.Series:
        return t.map(lambda x: verify.cites_of(x or ""))

    spark.udf.register("parse_citations", parse_citations)
    for name, (signature, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{signature} RETURN {body}")
    for t in TABLES if sf_dir else []:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
