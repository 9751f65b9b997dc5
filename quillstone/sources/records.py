"""Gold questions, feedback and reports: lenient readers with explicit schemas, and what is made of them."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = (
    "id string, question string, answerable boolean, status string, document string, revision string, pages array<int>, "
    "facts array<struct<parameter:array<string>,value:string,unit:string,qualifier:string,conditions:array<string>>>, "
    "keywords array<array<string>>, kind string, clarify boolean, note string"
)


def _many(x) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def gold_items(spark: SparkSession, text: str) -> DataFrame:
    """Questions of a YAML list (a file of some hundred, read on the driver): missing keys take defaults, older
    names of keys are understood, and single values stand for lists of one."""
    raw = yaml.safe_load(text) or []
    if not isinstance(raw, list) or any(not isinstance(r, dict) or not r.get("question") for r in raw):
        raise ValueError("a list of items, each with a question, was expected")
    text_of = lambda x: "" if x is None else str(x)
    rows = []
    for i, r in enumerate(raw):
        facts = [([str(p) for p in _many(f.get("parameter"))], text_of(f.get("value")), text_of(f.get("unit")), text_of(f.get("qualifier")).lower(), [str(c) for c in _many(f.get("conditions"))]) for f in _many(r.get("facts"))]
        pages = r.get("pages") or r.get("expected_pages") or r.get("expected_page")
        rows.append((
            str(r.get("id", i)), r["question"], bool(r.get("answerable", True)), str(r.get("status", "draft")), r.get("document") or r.get("expected_doc"),
            None if r.get("revision") is None else str(r["revision"]), [int(p) for p in _many(pages)], facts, [[str(a) for a in _many(k)] for k in _many(r.get("keywords"))],
            text_of(r.get("kind")), bool(r.get("clarify")), text_of(r.get("note")),
        ))
    return spark.createDataFrame(rows, ITEM)


FEEDBACK = (
    "id string, created_at string, rating string, question string, answer string, unanswerable boolean, "
    "correction struct<value:string,unit:string,parameter:string,document:string,note:string,page:int>, sources array<struct<n:int,file:string,revision:string,page_start:int>>"
)


def json_records(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """One JSON document a file; those that can't be read, or have no key, are left out."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path).where(F.col(key).isNotNull())


def candidate_items(feedback: DataFrame) -> DataFrame:
    """(id, question, answerable, document, page, parameter, value, unit): a question for each record that says what is right: marked
    unanswerable, corrected with a value, or liked, with its first source. Others make none."""
    c = F.col("correction")
    first = F.get("sources", 0)
    fixed = F.coalesce(c["value"], F.lit("")) != ""
    made = (
        F.when(F.coalesce("unanswerable", F.lit(False)), F.struct(F.lit(False).alias("answerable"), F.lit(None).cast("string").alias("document"), F.lit(None).cast("int").alias("page"), *[F.lit(None).cast("string").alias(x) for x in ("parameter", "value", "unit")]))
        .when(fixed, F.struct(F.lit(True).alias("answerable"), F.coalesce(F.nullif(c["document"], F.lit("")), first["file"]).alias("document"), F.when(c["page"] > 0, c["page"]).alias("page"), *[c[x].alias(x) for x in ("parameter", "value", "unit")]))
        .when((F.col("rating") == "up") & (F.size("sources") > 0), F.struct(F.lit(True).alias("answerable"), first["file"].alias("document"), first["page_start"].alias("page"), *[F.lit(None).cast("string").alias(x) for x in ("parameter", "value", "unit")]))
    )
    return feedback.withColumn("_m", made).where("_m is not null").select("id", "question", "_m.*")


def yaml_of(items: DataFrame, most: int = 10_000) -> str:
    """Items as YAML; a person reads these, so there are ``most`` at most, and more is an error."""
    rows = items.orderBy("id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} items")
    return yaml.safe_dump([{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in rows], allow_unicode=True, sort_keys=False)


def newest(reports: DataFrame, at: str, n: int = 30) -> DataFrame:
    return reports.orderBy(F.desc(at), "id").limit(n)
