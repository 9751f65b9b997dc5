"""Which claim each citation of an answer belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as tx

#: Fenced blocks, open ones up to the end, and `code` within a line.
_CODE = r"(?ms)^[^\S\n]*```.*?(?:^[^\S\n]*```[^\n]*$|\z)|`[^`\n]+`"


def blank_code(text: Column) -> Column:
    """A text of the same length with blanks in place of code."""
    parts, code = F.split(text, _CODE, -1), F.regexp_extract_all(text, F.lit(_CODE), F.lit(0))
    return F.array_join(F.zip_with(parts, code, lambda p, c: F.concat(p, F.coalesce(F.repeat(F.lit(" "), F.length(c)), F.lit("")))), "")


def places(text: Column, pattern: str) -> Column:
    """(at, mark) of every match, from left to right; at counts characters from 0."""
    parts, marks = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,mark:string>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        at = s["end"] + F.length(x["p"])
        return F.struct((at + F.length(x["m"])).alias("end"), F.concat(s["found"], F.array(F.struct(at.alias("at"), x["m"].alias("mark")))).alias("found"))

    both = F.zip_with(F.slice(parts, F.lit(1), F.size(marks)), marks, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    return F.aggregate(both, start, step, lambda s: s["found"])


def spans(text: Column, claims: Column) -> Column:
    """(lo, hi, claim_id) of claims (claim_id, text) in their order. Each is looked for behind the one before, and if it isn't
    there, from the start; claims that are nowhere have no span."""
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<lo:int,hi:int,claim_id:bigint>>").alias("spans"))

    def step(s: Column, c: Column) -> Column:
        behind, anywhere = F.call_function("locate", c["text"], text, s["next"]), F.call_function("locate", c["text"], text)
        at = F.when(behind > 0, behind).otherwise(anywhere)
        end = at + F.length(c["text"])
        one = F.struct((at - 1).alias("lo"), (end - 1).alias("hi"), c["claim_id"].cast("long").alias("claim_id"))
        return F.when(at > 0, F.struct(end.alias("next"), F.concat(s["spans"], F.array(one)).alias("spans"))).otherwise(s)

    return F.aggregate(claims, start, step, lambda s: s["spans"])


def citation_spans(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """(answer_id, nth, at, number, claim_id): for every number that an answer cites, ranges expanded, in the order of the text, the
    claim whose span holds the citation; null if none does.

    answers: answer_id, text. claims: answer_id, claim_id, text, outcome; those kept or flagged have spans, in order of
    claim_id. Of spans that overlap the earlier claim's counts. Citations in code are none. Answers meet their claims in one
    equi-join; offsets are compared with spans within the answer's row."""
    told = claims.where(F.col("outcome").isin("kept", "flagged") & (F.coalesce("text", F.lit("")) != ""))
    told = told.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", "text"))).alias("_claims"))
    a = answers.select("answer_id", F.coalesce("text", F.lit("")).alias("_text")).join(told, "answer_id", "left")
    a = a.withColumn("_spans", F.coalesce(spans(F.col("_text"), F.col("_claims")), F.array().cast("array<struct<lo:int,hi:int,claim_id:bigint>>")))
    a = a.withColumn("_blank", blank_code(F.col("_text"))).withColumn("_at", places(F.col("_blank"), tx.CITATION))

    def of(p: Column) -> Column:
        claim = F.get(F.filter("_spans", lambda s: (s["lo"] <= p["at"]) & (p["at"] < s["hi"])), F.lit(0))["claim_id"]
        return F.transform(tx.citations(p["mark"]), lambda n: F.struct(p["at"].alias("at"), n.alias("number"), claim.alias("claim_id")))

    return a.select("answer_id", F.posexplode(F.flatten(F.transform("_at", of))).alias("nth", "_x")).select("answer_id", "nth", "_x.at", "_x.number", "_x.claim_id")
