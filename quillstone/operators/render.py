"""Answers after the check: statements kept, flagged, dropped or corrected, and nothing left standing for them alone."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLAG = "⚠"


def corrections(fixes: DataFrame, failing: DataFrame) -> DataFrame:
    """(answer_id, claim_id, fix) of usable corrections (answer_id, claim_id, text): of failing claims only, one line,
    the last for each claim; '' removes it, null is none. failing: answer_id, claim_id, kind. A table row is only
    replaced by a table row, code by nothing."""
    one = F.trim(F.regexp_replace("text", r"\s+", " "))
    last = fixes.where("text is not null").groupBy("answer_id", "claim_id").agg(F.max_by(one, "nth").alias("fix"))
    usable = F.when(F.col("fix") == "", True).when(F.col("kind") == "row", F.col("fix").startswith("|") & F.col("fix").endswith("|")).otherwise(F.col("kind") != "code")
    return last.join(failing.select("answer_id", "claim_id", "kind"), ["answer_id", "claim_id"]).where(usable).select("answer_id", "claim_id", "fix")


def _said(decision: Column, fix: Column, text: Column, kind: Column) -> Column:
    """What a part says after the check; null if nothing."""
    flagged = F.when(kind.isin("row", "head"), F.concat(F.regexp_replace(text, r"\s*\|?\s*$", ""), F.lit(f" {FLAG} |"))).otherwise(F.concat(text, F.lit(f" {FLAG}")))
    return F.when(decision.isNull(), text).when((decision == "drop") | F.coalesce(fix == "", F.lit(False)), None).when(fix.isNotNull(), fix).when(decision == "flag", flagged).otherwise(text)


def _level(text: str) -> int:
    bare = text.lstrip()
    return len(bare) - len(bare.lstrip("#"))


def tidy(items: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Lines (kind, text) without those that nothing stands for any more: heads without rows, separators without a head,
    fences around nothing, lead-ins and headings that nothing follows.

    Whether a line stays depends on what stays behind it alone, so one pass from the end finds what remains."""
    kept: list[tuple[str, str]] = []  # in reverse

    def behind(n: int) -> list[tuple[str, str]]:
        return [x for x in kept[::-1] if x[0] != "blank"][:n]

    open_fence = False
    for kind, text in reversed(items):
        nxt = behind(2)
        if kind == "fence":
            open_fence = not open_fence
            if not open_fence and nxt and nxt[0][0] == "fence":  # nothing between the two
                while kept and kept[-1][0] == "blank":
                    kept.pop()
                kept.pop()
                continue
        elif kind != "sep" and nxt and nxt[0][0] == "sep" and not (kind == "head" or kind == "blank"):
            at = next(i for i in range(len(kept) - 1, -1, -1) if kept[i][0] == "sep")
            del kept[at]  # its head is gone
            nxt = behind(2)
        if kind == "head" and [k for k, _ in nxt] != ["sep", "row"]:
            if nxt and nxt[0][0] == "sep":
                del kept[next(i for i in range(len(kept) - 1, -1, -1) if kept[i][0] == "sep")]
            continue
        lead = lambda t: t.rstrip(" *").endswith(":")
        if kind == "text" and lead(text) and (not nxt or nxt[0][0] == "heading" or (nxt[0][0] == "text" and lead(nxt[0][1]))):
            continue
        if kind == "heading" and (not nxt or (nxt[0][0] == "heading" and _level(nxt[0][1]) <= _level(text))):
            continue
        kept.append((kind, text))
    out = kept[::-1]
    first = next((i for i, x in enumerate(out) if x[0] != "blank"), len(out))
    return [x for i, x in enumerate(out) if not (x[0] == "sep" and i == first)]


@F.pandas_udf(T.StringType())
def _joined(lines: pd.Series) -> pd.Series:
    def one(items):
        text = "\n".join(t for _, t in tidy([(x["kind"], x["text"]) for x in items]))
        while "\n\n\n" in text:
            text = text.replace("\n\n\n", "\n\n")
        return text.strip()

    return lines.map(one)


def _met(parts: DataFrame, of: DataFrame, name: str) -> DataFrame:
    """parts with a column of what claims have, null where they have none. Claims come in their answer's row, so that parts which are
    already dealt by answer stay where they are."""
    per = of.groupBy("answer_id").agg(F.collect_list(F.struct("claim_id", name)).alias("_of"))
    mine = F.filter("_of", lambda x: x["claim_id"] == F.col("claim_id"))
    return parts.join(per, "answer_id", "left").select(*parts.columns, F.explode_outer(mine).alias("_m")).select(*parts.columns, F.col("_m")[name].alias(name))


def render(parts: DataFrame, decisions: DataFrame, fixes: DataFrame | None = None) -> DataFrame:
    """(answer_id, text): answers of parts (answer_id, line, kind, prefix, nth, text, claim_id) by decisions (answer_id,
    claim_id, decision: keep, flag or drop) and corrections (answer_id, claim_id, fix).

    Parts without a claim stay. A line whose claims are all gone goes, with what stood for it alone; so do the rows
    below a table's head that is gone. All is grouped by answer, so each input is shuffled once at most."""
    j = _met(parts, decisions, "decision")
    j = j.withColumn("fix", F.lit(None).cast("string")) if fixes is None else _met(j, fixes, "fix")
    j = j.withColumn("said", _said(F.col("decision"), F.col("fix"), F.col("text"), F.col("kind")))
    claims = F.col("claim_id").isNotNull()
    line = j.groupBy("answer_id", "line", "kind", "prefix").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("nth", "said")))), lambda x: x["said"]), " ").alias("text"),
        F.bool_or(claims).alias("stated"), F.coalesce(F.bool_or(claims & F.col("said").isNotNull()), F.lit(False)).alias("left"),
    )
    whole = F.rtrim(F.concat(F.coalesce("prefix", F.lit("")), F.col("text")))
    stays = ~F.coalesce("stated", F.lit(False)) | F.col("left")
    lines = line.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("line", "kind", F.when(stays, whole).alias("text")))).alias("lines"))
    # Below a head that is gone, the separator and rows up to the table's end go as well.
    fold = F.aggregate(
        "lines",
        F.struct(F.lit(False).alias("skip"), F.array().cast("array<struct<kind:string,text:string>>").alias("out")),
        lambda s, x: F.struct(
            (F.when(x["kind"] == "head", x["text"].isNull()).otherwise(s["skip"] & x["kind"].isin("sep", "row"))).alias("skip"),
            F.when(x["text"].isNull() | (s["skip"] & x["kind"].isin("sep", "row")), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(x["kind"].alias("kind"), x["text"].alias("text"))))).alias("out"),
        ),
        lambda s: s["out"],
    )
    return lines.select("answer_id", _joined(fold).alias("text"))
