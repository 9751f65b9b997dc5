"""Retrieval and answer metrics that keep numerator and denominator; a rate over nothing is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import statements


def retrieval(ranks: DataFrame, rank: str, ks: tuple[int, ...] = (1, 3, 5, 8)) -> DataFrame:
    """One row: n, recall at each k, and the mean reciprocal rank; rank is null where nothing was found."""
    r = F.col(rank)
    cols = [F.round(F.avg(F.coalesce((r <= k).cast("double"), F.lit(0.0))), 3).alias(f"recall_{k}") for k in ks]
    return ranks.agg(F.count("*").alias("n"), *cols, F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 3).alias("mrr"))


def rates(rows: DataFrame, named: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(name, num, den, rate): how many rows meet both conditions, of those that meet the second."""
    aggs = [F.struct(F.lit(n).alias("name"), F.count_if(a & b).alias("num"), F.count_if(b).alias("den")) for n, (a, b) in named.items()]
    one = rows.agg(*[a.alias(f"c{i}") for i, a in enumerate(aggs)])
    out = one.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(aggs))])).alias("r")).select("r.*")
    return out.withColumn("rate", F.round(F.try_divide(F.col("num"), F.col("den")), 3))


ANSWER = {
    "answered_rate": ("answered", "answered is not null"),
    "abstention_rate": ("not answered", "answered is not null"),
    "fact_accuracy_of_answered": ("correct", "answerable and answered and correct is not null"),
    "fact_accuracy_of_all_answerable": ("correct", "answerable and answered is not null and correct is not null"),
    "wrong_answer_rate_of_answered": ("coalesce(wrong, false)", "answered"),
    "wrong_answer_rate_of_all": ("coalesce(wrong, false)", "answered is not null"),
    "correct_abstention_rate": ("not answered", "not answerable and answered is not null"),
    "unnecessary_abstention_rate": ("not answered and not clarified", "answerable and answered is not null and correct is not null"),
    "clarification_rate": ("clarified", "answered is not null and clarify"),
    "unexpected_clarification_rate": ("clarified", "answered is not null and not clarify"),
    "source_accuracy": ("source_correct", "answerable and answered and correct is not null and source_correct is not null"),
    "page_accuracy": ("page_correct", "answerable and answered and correct is not null and page_correct is not null"),
}


def answers(results: DataFrame) -> DataFrame:
    """The answer metrics of results (answered, answerable, correct, wrong, clarified, clarify,
    source_correct, page_correct, error), without those that failed."""
    ok = results.where("error is null")
    yes = lambda e: F.coalesce(F.expr(e), F.lit(False))
    return rates(ok, {k: (yes(a), yes(b)) for k, (a, b) in ANSWER.items()})


def _flat(text: Column) -> Column:
    """Lower case, runs of blanks of any kind as one."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\x{00A0}\x{202F}]+", " ")


def contains_all(text: Column, expected: Column) -> Column:
    """Every entry of expected (array of arrays of alternatives) has an alternative in the text, case and runs of blanks aside;
    decimals also with a comma. No entries: true; an entry without alternatives: false. Null text is empty, null entries none."""
    comma = lambda a: F.when(a.rlike(r"\d\.\d"), F.replace(a, F.lit("."), F.lit(",")))
    forms = lambda e: F.array_compact(F.flatten(F.transform(e, lambda a: F.array(_flat(a), comma(_flat(a))))))
    # The text is made flat once, in an array of one, not for each alternative.
    found = lambda t: F.forall(F.coalesce(expected, F.array()), lambda e: F.exists(forms(e), lambda a: F.contains(t, a)))
    return F.exists(F.array(_flat(text)), found)


def _some(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def _named(document: Column) -> Column:
    return F.coalesce(document, F.lit("")) != ""


def relevant(doc_text: Column, page_start: Column, page_end: Column, text: Column) -> Column:
    """Whether a passage is what an item (document, pages, facts, expected; all may be null) asks for. It is of the named document,
    if one is named; then the first of these that the item has decides: its pages, the values of its facts, its expected texts;
    with none of them, that a document is named."""
    document = F.col("document")
    values = F.transform("facts", lambda f: F.array(f["value"]))
    rung = (
        F.when(_some(F.col("pages")), F.exists("pages", lambda p: p.between(page_start, page_end)))
        .when(_some(F.col("facts")), contains_all(text, values)).when(_some(F.col("expected")), contains_all(text, F.col("expected"))).otherwise(_named(document))
    )
    return F.coalesce((~_named(document) | F.contains(F.lower(doc_text), F.lower(document))) & rung, F.lit(False))


def first_ranks(items: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, first_rank): the least rank of a relevant hit, null where none is. hits: id, rank, doc_text, page_start, page_end, text."""
    met = hits.withColumnRenamed("text", "_text").join(items.select("id", "document", "pages", "facts", "expected"), "id")
    good = met.where(relevant(F.col("doc_text"), F.col("page_start"), F.col("page_end"), F.col("_text")))
    return items.select("id").join(good.groupBy("id").agg(F.min("rank").alias("first_rank")), "id", "left")


def score(items: DataFrame, answers: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per item: id, error, answerable, clarify, answered, clarified, facts (verdicts in the item's order), correct, wrong,
    source_correct, page_correct, contains.

    items: id, answerable, clarify, document, revision, pages, facts (parameter: array, value, unit, qualifier, conditions: array),
    keywords, expected (arrays of alternatives). answers: id, status, answer, error; an item without one, or with an error, is not
    judged. claims: id, claim_id, outcome, text; only kept and flagged ones count. sources: id, cited, title, path, revision,
    page_start, page_end; only cited ones count. A fact is a conflict if any claim gives it another value, else correct if any
    gives it. A question that depends on a condition is right if it is asked back; one without an answer, if it has none."""
    kept = claims.where(F.col("outcome").isin("kept", "flagged")).select("id", "claim_id", "text")
    told = kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_id", "text"))), lambda c: c["text"]), "\n").alias("_said"))
    asked = items.select("id", F.posexplode("facts").alias("at", "f"))
    each = asked.join(kept, "id", "left")
    verdict = statements.judge_fact(F.col("text"), F.col("f.parameter"), F.col("f.value"), F.col("f.unit"), F.col("f.qualifier"), F.coalesce("f.conditions", F.array().cast("array<string>")))
    worst = each.withColumn("v", verdict).groupBy("id", "at").agg(F.max(F.when(F.col("v") == "conflict", 2).when(F.col("v") == "correct", 1).otherwise(0)).alias("v"))
    name = F.array(F.lit("absent"), F.lit("correct"), F.lit("conflict"))
    facts = worst.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: F.get(name, x["v"])).alias("_facts"))
    shown = sources.where("cited").select("id", F.concat_ws(" ", "title", "path").alias("_where"), F.col("revision").alias("_rev"), "page_start", "page_end")
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    right_one = F.contains(F.lower("_where"), F.lower("document")) & ((lower(F.col("revision")) == "") | (lower(F.col("revision")) == lower(F.col("_rev"))))
    on_page = right_one & F.exists("pages", lambda p: p.between(F.col("page_start"), F.col("page_end")))
    seen = shown.join(items.where(_named(F.col("document"))).select("id", "document", "revision", "pages"), "id")
    seen = seen.groupBy("id").agg(F.coalesce(F.bool_or(right_one), F.lit(False)).alias("_doc"), F.coalesce(F.bool_or(on_page), F.lit(False)).alias("_page"))
    j = items.join(answers, "id", "left").join(told, "id", "left").join(facts.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").drop("_id").join(seen, "id", "left")
    judged = F.col("error").isNull() & F.col("status").isNotNull()
    j = j.withColumn("answered", F.when(judged, F.col("_said").isNotNull())).withColumn("clarified", F.when(judged, F.col("status") == "clarify"))
    expects = _some(F.col("facts")) | _some(F.col("keywords"))
    right = F.col("answered") & contains_all(F.col("_said"), F.col("keywords")) & F.forall(F.coalesce("_facts", F.array().cast("array<string>")), lambda v: v == "correct")
    back = F.coalesce("clarify", F.lit(False)) & F.col("clarified")
    looked = judged & ~back & F.col("answerable") & _named(F.col("document"))
    return j.select(
        "id", "error", "answerable", "clarify", "answered", "clarified", F.when(judged & F.col("answerable") & ~back, F.col("_facts")).alias("facts"),
        F.when(~judged, None).when(back, True).when(~F.col("answerable"), ~F.col("answered")).when(expects, right).alias("correct"),
        F.when(~judged, None).when(back, False).when(~F.col("answerable"), F.col("answered")).when(expects, F.col("answered") & ~right).alias("wrong"),
        F.when(looked, F.coalesce("_doc", F.lit(False))).alias("source_correct"), F.when(looked & _some(F.col("pages")), F.coalesce("_page", F.lit(False))).alias("page_correct"),
        F.when(judged & F.col("answerable") & ~back & _some(F.col("expected")), contains_all(F.col("answer"), F.col("expected"))).alias("contains"),
    )


def run(items: DataFrame, hits: DataFrame, answers: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """The results of an evaluation, from items to what ``retrieval`` and ``answers`` sum up: score's columns and first_rank."""
    return score(items, answers, claims, sources).join(first_ranks(items, hits), "id")
