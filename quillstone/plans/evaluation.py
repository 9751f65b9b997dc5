"""Queries of evaluation: relevance of what a search finds, and answers scored against what was expected."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.catalog import query, read
from quillstone.operators import evaluate
from quillstone.operators import search as s
from quillstone.plans.answers import _ONE, _lines
from quillstone.plans.search import _bm25_sql, _index, _questions

_FACT = "array<struct<parameter:array<string>,value:string,unit:string,qualifier:string,conditions:array<string>>>"


def _passage_items(spark, sf):
    """Passages as questions, by turns with pages, with facts, with a text of two spellings, and with a source alone."""
    word = "element_at(split(text, '[^\\\\p{L}]+'), 3)"
    return read(spark, sf, "benchmark").selectExpr(
        "item_id as id", "case when item_id % 4 = 3 or item_id % 8 = 0 then concat('SRC', item_id % 2) end as document", "case when item_id % 4 = 0 then array(int(1 + item_id % 3), 9) end as pages",
        f"cast(case when item_id % 4 = 1 then array(named_struct('parameter', array('x'), 'value', substr(text, 20, 25), 'unit', '', 'qualifier', '', 'conditions', array())) end as {_FACT}) as facts",
        f"case when item_id % 4 = 2 then array(array('no such words', replace(text, ' ', '  ')), array({word})) end as expected",
    )


_FLAT = r"regexp_replace(lower({0}), '[\s\x{{00A0}}\x{{202F}}]+', ' ', 'g')"


@query(f"""WITH h AS ({_bm25_sql({"text": 1.0}, 8, columns="query_id AS id, doc_id, rank")}),
 x AS (SELECT h.id, h.rank, {_FLAT.format("d.text")} AS t, d.source || ' ' || d.lang AS doc, 1 + d.n_chars // 3000 AS last, {_FLAT.format("substr(b.text, 20, 25)")} AS fact, {_FLAT.format("b.text")} AS whole, lower(regexp_split_to_array(b.text, '[^\\p{{L}}]+')[3]) AS word
  FROM h JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = h.id),
 g AS (SELECT id, min(rank) AS first_rank FROM x WHERE (NOT (id % 4 = 3 OR id % 8 = 0) OR contains(lower(doc), 'src' || (id % 2)))
  AND CASE id % 4 WHEN 0 THEN 1 + id % 3 <= last OR 9 <= last WHEN 1 THEN contains(t, fact) WHEN 2 THEN contains(t, whole) AND contains(t, word) ELSE true END GROUP BY id)
SELECT item_id AS id, first_rank FROM benchmark LEFT JOIN g ON g.id = item_id""")
def relevance_ranks(spark, sf):
    """The first relevant document among eight, by the rung that each item has. A page is 3,000 characters."""
    hits = s.bm25(_index(spark, sf), "doc_id", {"text": 1.0}, _questions(spark, sf), 8).select(F.col("query_id").alias("id"), "doc_id", "rank")
    d = read(spark, sf, "documents").select("doc_id", "text", F.concat_ws(" ", "source", "lang").alias("doc_text"), F.lit(1).alias("page_start"), F.expr("1 + n_chars div 3000").alias("page_end"))
    return evaluate.first_ranks(_passage_items(spark, sf), hits.join(d, "doc_id"))


def _order_items(spark, sf):
    """Orders as questions, answered by a claim for each line, with lines as facts and suppliers as documents."""
    li = _lines(spark, sf)
    facts = li.where("l_tax > 0.03").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.expr("struct(l_linenumber as n, l_partkey as p, int(l_quantity) as q)"))).alias("f"))
    least = li.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"))
    o = read(spark, sf, "orders").join(facts, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey").join(least, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    fact = "named_struct('parameter', array(concat('P', x.p), 'none'), 'value', string(x.q), 'unit', 'ns', 'qualifier', '', 'conditions', array())"
    items = o.selectExpr(
        "o_orderkey as id", "o_orderkey % 9 <> 0 as answerable", "o_orderkey % 10 = 0 as clarify", "case when o_custkey % 5 > 0 then concat('SUPPLIER ', s) end as document", "case when o_custkey % 2 = 0 then 'a' else '' end as revision",
        "case when o_custkey % 3 > 0 then array(int(o_custkey % 3), 6) end as pages", f"cast(transform(f, x -> {fact}) as {_FACT}) as facts",
        "case when o_orderkey % 4 = 0 then array(array('is 1', 'IS  2')) end as keywords", "case when o_orderkey % 6 = 0 then array(array('1.5', 'two')) end as expected",
    )
    answers = read(spark, sf, "orders").selectExpr("o_orderkey as id", "case when o_orderstatus = 'P' then 'clarify' else 'supported' end as status", "case when o_custkey % 2 = 0 then 'about 1,5' else 'about 1' end as answer", "case when o_orderkey % 13 = 0 then 'stopped' end as error")
    claims = li.selectExpr("l_orderkey as id", "l_linenumber as claim_id", "case l_returnflag when 'R' then 'removed' when 'A' then 'kept' else 'flagged' end as outcome", "concat('P', l_partkey, ' is ', int(l_quantity) + int(l_discount >= 0.08), ' ns') as text")
    sources = li.selectExpr("l_orderkey as id", "l_linenumber % 2 = 1 as cited", "concat('supplier ', l_suppkey) as title", "'' as path", "l_returnflag as revision", "l_linenumber as page_start", "l_linenumber + 1 as page_end")
    return items, answers, claims, sources


@query(f"""WITH l AS {_ONE}, k AS (SELECT *, l_quantity::INT + (l_discount >= 0.08)::INT AS q FROM l WHERE l_returnflag <> 'R'),
 said AS (SELECT l_orderkey AS id, bool_or(left(q::VARCHAR, 1) IN ('1', '2')) AS word FROM k GROUP BY 1),
 f AS (SELECT a.l_orderkey AS id, a.l_linenumber AS n, max(CASE WHEN k.q IS NULL THEN 0 WHEN k.q = a.l_quantity::INT THEN 1 ELSE 2 END) AS v FROM l a LEFT JOIN k ON k.l_orderkey = a.l_orderkey AND k.l_partkey = a.l_partkey WHERE a.l_tax > 0.03 GROUP BY ALL),
 fs AS (SELECT id, bool_and(v = 1) AS ok, string_agg(['absent', 'correct', 'conflict'][v + 1], ',' ORDER BY n) AS facts FROM f GROUP BY id), s AS (SELECT l_orderkey AS id, min(l_suppkey) AS s FROM l GROUP BY 1),
 i AS (SELECT o.*, o_orderkey AS id, o_orderkey % 9 <> 0 AS answerable, o_orderkey % 10 = 0 AS clarify, said.id IS NOT NULL AS answered, o_orderstatus = 'P' AS clarified, o_orderkey % 13 <> 0 AS judged, coalesce(ok, true) AND (o_orderkey % 4 <> 0 OR coalesce(word, false)) AS fine, ok IS NOT NULL OR o_orderkey % 4 = 0 AS expects, facts, s
  FROM orders o LEFT JOIN said ON said.id = o_orderkey LEFT JOIN fs ON fs.id = o_orderkey LEFT JOIN s ON s.id = o_orderkey),
 d AS (SELECT i.id, bool_or(contains('supplier ' || l_suppkey, 'supplier ' || s) AND (o_custkey % 2 = 1 OR l_returnflag = 'A')) AS doc, bool_or(contains('supplier ' || l_suppkey, 'supplier ' || s) AND (o_custkey % 2 = 1 OR l_returnflag = 'A') AND (o_custkey % 3 BETWEEN l_linenumber AND l_linenumber + 1 OR 6 BETWEEN l_linenumber AND l_linenumber + 1)) AS page FROM i JOIN l ON l_orderkey = i.id WHERE l_linenumber % 2 = 1 GROUP BY 1)
SELECT i.id, CASE WHEN judged THEN answered END AS answered, CASE WHEN judged THEN clarified END AS clarified, CASE WHEN judged AND answerable AND NOT (clarify AND clarified) THEN facts END AS facts,
 CASE WHEN NOT judged THEN NULL WHEN clarify AND clarified THEN true WHEN NOT answerable THEN NOT answered WHEN expects THEN answered AND fine END AS correct,
 CASE WHEN NOT judged THEN NULL WHEN clarify AND clarified THEN false WHEN NOT answerable THEN answered WHEN expects THEN answered AND NOT fine END AS wrong,
 CASE WHEN judged AND NOT (clarify AND clarified) AND answerable AND o_custkey % 5 > 0 AND s IS NOT NULL THEN coalesce(doc, false) END AS source_correct,
 CASE WHEN judged AND NOT (clarify AND clarified) AND answerable AND o_custkey % 5 > 0 AND s IS NOT NULL AND o_custkey % 3 > 0 THEN coalesce(page, false) END AS page_correct,
 CASE WHEN judged AND NOT (clarify AND clarified) AND answerable AND i.id % 6 = 0 THEN o_custkey % 2 = 0 END AS "contains" FROM i LEFT JOIN d USING (id)""")
def score_answers(spark, sf):
    out = evaluate.score(*_order_items(spark, sf))
    return out.select("id", "answered", "clarified", F.array_join("facts", ",").alias("facts"), "correct", "wrong", "source_correct", "page_correct", "contains")
