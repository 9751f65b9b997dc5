"""Queries of metadata, calculations, references, grounding and stemmed search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.catalog import query, read
from quillstone.functions import calc
from quillstone.functions import metadata as md
from quillstone.functions import statements as st
from quillstone.functions import text as tx
from quillstone.functions import units as un
from quillstone.operators import grounding as gr
from quillstone.operators import pages as pg
from quillstone.operators import records as rc
from quillstone.operators import search as s
from quillstone.operators.bounds import dealt, spread
from quillstone.plans.answers import _ONE, _lines

_NAME = "concat(array('JESD79-4C', 'PCIe_Base_5.0_r1.0', 'Layout Guide rev B', 'USB Errata 2.0 March 2021', 'Addendum 2019-07')[o_orderkey % 5], ' ', o_orderkey % 7)"


@query("""SELECT o_orderkey, ['base', 'base', 'guide', 'errata', 'amendment'][o_orderkey % 5 + 1] AS doc_type, ['C', '1.0', 'B', '', ''][o_orderkey % 5 + 1] AS revision, ['', '5.0', '', '2.0', ''][o_orderkey % 5 + 1] AS version,
 ['', '', '', '2021-03', '2019-07'][o_orderkey % 5 + 1] AS doc_date, ['jesd79-4', 'pci express base ' || o_orderkey % 7, 'layout guide ' || o_orderkey % 7, 'usb march ' || o_orderkey % 7, '07 ' || o_orderkey % 7][o_orderkey % 5 + 1] AS series FROM orders""")
def doc_metadata(spark, sf):
    """Five names of known documents, each with a number behind it."""
    o = read(spark, sf, "orders").select("o_orderkey", F.expr(_NAME).alias("n"))
    n = F.col("n")
    return o.select("o_orderkey", md.doc_type(n).alias("doc_type"), md.revision(n).alias("revision"), md.version(n).alias("version"), md.date(n).alias("doc_date"), md.series(n).alias("series"))


@query("""WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '/' || lang || '/x/' || doc_id || '.txt' WHEN 1 THEN doc_id || '.txt' WHEN 2 THEN '/' || source || '/a.txt' ELSE source || '\\' || doc_id || '.md' END AS rel FROM documents),
 p AS (SELECT doc_id, rel, list_filter(string_split(replace(rel, '\\', '/'), '/'), lambda x: x <> '') AS p FROM r)
SELECT doc_id, CASE WHEN rel LIKE '/%' OR len(p) <= 1 THEN '' ELSE p[1] END AS bucket, CASE WHEN rel LIKE '/%' OR len(p) <= 1 THEN '' ELSE array_to_string(p[2:len(p)-1], '/') END AS subpath FROM p""".replace("\\\\", "\\"))
def path_buckets(spark, sf):
    rel = F.expr(r"case doc_id % 4 when 0 then concat(source, '/', lang, '/x/', doc_id, '.txt') when 1 then concat(doc_id, '.txt') when 2 then concat('/', source, '/a.txt') else concat(source, '\\', doc_id, '.md') end")
    return read(spark, sf, "documents").select("doc_id", md.bucket(rel).alias("b")).select("doc_id", "b.bucket", "b.subpath")


@query("SELECT doc_id, CASE WHEN toxic = 0 THEN 'S0 | ' ELSE '' END || source || chr(10) || chr(10) || text AS t FROM documents LEFT JOIN labels USING (doc_id)")
def embedding_text(spark, sf):
    """What is embedded of every document: the parts of its head that there are, and its whole text."""
    d = read(spark, sf, "documents").join(read(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return d.select("doc_id", md.search_text(F.expr("case when toxic = 0 then 'S0' else '' end"), F.col("source"), F.lit(""), F.col("text")).alias("t"))


@query()
def table_quantities(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.expr("concat('VDD | 1.', p_size, ' | - | ', p_size, ' | mV\n| Name | Min (V) | Max (ns) |\n|--|--|--|\n| x | ', p_size, ' | ', p_partkey % 9, ' |')").alias("t"))
    return p.select("p_partkey", F.explode(un.table_quantities("t")).alias("q")).select("p_partkey", "q.number", "q.unit", "q.base", F.element_at("q.values", 1).alias("value"))


@query("SELECT l_orderkey, l_linenumber, (l_quantity::INT * 3 + sqrt(16)) / 2 - pow(2, l_linenumber) AS value FROM lineitem")
def calculations(spark, sf):
    e = F.expr("concat('(', int(l_quantity), ' × 3 + sqrt(16)) / 2 - 2^', l_linenumber)")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", calc.calculate(e).alias("value"))


@query("""WITH li AS (SELECT l_orderkey, l_linenumber AS n, l_quantity::INT AS q FROM lineitem), f AS (SELECT l_orderkey, arg_min(q, (n, q)) AS q0 FROM li GROUP BY l_orderkey)
SELECT f.l_orderkey, q0::VARCHAR AS value, string_agg(n::VARCHAR, ',' ORDER BY n, q) AS sources, false AS traced FROM f JOIN li ON li.l_orderkey = f.l_orderkey AND li.q = f.q0 WHERE q0 > 16 GROUP BY f.l_orderkey, q0
UNION ALL SELECT l_orderkey, '77.5', '', false FROM f""")
def calculation_trace(spark, sf):
    """Numbers of a calculation, and the line of the order in which each stands."""
    li = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q"), calc.stated_values(F.expr("concat(int(l_quantity), ' ns')")).alias("values"))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", "q", "values"))).alias("src"))
    g = g.withColumn("asked", calc.number_literals(F.concat(F.get("src", F.lit(0))["q"], F.lit(" * 1000 + 77.5"))))
    g = g.withColumn("inputs", calc.traced(F.col("asked"), F.col("src"))).withColumn("traced", calc.all_traced(F.col("inputs")))
    each = g.select("l_orderkey", F.explode("inputs").alias("i"), "traced")
    return each.select("l_orderkey", "i.value", F.array_join(F.transform("i.sources", lambda n: n.cast("string")), ",").alias("sources"), "traced")


@query("""SELECT event_id, props AS found FROM events""")
def json_salvage(spark, sf):
    raw = F.concat(F.lit("<think>{x}</think>Sure: ```json\n{broken "), F.col("props"), F.lit("\n``` done"))
    return read(spark, sf, "events").select("event_id", calc.salvage_json(raw).alias("found"))


@query()
def judge_excerpts(spark, sf):
    @F.pandas_udf("string")
    def cut(text: pd.Series, claim: pd.Series) -> pd.Series:
        return pd.Series([calc.excerpt(t or "", c or "", 400) for t, c in zip(text, claim, strict=True)])

    return read(spark, sf, "documents").select("doc_id", cut("text", F.substring("text", -80, 80)).alias("excerpt"))


@query()
def bm25_stemmed(spark, sf):
    """Rows only: Porter's stems on both sides."""
    d = spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", calc.stem_words("text").alias("text"))
    q = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(F.filter(tx.terms(calc.stem_words("text")), lambda t: F.length(t) >= 2)).alias("terms"))
    return s.bm25(d, "doc_id", {"text": 1.0}, q, 10)


def _words(spark, sf):
    """Printed words of made-up pages: a head, and a row for each line of an order."""
    li = read(spark, sf, "lineitem")
    li = li.withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    row = li.select("l_orderkey", "k", F.explode(F.array(*[F.struct(F.lit(float(x)).alias("x0"), (F.col("k") * 20.0).alias("y0"), F.lit(float(x + 40)).alias("x1"), (F.col("k") * 20.0 + 10).alias("y1"), t.alias("text")) for x, t in ((10, F.concat(F.lit("tR"), F.col("k").cast("string"))), (100, F.col("l_quantity").cast("int").cast("string")), (200, F.expr("string(l_linenumber * 100)")), (300, F.lit("ns")))])).alias("w"))
    heads = li.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.array(*[F.struct(F.lit(float(x)).alias("x0"), F.lit(0.0).alias("y0"), F.lit(float(x + 40)).alias("x1"), F.lit(10.0).alias("y1"), F.lit(t).alias("text")) for x, t in ((10, "Symbol"), (100, "Min"), (200, "Max"), (300, "Unit"))])).alias("w"))
    return li, row.select("l_orderkey", "w.*").unionByName(heads.select("l_orderkey", "w.*")).withColumnRenamed("l_orderkey", "doc_id").withColumn("page", F.lit(1))


@query("""WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem)
SELECT l_orderkey AS table_id, CASE WHEN k % 5 = 0 THEN 'conflict' WHEN k % 7 = 0 THEN 'not_found' WHEN k % 3 = 0 AND l_linenumber * 100 = 300 THEN 'ambiguous' ELSE 'grounded' END AS status, count(*) AS n FROM li GROUP BY ALL""")
def ground_cells(spark, sf):
    """Cells of extracted tables against the page's words: one in five has the value of another column, one in seven no row, and
    some values stand twice in their row, the second time under a second head."""
    li, w = _words(spark, sf)
    twice = li.where("k % 3 = 0 and l_linenumber * 100 = 300").select(F.col("l_orderkey").alias("doc_id"), F.lit(400.0).alias("x0"), (F.col("k") * 20.0).alias("y0"), F.lit(440.0).alias("x1"), (F.col("k") * 20.0 + 10).alias("y1"), F.lit("300").alias("text"), F.lit(1).alias("page"))
    second = li.select("l_orderkey").distinct().select(F.col("l_orderkey").alias("doc_id"), F.lit(400.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(440.0).alias("x1"), F.lit(10.0).alias("y1"), F.lit("Max").alias("text"), F.lit(1).alias("page"))
    words = w.unionByName(twice).unionByName(second).withColumn("raised", F.lit(False))
    value = F.expr("case when k % 5 = 0 then string(int(l_quantity)) else string(l_linenumber * 100) end")
    cells = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("k").alias("value_id"), value.alias("value"), F.expr("array(case when k % 7 = 0 and k % 5 <> 0 then 'absent' else concat('tR', k) end)").alias("labels"), F.array(F.lit("Max")).alias("heads"), F.array().cast("array<string>").alias("groups"))
    return pg.ground_values(cells, words).groupBy(F.col("doc_id").alias("table_id"), "status").agg(F.count("*").alias("n"))


@query("""WITH li AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey AS doc_id, CASE WHEN l_orderkey % 2 = 0 THEN 'ok' ELSE 'mismatch' END AS unit, 1 AS wrapped, CASE WHEN l_orderkey % 3 = 0 THEN 'not_found' ELSE 'found' END AS place FROM li""")
def page_checks(spark, sf):
    """Of each page: the unit of its first row, its label's places, and where its head is printed, a word aside."""
    w = _words(spark, sf)[1]
    page = dealt(w, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "x1", "y1", "text"))).alias("w"))
    said = F.expr("case when doc_id % 3 = 0 then 'nothing of this stands here' else 'Symbol Min Max Units tR1' end")
    c = gr.page_checks("w", F.expr("case when doc_id % 2 = 0 then 'ns' else 'mV' end"), F.lit("tR1"), F.lit("Max"), said)
    return page.select("doc_id", c.alias("c")).select("doc_id", "c.*")


@query("""WITH li AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey AS doc_id, 1 AS page, n + 1 AS rows FROM li WHERE n + 1 >= 3""")
def aligned_rows(spark, sf):
    return gr.aligned_rows(_words(spark, sf)[1])


@query("""WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem)
SELECT l_orderkey AS doc_id, 'tR' || k || ' ' || l_quantity::INT || ' ' || (l_linenumber * 100) || ' ns' AS text FROM li UNION ALL SELECT DISTINCT l_orderkey, 'Symbol Min Max Unit' FROM li""")
def visual_lines(spark, sf):
    return gr.visual_lines(_words(spark, sf)[1]).select("doc_id", "text")


_READ = "'p' || l_partkey % 40 || ' s' || l_suppkey % 9 || ' q' || l_quantity::INT || ' d' || (l_discount * 100)::INT"
_PRINTED = "CASE WHEN l_tax > 0.06 THEN 'x y' WHEN l_tax > 0.03 THEN 'p' || l_partkey % 40 || ' z' ELSE 'p' || l_partkey % 40 || ' s' || l_suppkey % 9 END || ' q' || l_quantity::INT || ' d' || (l_discount * 100)::INT"


@query(f"""WITH RECURSIVE l AS MATERIALIZED (SELECT l_orderkey AS o, l_linenumber AS n, string_split({_READ}, ' ') AS r, string_split({_PRINTED}, ' ') AS p FROM {_ONE}),
 s AS MATERIALIZED (SELECT a.o, a.n AS a, b.n AS b, round(len(list_intersect(a.r, b.p)) / len(list_distinct(a.r || b.p))::DOUBLE, 6) AS score FROM l a JOIN l b USING (o)),
 g AS MATERIALIZED (SELECT o, list(a ORDER BY a) AS tables FROM (SELECT DISTINCT o, a FROM s) GROUP BY o),
 f(o, k, taken, a, b, score) AS (SELECT o, 0, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE FROM g
  UNION ALL SELECT o, k + 1, CASE WHEN b IS NULL THEN taken ELSE list_append(taken, b) END, a, b, score FROM (
   SELECT f.o, f.k, f.taken, g.tables[f.k + 1] AS a, c.hit.b AS b, c.hit.score AS score FROM f JOIN g USING (o), LATERAL (
    SELECT CASE WHEN m[1].score >= 0.5 AND (len(m) = 1 OR m[2].score < m[1].score - 0.15) THEN m[1] END AS hit FROM (SELECT list({{'score': s.score, 'b': s.b}} ORDER BY s.score DESC, s.b) AS m FROM s WHERE s.o = f.o AND s.a = g.tables[f.k + 1] AND NOT list_contains(f.taken, s.b))) c WHERE f.k < len(g.tables)))
SELECT o AS doc_id, a, b, score FROM f WHERE b IS NOT NULL""")
def table_match(spark, sf):
    """Each line of an order as a table that a model read, and as the page prints it, some of its words changed."""
    li = _lines(spark, sf).withColumnRenamed("l_orderkey", "doc_id").withColumn("page", F.lit(1)).withColumn("box", F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>"))
    p, tail = "concat('p', l_partkey % 40)", "concat(' q', int(l_quantity), ' d', cast(l_discount * 100 as decimal(9,0)))"
    read_ = li.select("doc_id", "page", F.col("l_linenumber").cast("long").alias("a"), F.expr(f"concat({p}, ' s', l_suppkey % 9, {tail})").alias("text"), "box", F.lit(None).cast("string").alias("ref"))
    printed = li.select("doc_id", "page", F.col("l_linenumber").cast("long").alias("b"), F.expr(f"concat(case when l_tax > 0.06 then 'x y' when l_tax > 0.03 then concat({p}, ' z') else concat({p}, ' s', l_suppkey % 9) end, {tail})").alias("text"), "box", F.lit("").alias("before"))
    return rc.claim_once(rc.table_scores(read_, printed)).select("doc_id", "a", "b", "score")


@query("SELECT p_partkey, round(greatest(0, least(p_size + 10, 30) - greatest(p_size, 20))::DOUBLE * 5, 4) AS area FROM part")
def rect_overlap(spark, sf):
    box = lambda a, b, c, d: F.struct(*[x.cast("double").alias(n) for x, n in zip((a, b, c, d), ("x0", "y0", "x1", "y1"), strict=True)])
    p = F.col("p_size")
    return read(spark, sf, "part").select("p_partkey", F.round(gr.overlap_area(box(p, F.lit(0), p + 10, F.lit(10)), box(F.lit(20), F.lit(5), F.lit(30), F.lit(15))), 4).alias("area"))


@query("SELECT event_id, event_id % 3 <> 1 AS framing FROM events")
def framing_sentences(spark, sf):
    e = F.expr("case event_id % 3 when 0 then 'Sure, here it is:' when 1 then concat('The delay is ', event_id + 10, ' ns here.') else 'Hello there friends' end")
    return read(spark, sf, "events").select("event_id", st.framing(e).alias("framing"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'conflict' WHEN 2 THEN 'conflict' ELSE 'absent' END AS verdict FROM lineitem")
def judge_facts(spark, sf):
    """A value in another unit is right; a negated one and another one conflict; another parameter's doesn't count."""
    li = read(spark, sf, "lineitem")
    said = F.expr("case l_linenumber % 4 when 0 then concat('tRFC is ', int(l_quantity) * 1000, ' ps [1].') when 1 then concat('tRFC is not ', int(l_quantity), ' ns.') when 2 then concat('tRFC is ', int(l_quantity) + 500, ' ns.') else concat('tXX is ', int(l_quantity), ' ns.') end")
    return li.select("l_orderkey", "l_linenumber", st.judge_fact(said, F.array(F.lit("tRFC")), F.col("l_quantity").cast("int").cast("string"), F.lit("ns")).alias("verdict"))
