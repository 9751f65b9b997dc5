"""Queries of scopes: customers stand for questions, parts for documents in folders of ten and domains of thirty."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.catalog import query, read
from quillstone.operators import scopes, tools
from quillstone.session import written

_DOCS = """SELECT p_partkey AS doc_id, 'b' || p_partkey // 10 AS bucket, 'd' || p_partkey // 30 AS domain, ['S' || p_size || '-' || p_partkey // 30, p_type] AS entities,
 'i' || p_partkey // 3 AS identity, CASE WHEN p_size % 4 = 0 THEN 'note' ELSE 'base' END AS doc_type, p_size % 3 = 0 AS superseded, p_size % 7 = 0 AS missing FROM part"""
_ASKS = """SELECT c_custkey AS ask, CASE WHEN m = 0 THEN ['b' || k // 10, 'b' || (k // 10 + 1)] ELSE [] END AS buckets, CASE m WHEN 0 THEN [k + 50, k + 51] WHEN 1 THEN [k, k + 1, k + 2] WHEN 7 THEN [k, k] ELSE [] END AS doc_ids,
 CASE WHEN m = 2 THEN ['d' || k // 30] ELSE [] END AS domains, CASE WHEN m = 3 OR c_nationkey % 3 = 0 THEN ['s' || (k % 40 + 1) || '-' || k // 30, 'S' || (k % 7 + 3) || '-' || k // 30] ELSE [] END AS entities,
 CASE m WHEN 4 THEN ['d' || k // 30] WHEN 5 THEN ['none'] ELSE [] END AS routed, CASE WHEN k % 16 < 8 THEN [k] ELSE [] END AS revisions, m FROM (SELECT *, c_custkey AS k, c_custkey % 8 AS m FROM customer)"""

#: All questions against all documents, rule by rule.
_ALL = f"""d AS ({_DOCS}), a AS ({_ASKS}), pin AS (SELECT ask, identity FROM (SELECT ask, unnest(revisions) AS doc_id FROM a) JOIN d USING (doc_id)),
 x AS (SELECT a.*, d.*  EXCLUDE (entities, domain, bucket), d.entities AS tags, bucket, domain, NOT missing AND (list_contains(revisions, doc_id) OR (NOT (doc_type = 'base' AND EXISTS (SELECT 1 FROM pin WHERE pin.ask = a.ask AND pin.identity = d.identity)) AND NOT superseded)) AS ok,
   list_filter(a.entities, lambda e: list_contains(list_transform(d.entities, lambda t: lower(t)), lower(e))) AS hit FROM a, d),
 pool AS (SELECT ask, doc_id, hit FROM x WHERE CASE m WHEN 0 THEN ok AND list_contains(buckets, bucket) OR NOT missing AND list_contains(doc_ids, doc_id) WHEN 1 THEN NOT missing AND list_contains(doc_ids, doc_id) WHEN 7 THEN NOT missing AND list_contains(doc_ids, doc_id)
   WHEN 2 THEN ok AND list_contains(domains, domain) ELSE ok AND (len(entities) > 0 OR list_contains(routed, domain)) END AND (len(entities) = 0 OR len(hit) > 0)),
 g AS (SELECT ask, count(*) FILTER (missing AND list_contains(doc_ids, doc_id)) AS skipped FROM x GROUP BY ask),
 n AS (SELECT ask, count(*) AS n, list_distinct(flatten(list(hit))) AS found FROM pool GROUP BY ask)"""


def _tables(spark, sf):
    d = read(spark, sf, "part").selectExpr(
        "p_partkey as doc_id", "concat('b', p_partkey div 10) as bucket", "concat('d', p_partkey div 30) as domain", "array(concat('S', p_size, '-', p_partkey div 30), p_type) as entities",
        "concat('i', p_partkey div 3) as identity", "case when p_size % 4 = 0 then 'note' else 'base' end as doc_type", "p_size % 3 = 0 as superseded", "p_size % 7 = 0 as missing",
    )
    c = read(spark, sf, "customer").withColumn("k", F.col("c_custkey")).withColumn("m", F.col("k") % 8)
    a = c.selectExpr(
        "k as ask", "case when m = 0 then array(concat('b', k div 10), concat('b', k div 10 + 1)) else array() end as buckets", "case when m = 0 then array(k + 50, k + 51) when m = 1 then array(k, k + 1, k + 2) when m = 7 then array(k, k) end as doc_ids",
        "case when m = 2 then array(concat('d', k div 30)) end as domains", "case when m = 3 or c_nationkey % 3 = 0 then array(concat('s', k % 40 + 1, '-', k div 30), concat('S', k % 7 + 3, '-', k div 30)) end as entities",
        "case when m = 4 then array(concat('d', k div 30)) when m = 5 then array('none') end as routed", "case when k % 16 < 8 then array(k) end as revisions",
    )
    return a, d


@query(f"""WITH {_ALL}, r AS (SELECT a.*, skipped, coalesce(n.n, 0) AS n, coalesce(found, []) AS hits, len(entities) > 0 AS named, len(doc_ids) > 0 AND m <> 0 AND skipped = len(list_distinct(doc_ids)) AS emptied FROM a JOIN g USING (ask) LEFT JOIN n USING (ask)),
 s AS (SELECT *, CASE WHEN m IN (4, 5, 6) AND NOT named AND (m <> 4 OR n = 0) THEN 'all' WHEN m = 4 AND NOT named THEN 'domain' WHEN emptied THEN 'user' WHEN named AND n > 0 THEN 'entity' WHEN named THEN 'entity_missing' ELSE 'user' END AS reason FROM r)
SELECT ask, reason, CASE WHEN emptied THEN '' ELSE array_to_string(list_filter(entities, lambda e: list_contains(hits, e)), ',') END AS found, CASE WHEN emptied THEN '' ELSE array_to_string(list_filter(entities, lambda e: NOT list_contains(hits, e)), ',') END AS absent,
 skipped, CASE WHEN reason <> 'all' THEN n END AS n_docs FROM s""")
def scope_reasons(spark, sf):
    out = scopes.resolve(*_tables(spark, sf))[0]
    return out.select("ask", "reason", F.array_join("found", ",").alias("found"), F.array_join("absent", ",").alias("absent"), "skipped", "n_docs")


@query(f"WITH {_ALL} SELECT ask, doc_id FROM pool")
def scope_members(spark, sf):
    return scopes.resolve(*_tables(spark, sf))[1]


@query(f"WITH {_ALL} SELECT ask, doc_id, ok AS used FROM x WHERE ok <> (NOT missing AND NOT superseded)")
def scope_exceptions(spark, sf):
    """What the named revisions change about the current documents, for each question."""
    a, d = _tables(spark, sf)
    return scopes.whole(a, d)


#: Orders stand for calls of tools, lines for rows that tools find.
_CALLS = """c AS (SELECT o_orderkey AS call, o_custkey AS ask, ['air', 's' || o_custkey] AS terms,
 CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 's' || (o_custkey % 7 + 3) || '-' || o_custkey // 30 WHEN 2 THEN 'Standard Polished Tin' ELSE 'unheard of' END AS tag FROM orders)"""
_REASONS = f"""{_ALL}, r AS (SELECT a.*, skipped, coalesce(n.n, 0) AS n, coalesce(found, []) AS hits, len(entities) > 0 AS named, len(doc_ids) > 0 AND m <> 0 AND skipped = len(list_distinct(doc_ids)) AS emptied FROM a JOIN g USING (ask) LEFT JOIN n USING (ask)),
 s AS (SELECT *, CASE WHEN m IN (4, 5, 6) AND NOT named AND (m <> 4 OR n = 0) THEN 'all' WHEN m = 4 AND NOT named THEN 'domain' WHEN emptied THEN 'user' WHEN named AND n > 0 THEN 'entity' WHEN named THEN 'entity_missing' ELSE 'user' END AS reason FROM r), {_CALLS},
 t AS (SELECT DISTINCT doc_id, lower(unnest(entities)) AS tag FROM d),
 free AS (SELECT ask, x.doc_id, t.tag FROM x JOIN t USING (doc_id) WHERE x.ok),
 mem AS (SELECT call, pool.doc_id FROM c JOIN s USING (ask) JOIN pool USING (ask) WHERE reason <> 'all' AND (c.tag = '' OR (EXISTS (SELECT 1 FROM t WHERE t.doc_id = pool.doc_id AND t.tag = lower(c.tag))
     AND (reason NOT IN ('entity', 'entity_missing') OR list_contains(list_transform(hits, lambda e: lower(e)), lower(c.tag)))))
   UNION ALL SELECT call, doc_id FROM c JOIN s USING (ask) JOIN free ON free.ask = c.ask AND free.tag = lower(c.tag) WHERE reason = 'all'),
 k AS (SELECT call, count(*) AS n FROM mem GROUP BY call),
 o AS (SELECT call, CASE WHEN reason IS NULL THEN 'no_question' WHEN k.n > 0 THEN NULL WHEN c.tag = '' THEN CASE WHEN reason <> 'all' THEN 'empty' END WHEN reason = 'user' THEN 'not_selected' WHEN reason IN ('entity', 'entity_missing') THEN 'outside'
   WHEN reason <> 'all' AND lower(c.tag) IN (SELECT t.tag FROM t JOIN d USING (doc_id) WHERE NOT missing AND NOT superseded) THEN 'outside' ELSE 'not_loaded' END AS note,
   CASE WHEN reason = 'all' AND c.tag = '' THEN NULL ELSE coalesce(k.n, 0) END AS n_docs FROM c LEFT JOIN s USING (ask) LEFT JOIN k USING (call))"""


def _calls(spark, sf):
    tag = "case o_orderkey % 4 when 0 then '' when 1 then concat('s', o_custkey % 7 + 3, '-', o_custkey div 30) when 2 then 'Standard Polished Tin' else 'unheard of' end"
    calls = read(spark, sf, "orders").selectExpr("o_orderkey as call", "o_custkey as ask", "array('air', concat('s', o_custkey)) as terms", f"{tag} as tag")
    return calls, *tools.scoped(calls, *_tables(spark, sf))


@query(f"WITH {_REASONS} SELECT call, note, n_docs FROM o")
def tool_scopes(spark, sf):
    """What each call may use, or why it may use nothing."""
    return _calls(spark, sf)[1]


_LINES = "SELECT l_orderkey * 10 + l_linenumber AS row_id, l_partkey AS doc_id, [CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN 'air' ELSE 'other' END, 's' || l_suppkey] AS terms, l_returnflag <> 'A' AS verified FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_linestatus) AS l_linestatus, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)"


@query(f"""WITH {_REASONS}, l AS ({_LINES}), u AS (SELECT call, row_id, verified, len(list_intersect(c.terms, l.terms)) AS score FROM c JOIN mem USING (call) JOIN l USING (doc_id)
  UNION ALL SELECT call, row_id, verified, count(*) AS score FROM (SELECT call, unnest(terms) AS term FROM c JOIN o USING (call) WHERE note IS NULL AND n_docs IS NULL) JOIN (SELECT row_id, verified, unnest(terms) AS term FROM l) USING (term) GROUP BY ALL),
 f AS (SELECT call, row_id, score, row_number() OVER (PARTITION BY call ORDER BY score DESC, row_id) AS rank FROM u WHERE verified AND score > 0)
SELECT call, row_id, score, rank FROM f WHERE rank <= 10""")
def tool_rows(spark, sf):
    """Verified rows for each call."""
    calls, outcomes, members, tagged = _calls(spark, sf)
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_linestatus", "l_returnflag")])  # numbers repeat
    given = lines.selectExpr("l_orderkey * 10 + l_linenumber as row_id", "l_partkey as doc_id", "array(if(l_linestatus = 'O' and l_linenumber = 1, 'air', 'other'), concat('s', l_suppkey)) as terms", "l_returnflag <> 'A' as verified")
    return tools.rows(calls.select("call", "terms"), written(given, "lines"), written(outcomes, "outcomes"), members, tagged=tagged)[0]
