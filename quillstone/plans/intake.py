"""Queries of intake, scopes, evidence, rendering and conditions, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.catalog import query, read
from quillstone.functions import conditions as cd
from quillstone.functions import text as tx
from quillstone.operators import evidence as ev
from quillstone.operators import ingest as ing
from quillstone.operators import library as lib
from quillstone.operators import render as rd
from quillstone.operators import search as s
from quillstone.operators import verify
from quillstone.plans.adapters import CHUNKS, chunks
from quillstone.plans.answers import _ONE, _lines
from quillstone.plans.library import _SNAP, _snapshots
from quillstone.plans.search import _STOP, _TERMS, _bm25_sql, _index, _questions


@query("SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 10 = 0")
def replace_documents(spark, sf):
    """Rows of the incoming keys are replaced as a whole: half of them come back with another price, the rest not at all."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    keys = o.where("o_orderkey % 5 = 0 and o_orderkey % 10 <> 0")
    kept = o.join(keys.select("o_orderkey"), "o_orderkey", "left_anti")
    return ing.replace_rows(kept, o.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), "o_orderkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 6 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part")
def bulk_update(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    new = p.where("p_partkey % 3 = 0").select("p_partkey", F.lit("new").alias("p_brand"), F.when(F.col("p_partkey") % 6 == 0, F.col("p_size") + 1).alias("p_size"))
    return ing.bulk_update(p, new, "p_partkey")


@query("SELECT p_partkey, p_size >= 25 AND p_partkey % 4 = 0 AS verified, '' AS grounding, 0 AS pages FROM part")
def migrate_rows(spark, sf):
    """Rows of older formats (p_size stands for the format's number) lose their mark; new columns take defaults."""
    p = read(spark, sf, "part").selectExpr("p_partkey", "p_size", "p_partkey % 4 = 0 as verified")
    return ing.migrate(p, {"grounding": "", "pages": 0, "verified": False}, F.col("p_size"), 25).select("p_partkey", "verified", "grounding", "pages")


_APPLIED = f"""{_SNAP}, a AS (SELECT coalesce(p.rel, d.rel) AS rel, d.doc_id, p.action, d.missing, d.size AS dsize, d.mtime AS dmtime, f.size AS fsize, f.mtime AS fmtime
  FROM docs d FULL JOIN (SELECT rel, action, CASE WHEN action = 'moved' THEN from_doc ELSE doc_id END AS doc FROM p) p ON p.doc = d.doc_id LEFT JOIN files f ON f.rel = p.rel)"""


@query(f"""WITH {_APPLIED} SELECT doc_id, rel, CASE WHEN action IN ('moved', 'touched', 'restored', 'new', 'duplicate') THEN fsize ELSE dsize END AS size, CASE WHEN action IN ('moved', 'touched', 'restored', 'new', 'duplicate') THEN fmtime ELSE dmtime END::BIGINT AS mtime,
 coalesce(action = 'missing', false) OR (coalesce(action IN ('unchanged', 'settings', 'unreachable'), true) AND coalesce(missing, false)) AS missing, CASE WHEN action IN ('new', 'changed', 'settings', 'duplicate') THEN action END AS todo FROM a""")
def apply_change_plan(spark, sf):
    files, docs = _snapshots(spark, sf)
    return ing.apply_plan(docs, lib.change_plan(files, docs, "fp"), files)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def purge_missing(spark, sf):
    docs = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderstatus") == "P").alias("missing"))
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber")
    return ing.purge_missing(docs, rows)[1].select(F.col("doc_id").alias("l_orderkey"), "l_linenumber")


@query("SELECT d.doc_id, d.doc_id % 3 = 0 OR e.vec_id IS NULL AS todo, CASE WHEN d.doc_id % 3 <> 0 THEN round(e.embedding[1]::DOUBLE, 6) END AS first FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def reuse_embeddings(spark, sf):
    """A document in three has changed; the others take their old vector, where they have one."""
    d = read(spark, sf, "documents").select("doc_id", F.lit(0).alias("ordinal"), F.col("source").alias("section"), F.lit("text").alias("kind"), "text")
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    now = d.withColumn("text", F.expr("case when doc_id % 3 = 0 then concat(text, 'x') else text end"))
    out = ing.reuse_embeddings(now, d.join(e, "doc_id"))
    return out.select("doc_id", F.col("embedding").isNull().alias("todo"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_orderkey % 2 = 0)")
def table_cache_miss(spark, sf):
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return ing.not_cached(li.select("l_partkey", "l_suppkey").distinct(), li.where("l_orderkey % 2 = 0"), ["l_partkey", "l_suppkey"])


_WORDS = ing.dictionary("""
domains:
  memory: {name: Memory, folders: [web, DDR], patterns: [tha], entities: [{id: DDR4, patterns: [ande]}, {id: DDR5, patterns: [ther]}]}
  links: {name: Links, patterns: [onth], glossary: {TX: transmitter, link: a connection}}
terms: {gerilim: voltage, saat: clock, tip: type}
""")


@query("""WITH d AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN source || '/' || doc_id || '.txt' WHEN 1 THEN 'tha_' || doc_id || '.txt' ELSE doc_id || '.txt' END AS path FROM documents),
 c AS (SELECT *, len(regexp_extract_all(text, '(?i)tha')) + len(regexp_extract_all(text, '(?i)ande')) + len(regexp_extract_all(text, '(?i)ther')) AS m, len(regexp_extract_all(text, '(?i)onth')) AS l FROM d)
SELECT doc_id, CASE WHEN path LIKE 'web/%' THEN 'memory' WHEN contains(path, '/') THEN regexp_replace(lower(string_split(path, '/')[1]), '[^a-z0-9_-]+', '_', 'g') WHEN path LIKE 'tha%' THEN 'memory' WHEN m >= l AND m >= 3 THEN 'memory' WHEN l > m AND l >= 3 THEN 'links' ELSE 'general' END AS domain FROM c""")
def classify_documents(spark, sf):
    path = F.expr("case doc_id % 3 when 0 then concat(source, '/', doc_id, '.txt') when 1 then concat('tha_', doc_id, '.txt') else concat(doc_id, '.txt') end")
    return read(spark, sf, "documents").select("doc_id", ing.classify(path, F.col("text"), _WORDS).alias("domain"))


@query("""WITH c AS (SELECT doc_id, doc_id % 5 = 0 AS named, len(regexp_extract_all(text, '(?i)ande')) AS a, len(regexp_extract_all(text, '(?i)ther')) AS b FROM documents)
SELECT doc_id, CASE WHEN named THEN 'DDR4' ELSE array_to_string(list_filter(CASE WHEN a >= b THEN [CASE WHEN a >= 2 THEN 'DDR4' END, CASE WHEN b >= 2 AND b >= 0.6 * a THEN 'DDR5' END] ELSE [CASE WHEN b >= 2 THEN 'DDR5' END, CASE WHEN a >= 2 AND a >= 0.6 * b THEN 'DDR4' END] END, lambda x: x IS NOT NULL), ',') END AS entities FROM c""")
def entity_tags(spark, sf):
    """What a name says counts before what the text says."""
    head = F.expr("case when doc_id % 5 = 0 then 'ande standard' else 'none' end")
    return read(spark, sf, "documents").select("doc_id", F.array_join(ing.entities_of(head, F.col("text"), _WORDS), ",").alias("entities"))


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 4 = 0 THEN 'voltage' END, CASE WHEN c_custkey % 4 IN (1, 3) THEN 'type' END, CASE WHEN c_custkey % 3 = 0 THEN 'TX transmitter' END, CASE WHEN c_custkey % 3 = 1 THEN 'link a connection' END], lambda x: x IS NOT NULL), '|') AS terms,
 array_to_string(list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'TX = transmitter' END, CASE WHEN c_custkey % 3 = 1 THEN 'link = a connection' END], lambda x: x IS NOT NULL), '|') AS hints FROM customer""")
def expand_terms(spark, sf):
    """Words with endings and softened consonants, in any case; acronyms as whole words, short ones as written."""
    q = F.expr("concat(case c_custkey % 4 when 0 then 'GERİLİMİN' when 1 then 'tibi' when 2 then 'tiphane saatlik' else 'Tip' end, ' ', case c_custkey % 3 when 0 then '(TX)' when 1 then 'LINK.' else 'tx linker' end)")
    return read(spark, sf, "customer").select("c_custkey", F.array_join(ing.expansions(q, _WORDS), "|").alias("terms"), F.array_join(ing.hints(q, _WORDS), "|").alias("hints")).withColumn("terms", F.regexp_replace("terms", "clock[|]?", ""))


@query("""SELECT c_custkey AS query_id, s_suppkey AS doc_id FROM customer JOIN supplier ON c_custkey % 7 = s_suppkey % 7 AND chr((65 + s_suppkey % 3)::INT) = chr((65 + c_custkey % 3)::INT)""")
def revision_scope(spark, sf):
    """'DDR1 rev B vs DDR9 ...' names DDR1's revision B only: a separator ends what is said of a standard."""
    q = read(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), F.expr("concat('Is DDR', c_custkey % 7, ' Revision ', char(int(65 + c_custkey % 3)), ' like DDR', (c_custkey + 1) % 7, ' or, as before, rev D?')").alias("text"))
    d = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.expr("char(int(65 + s_suppkey % 3))").alias("revision"), F.array(F.expr("concat('DDR', s_suppkey % 7)")).alias("entities"))
    return ev.revision_mentions(q, d)


_NARROW = _bm25_sql({"text": 1.0}, 5, "JOIN documents d ON d.doc_id = p.doc_id AND d.lang = 'en' AND d.source = 'forum' AND p.doc_id % 9 = 0", "query_id, doc_id, rank")
_WIDE = _bm25_sql({"text": 1.0}, 5, columns="query_id, doc_id, rank")


@query(f"""WITH h AS ({_NARROW}), w AS ({_WIDE}) SELECT query_id, doc_id, rank, false AS widened FROM h UNION ALL SELECT query_id, doc_id, rank, true FROM w WHERE query_id NOT IN (SELECT query_id FROM h)""")
def widened_search(spark, sf):
    """Questions that find nothing in the collection that was guessed for them search the whole library."""
    q, index = _questions(spark, sf), _index(spark, sf)
    scope = read(spark, sf, "documents").where("lang = 'en' and source = 'forum' and doc_id % 9 = 0").select("doc_id")
    hits, wide = (s.bm25(index, "doc_id", {"text": 1.0}, q, 5, x).select("query_id", "doc_id", "rank") for x in (scope, None))
    return ev.widen(q, hits, wide)


_HELD = f"""{CHUNKS}, c AS (SELECT doc_id, ordinal, page_start, page_end, ordinal % 3 <> 1 AS evidence FROM chunks), h AS (SELECT doc_id % 5 AS query_id, doc_id, ordinal, page_start, evidence, ordinal AS rank FROM c WHERE (doc_id + ordinal) % 4 = 0)"""


@query(f"""WITH {_HELD}, o AS (SELECT query_id, doc_id, ordinal, rank, false AS replaced FROM h WHERE evidence UNION ALL SELECT h.query_id, h.doc_id, c.ordinal, h.rank, true FROM h JOIN c ON c.doc_id = h.doc_id AND c.evidence AND c.page_start <= h.page_start AND c.page_end >= h.page_start WHERE NOT h.evidence)
SELECT query_id, doc_id, ordinal, arg_min(replaced, (rank, replaced)) AS replaced FROM o GROUP BY ALL""")
def evidence_pages(spark, sf):
    c = chunks(spark, sf).select("doc_id", "ordinal", "page_start", "page_end", (F.col("ordinal") % 3 != 1).alias("evidence"))
    hits = c.where("(doc_id + ordinal) % 4 = 0").select((F.col("doc_id") % 5).alias("query_id"), "doc_id", "ordinal", "page_start", "evidence", F.col("ordinal").alias("rank"))
    return ev.evidence_pages(hits, c)


_LINE_TOKENS = r"greatest(length(line)//4, floor(len(regexp_extract_all(line, '\S+'))*1.3))::BIGINT"


@query(rf"""WITH l AS (SELECT doc_id, no, line, {_LINE_TOKENS} + 1 AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM documents)),
 u AS (SELECT *, sum(t) OVER (PARTITION BY doc_id ORDER BY no) AS used FROM l), k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS text FROM u WHERE used <= 60 OR no = 1 GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN greatest(length(d.text)//4, floor(len(regexp_extract_all(d.text, '\S+'))*1.3)) <= 60 THEN d.text ELSE k.text || chr(10) || '(...)' END AS aid FROM documents d JOIN k USING (doc_id)""")
def reading_aid(spark, sf):
    return read(spark, sf, "documents").select("doc_id", ev.cut_lines(F.col("text"), 60).alias("aid"))


@query(f"""WITH {CHUNKS}, a AS (SELECT doc_id, ordinal AS parent, (ordinal % 3 + 1) || '-2' AS label FROM chunks WHERE ordinal % 2 = 0), f AS (SELECT doc_id, label, min(parent) AS parent FROM a GROUP BY ALL),
 t AS (SELECT doc_id, ordinal, ordinal || '-2' AS label FROM chunks WHERE ordinal % 2 = 1), j AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY parent, label) AS n FROM f JOIN t USING (doc_id, label))
SELECT doc_id, label, parent, ordinal, round(0.9 * (1.0 / (1 + parent)), 6)::DOUBLE AS score FROM j WHERE n <= 3""")
def reference_follow(spark, sf):
    """Passages name tables of their own document; the chunks that have the captions come after them, at most three for
    each document, for 0.9 of the passage's score."""
    c = chunks(spark, sf).select("doc_id", "ordinal", F.expr("concat(text, '\nsee Table ', ordinal % 3 + 1, '-2 and\nTable ', ordinal, '-2 Limits')").alias("text"))
    named = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?i)see\s+(?:table|tablo)\s+([A-Z]?\d+(?:[.\-–]\d+)*)"), F.lit(1))))
    have = c.where("ordinal % 2 = 0")
    asked = have.select("doc_id", F.col("ordinal").alias("parent"), named.alias("label"), (1.0 / (1 + F.col("ordinal"))).alias("score"))
    heads = F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:Table|Tablo)\s+([A-Z]?\d+(?:[.\-–]\d+)*)\s+[A-Z]"), F.lit(1)))
    targets = c.select("doc_id", "ordinal", tx.estimate_tokens(F.col("text")).alias("tokens"), heads.alias("label"))
    return ev.follow(asked, targets, have)


_PARAMETER_FIELDS = {"p_name": 3.0, "p_brand": 3.0, "p_type": 1.0, "cond": 0.5, "section": 1.0, "unit": 0.5, "note": 0.3}
_PARAMETERS = "SELECT p_partkey, p_name, p_brand, p_type, 'size ' || p_size AS cond, p_type || ' limits' AS section, CASE WHEN p_size % 2 = 0 THEN 'ns' ELSE 'mv' END AS unit, 'of ' || p_name AS note, p_size, p_partkey % 10 AS doc_id FROM part"


def _parameter_sql() -> str:
    fields = " UNION ALL ".join(f"SELECT p_partkey, unnest({_TERMS.format(c)}) AS term, {w}::DOUBLE AS w FROM prm" for c, w in _PARAMETER_FIELDS.items())
    length = " + ".join(f"len({_TERMS.format(c)})" for c in _PARAMETER_FIELDS)
    return f"""WITH prm AS ({_PARAMETERS}), asked AS (SELECT DISTINCT s_suppkey AS query_id, term FROM (SELECT s_suppkey, unnest({_TERMS.format("'ECONOMY cold size ' || (s_suppkey % 50) || ' mV widget ' || s_suppkey")}) AS term FROM supplier) WHERE length(term) >= 2 AND NOT list_contains({_STOP}, term)),
 post AS (SELECT p_partkey, term, sum(w) AS tf FROM ({fields}) GROUP BY ALL), size AS (SELECT p_partkey, {length} AS len FROM prm), stats AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean FROM size), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
 scored AS (SELECT query_id, p.p_partkey, round(sum(CASE WHEN ln((n-df+0.5)/(df+0.5)) <= 0 THEN 1e-6 ELSE ln((n-df+0.5)/(df+0.5)) END * tf * 2.2 / (tf + 1.2*(0.25 + 0.75*len/mean))), 8) AS score
  FROM asked q JOIN post p USING (term) JOIN df USING (term) JOIN size USING (p_partkey) CROSS JOIN stats JOIN prm USING (p_partkey) WHERE prm.p_size % 3 <> 0 AND prm.p_size % 5 <> 0 GROUP BY ALL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_partkey) AS rank FROM scored)
SELECT query_id, p_partkey, source AS title, score, rank FROM ranked JOIN prm USING (p_partkey) JOIN documents d ON d.doc_id = prm.doc_id WHERE rank <= 12"""


@query(_parameter_sql())
def parameter_search(spark, sf):
    """Seven weighted fields; verified and grounded parameters only, with their document's title. The query is the
    asked parameters, the first six keywords and the question in English."""
    p = read(spark, sf, "part").selectExpr("p_partkey", "p_name", "p_brand", "p_type", "concat('size ', p_size) as cond", "concat(p_type, ' limits') as section", "case when p_size % 2 = 0 then 'ns' else 'mv' end as unit", "concat('of ', p_name) as note", "p_size % 3 <> 0 as verified", "case when p_size % 5 <> 0 then 'grounded' else 'conflict' end as status", "p_partkey % 10 as doc_id")
    asked = F.concat_ws(" ", F.array(F.lit("ECONOMY")), F.slice(F.array(F.lit("cold"), F.lit("size"), (F.col("s_suppkey") % 50).cast("string")), 1, 6), F.concat(F.lit("mV widget "), F.col("s_suppkey").cast("string")))
    q = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("query_id"), tx.search_terms(asked).alias("terms"))
    usable = p.where("verified and status = 'grounded'").select("p_partkey")
    hits = s.bm25(p, "p_partkey", _PARAMETER_FIELDS, q, 12, usable)
    titles = read(spark, sf, "documents").select("doc_id", F.col("source").alias("title"))
    return hits.join(p.select("p_partkey", "doc_id"), "p_partkey").join(titles, "doc_id").select("query_id", "p_partkey", "title", "score", "rank")


_DECISION = "CASE l_linenumber % 3 WHEN 0 THEN 'drop' WHEN 1 THEN 'keep' ELSE 'flag' END"
_BULLETS = f"""l AS (SELECT l_orderkey AS answer_id, l_linenumber AS n, l_quantity::INT AS q, {_DECISION} AS d FROM {_ONE})"""


def _parts(spark, sf):
    """Answers: a title, a lead-in, an item for each line, a table with a row for each line, and a heading of nothing."""
    li = _lines(spark, sf, whole=True).selectExpr("l_orderkey as answer_id", "l_linenumber as n", "int(l_quantity) as q")
    none = F.lit(None)
    row = lambda line, kind, prefix, text, claim: F.struct(F.lit(line).cast("int").alias("line"), F.lit(kind).alias("kind"), F.lit(prefix).alias("prefix"), F.lit(0).alias("nth"), text.alias("text"), claim.cast("int").alias("claim_id"))
    item = lambda x: row(10 + x["n"], "text", "- ", F.concat(F.lit("item "), x["n"], F.lit(" is "), x["q"]), x["n"])
    tabled = lambda x: row(110 + x["n"], "row", "", F.concat(F.lit("| "), x["n"], F.lit(" | "), x["q"], F.lit(" |")), x["n"])
    fixed = [(0, "heading", "# Order"), (1, "text", "Values:"), (100, "blank", ""), (101, "heading", "## Table"), (102, "head", "| n | q |"), (103, "sep", "|---|---|"), (900, "heading", "## Empty")]
    each = li.groupBy("answer_id").agg(F.collect_list(F.struct("n", "q")).alias("l"))
    made = F.concat(F.transform("l", item), F.transform("l", tabled), F.array(*[row(line, kind, "", F.lit(text), none) for line, kind, text in fixed]))
    out = each.select("answer_id", F.explode(made).alias("p")).select("answer_id", "p.*")
    return out, li.select("answer_id", F.col("n").alias("claim_id"), F.expr("case n % 3 when 0 then 'drop' when 1 then 'keep' else 'flag' end").alias("decision"))


@query(f"""WITH {_BULLETS}, b AS (SELECT answer_id, string_agg('- item ' || n || ' is ' || q || CASE WHEN d = 'flag' THEN ' {rd.FLAG}' ELSE '' END, chr(10) ORDER BY n) AS items, string_agg('| ' || n || ' | ' || q || CASE WHEN d = 'flag' THEN ' {rd.FLAG} |' ELSE ' |' END, chr(10) ORDER BY n) AS rows FROM l WHERE d <> 'drop' GROUP BY answer_id)
SELECT answer_id, CASE WHEN items IS NULL THEN '' ELSE '# Order' || chr(10) || 'Values:' || chr(10) || items || chr(10) || chr(10) || '## Table' || chr(10) || '| n | q |' || chr(10) || '|---|---|' || chr(10) || rows END AS text FROM (SELECT DISTINCT answer_id FROM l) LEFT JOIN b USING (answer_id)""")
def render_answers(spark, sf):
    return rd.render(*_parts(spark, sf))


@query(f"""WITH {_BULLETS}, b AS (SELECT answer_id, string_agg('- ' || CASE WHEN n % 4 = 1 THEN 'fixed ' || n ELSE 'item ' || n || ' is ' || q END, chr(10) ORDER BY n) FILTER (n % 4 <> 2) AS items, string_agg('| ' || n || ' | ' || q || ' |', chr(10) ORDER BY n) FILTER (n % 4 <> 2) AS rows FROM l GROUP BY answer_id)
SELECT answer_id, CASE WHEN items IS NULL THEN '' ELSE '# Order' || chr(10) || 'Values:' || chr(10) || items END || CASE WHEN rows IS NULL THEN '' ELSE chr(10) || chr(10) || '## Table' || chr(10) || '| n | q |' || chr(10) || '|---|---|' || chr(10) || rows END AS text FROM b""")
def apply_corrections(spark, sf):
    """One item in four gets another text, one in four goes; rows take only what is a row."""
    parts, decided = _parts(spark, sf)
    keep = decided.withColumn("decision", F.lit("keep"))
    parts = parts.withColumn("claim_id", F.when(F.col("kind") == "row", F.col("claim_id") + 1000).otherwise(F.col("claim_id")))
    both = F.array(F.struct(F.col("claim_id").alias("claim_id"), F.lit("text").alias("kind")), F.struct((F.col("claim_id") + 1000).alias("claim_id"), F.lit("row").alias("kind")))
    every = keep.select("answer_id", F.explode(both).alias("e")).select("answer_id", "e.*")
    text = F.when(F.col("claim_id") % 1000 % 4 == 1, F.concat(F.lit(" fixed\n"), (F.col("claim_id") % 1000).cast("string"))).when(F.col("claim_id") % 1000 % 4 == 2, "")
    fixes = rd.corrections(every.select("answer_id", "claim_id", text.alias("text"), F.lit(1).alias("nth")), every)
    return rd.render(parts, every.select("answer_id", "claim_id", F.lit("keep").alias("decision")), fixes)


_CASES = "l_linenumber % 7"


@query(f"""SELECT l_orderkey AS answer_id, l_linenumber AS claim_id, ['pending', 'pending', 'unsupported', 'unverified', 'unsupported', 'pending', 'unsupported'][({_CASES} + 1)::INT] AS status,
 ['', '', 'value_not_found', 'value_unverified_extraction', 'user_value_as_documented', '', 'calc_input_unsourced'][({_CASES} + 1)::INT] AS codes, ['', 'document', '', '', 'user', 'user', 'calculation'][({_CASES} + 1)::INT] AS origins FROM {_ONE}""")
def check_units(spark, sf):
    """Values in other units than their source's; not found; in an unverified source; the user's, marked and not; of a
    calculation without sources."""
    li = _lines(spark, sf).selectExpr("l_orderkey as answer_id", "l_linenumber as n", "int(l_quantity) as q", f"{_CASES} as k")
    said = F.expr("case k when 0 then 'It holds [1].' when 2 then concat('It is ', q + 3, ' ns [', n, '].') when 5 then concat('With your value of ', q, ' ns, it holds [', n, '].') else concat('It is ', q * 1000, ' ps [', n, '].') end")
    claims = li.select("answer_id", F.col("n").alias("claim_id"), F.lit("fact").alias("kind"), said.alias("text"), F.array("n").alias("cites"))
    kind = F.expr("case when k in (4, 5) then 'user' when k = 6 then 'calc' else 'document' end")
    sources = li.select("answer_id", "n", kind.alias("kind"), (F.col("k") != 3).alias("verified"), F.lit(False).alias("traced"), F.expr("case when k = 1 then concat('| tRFC | ', q, ' | ns |') else concat('tRFC is ', q, ' ns') end").alias("text"))
    out = verify.check_values(claims, sources)
    return out.select("answer_id", "claim_id", "status", F.array_join("codes", ",").alias("codes"), F.array_join("origins", ",").alias("origins"))


@query("""SELECT p_partkey, ['speed_grade', 'density', 'temperature', 'operating_condition', 'speed_grade'][(p_partkey % 5 + 1)::INT] AS kind, p_partkey % 5 IN (0, 1) AS stated FROM part""")
def condition_kinds(spark, sf):
    """A condition's kind, and whether a question names it."""
    c = F.expr("case p_partkey % 5 when 0 then concat('DDR4-', 2400 + p_size) when 1 then concat(p_size + 1, ' Gb devices') when 2 then concat('TC ', p_size + 100, ' °C') when 3 then 'VDD only' else '3200 MT/s' end")
    q = F.expr("case p_partkey % 5 when 0 then concat('at ', 2400 + p_size, ' MT/s?') when 1 then concat('with ', p_size + 1, 'gb') when 2 then concat('at ', p_size + 300, ' °C') else 'in general' end")
    return read(spark, sf, "part").select("p_partkey", cd.kind(c).alias("kind"), cd.mentions(q, c).alias("stated"))


@query("SELECT p_partkey, 'is X at X, not ' || p_size || ' or X' AS masked FROM part")
def mask_values(spark, sf):
    t = F.expr("concat('is ', p_size + 1, ' ns at 1.2 V, not ', p_size, ' or 5 mA')")
    return read(spark, sf, "part").select("p_partkey", cd.mask_values(t).alias("masked"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'http://host:80/v1' WHEN 1 THEN 'https://h/v1' WHEN 2 THEN '' ELSE 'http://x' END AS base, CASE page_id % 4 WHEN 0 THEN 'file:/a b/c%23.db?mode=ro&immutable=1' WHEN 1 THEN 'file:////srv/x?mode=ro&immutable=1' WHEN 2 THEN 'file:C:/x%3fy?mode=ro&immutable=1' ELSE 'file:p%25?mode=ro&immutable=1' END AS uri FROM pages""")
def normalize_addresses(spark, sf):
    base = F.expr("case page_id % 4 when 0 then ' host:80/v1/chat/completions/ ' when 1 then 'https://h/v1/embeddings' when 2 then ' ' else 'x//' end")
    path = F.expr(r"case page_id % 4 when 0 then '/a b/c#.db' when 1 then '\\\\srv\\x' when 2 then 'C:\\x?y' else 'p%' end")
    return read(spark, sf, "pages").select("page_id", cd.base_url(base).alias("base"), cd.file_uri(path).alias("uri"))


@query("""SELECT event_id, event_type || ' ' || chr(39) || '=x' AS raw, 'a b c' AS field, 'x_y.txt' AS name, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS at, least(greatest(CASE WHEN event_id % 3 = 0 THEN value ELSE pow(2, event_id % 7) END, 0), 30)::DOUBLE AS wait,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE regexp_extract(props, '[0-9]+') END AS k FROM events""")
def sanitized_fields(spark, sf):
    """Fields and names for files, times, waits before a retry, and JSON that may be broken."""
    props = F.expr("case when event_id % 5 = 0 then 'no {json' else props end")
    return read(spark, sf, "events").select(
        "event_id", F.concat("event_type", F.lit(" "), cd.csv_field(F.lit("=x"))).alias("raw"), cd.csv_field(F.lit(" a;b\r\nc ")).alias("field"), cd.file_name(F.lit("C:\\d/x?y.txt.")).alias("name"), cd.iso_utc(F.col("ts")).alias("at"),
        cd.retry_wait(F.expr("case when event_id % 3 = 0 then string(value) when event_id % 3 = 1 then 'Mon, 1 Jan' end"), F.col("event_id") % 7).alias("wait"), F.try_element_at(cd.json_or_empty(props), F.lit("k")).alias("k"),
    )


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 3.0 + 0.75 * 2 + 0.25 WHEN 1 THEN 0.0 WHEN 2 THEN 3.0 + least((p_size + 3) / 4.0, 2.0) + 1.0 ELSE 3.0 END::DOUBLE AS score FROM part")
def page_scores(spark, sf):
    text = F.expr("case p_partkey % 4 when 0 then 'Table 4-2: Limits\nMin Max of 5 ns' when 1 then 'Table 4-2 shows min 5 ns' else 'plain' end")
    n = F.col("p_partkey") % 4
    zero = lambda on, x: F.when(n == on, x).otherwise(0)
    return read(spark, sf, "part").select("p_partkey", cd.page_table_score(text, zero(2, F.lit(25)), zero(3, F.lit(2)), zero(2, F.col("p_size") + 3)).alias("score"))


@query(f"""WITH l AS (SELECT l_orderkey AS answer_id, l_linenumber AS claim_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i FROM {_ONE}) SELECT answer_id, claim_id, (i // 3)::INT AS batch FROM l""")
def judge_batches(spark, sf):
    """Claims of 34 tokens and replies of 10 in requests of 150: three to a request."""
    c = _lines(spark, sf).select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("claim_id"), cd.judge_tokens(F.repeat(F.lit("x"), 99)).alias("cost"))
    g = c.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", "cost"))).alias("c"))
    g = g.withColumn("b", cd.batches(F.transform("c", lambda x: x["cost"]), 150, 5, 10))
    return g.select("answer_id", F.explode(F.arrays_zip(F.col("c.claim_id").alias("claim_id"), F.col("b").alias("batch"))).alias("z")).select("answer_id", "z.claim_id", "z.batch")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'query: ' || c_name WHEN 1 THEN 'Instruct: Given a question, retrieve passages that answer it' || chr(10) || 'Query: ' || c_name ELSE c_name END AS q, CASE WHEN c_custkey % 3 = 0 THEN 'passage: ' || c_name ELSE c_name END AS p FROM customer""")
def model_prefixes(spark, sf):
    model = F.expr("case c_custkey % 3 when 0 then 'intfloat/multilingual-e5-large' when 1 then 'Qwen3-Embedding-8B' else 'bge-m3' end")
    return read(spark, sf, "customer").select("c_custkey", cd.with_prefix(F.col("c_name"), model, True).alias("q"), cd.with_prefix(F.col("c_name"), model, False).alias("p"))


@query("SELECT doc_id, source || ' ' || doc_id AS title, lang || '-' || (doc_id % 3) AS doc_key, n_chars < 500 AS legacy FROM documents WHERE contains(lower(source), 'c1')")
def public_documents(spark, sf):
    """What callers see: derived names and marks, no tables of contents; titles by a folded part."""
    d = read(spark, sf, "documents").where(F.contains(tx.fold(F.col("source")), tx.fold(F.lit("C1"))))
    return d.select("doc_id", F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("title"), F.concat_ws("-", "lang", (F.col("doc_id") % 3).cast("string")).alias("doc_key"), (F.col("n_chars") < 500).alias("legacy"))


@query("""WITH r AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer), l AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS v FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey + 1000000, 1 FROM customer WHERE c_custkey % 50 = 1)
SELECT coalesce(r.k, l.k) AS k, CASE WHEN l.k IS NULL THEN 'copy' WHEN r.k IS NULL THEN 'remove' WHEN r.v <> l.v THEN 'copy' ELSE 'keep' END AS action FROM r FULL JOIN l ON r.k = l.k""")
def mirror_state(spark, sf):
    """What makes a local copy equal to a remote snapshot, by what identifies each file's version."""
    c = read(spark, sf, "customer")
    local = c.where("c_custkey % 5 <> 0").selectExpr("c_custkey as k", "case when c_custkey % 4 = 0 then c_nationkey + 1 else c_nationkey end as v").unionByName(c.where("c_custkey % 50 = 1").selectExpr("c_custkey + 1000000 as k", "1 as v"))
    return lib.mirror(c.selectExpr("c_custkey as k", "c_nationkey as v"), local, "k", ["v"])


@query(f"""WITH c AS (SELECT l_orderkey AS question, count(*) AS n, count(DISTINCT l_returnflag) AS versions, count(DISTINCT l_quantity) AS vals, min(l_linenumber) AS lo FROM {_ONE} GROUP BY l_orderkey)
SELECT question, ask FROM (SELECT question, unnest(list_filter([CASE WHEN versions >= 2 AND question % 3 <> 0 THEN 'version' END, CASE WHEN n >= 2 AND vals >= 2 AND question % 4 <> 0 THEN 'condition' END, CASE WHEN question % 5 = 0 THEN 'compatibility' END], lambda x: x IS NOT NULL)[1:2]) AS ask FROM c)""")
def clarifications(spark, sf):
    """What a question has to be asked back: two things at most. A version, if several are current and none is named; a condition,
    if values vary by it and none is stated; and, of a connection, what is not given."""
    g = _lines(spark, sf).groupBy(F.col("l_orderkey").alias("question")).agg(F.count("*").alias("n"), F.countDistinct("l_returnflag").alias("versions"), F.countDistinct("l_quantity").alias("vals"))
    k = F.col("question")
    said = F.concat(F.when(k % 4 == 0, "for all conditions").otherwise("what is tRFC"), F.when(k % 5 == 0, " is it compatible?").otherwise(""))
    return verify.clarify(g.select("question", said.alias("text"), "versions", (k % 3 == 0).alias("named"), F.when(F.col("n") >= 2, F.col("vals")).otherwise(0).alias("variants"), F.lit(False).alias("stated")), 2)


@query("""SELECT conv_id, turn, 3 AS units, 'a 1' AS head, CASE WHEN turn % 2 = 0 THEN 2 ELSE 3 END AS first_words FROM conversations""")
def markdown_units(spark, sf):
    """Sentences of joined lines, heads and rows of tables; rows know their head."""
    made = F.expr("concat(case when turn % 2 = 0 then 'two\nwords.' else 'three short\nwords.' end, ' one.\n\n| a 1 | b |\n|---|---|\n| x | 5 |')")
    c = read(spark, sf, "conversations").select("conv_id", "turn", verify.units(made).alias("u"))
    return c.select("conv_id", "turn", F.size("u").alias("units"), F.get(F.get("u", F.lit(2))["header"], F.lit(0)).alias("head"), F.size(F.split(F.get("u", F.lit(0))["text"], " ")).alias("first_words"))
