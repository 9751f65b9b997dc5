"""Queries over the library's tables: roll-ups, lookups, snapshots, plans and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.catalog import query, read
from quillstone.functions import text as tx
from quillstone.operators import library as lib
from quillstone.operators.bounds import small
from quillstone.plans.adapters import CHUNKS, LINES, chunks, lines


@query("SELECT count(*) AS docs, sum(n_chars)::BIGINT AS chars, count(DISTINCT lang) AS domains, count(DISTINCT source) AS buckets, count(*) FILTER (n_chars > 2000) AS long_docs FROM documents")
def library_stats(spark, sf):
    d = read(spark, sf, "documents")
    return d.agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.countDistinct("lang").alias("domains"), F.countDistinct("source").alias("buckets"), F.count_if(F.col("n_chars") > 2000).alias("long_docs"))


@query("SELECT lang AS domain, count(*) AS docs, sum(len(string_split(text, chr(10))))::BIGINT AS n_lines FROM documents GROUP BY lang")
def domain_rollup(spark, sf):
    return read(spark, sf, "documents").groupBy(F.col("lang").alias("domain")).agg(F.count("*").alias("docs"), F.sum(F.size(F.split("text", "\n"))).alias("n_lines"))


@query("SELECT source AS bucket, count(*) AS docs, sum((n_chars < 500)::INT)::BIGINT AS short_docs, array_to_string(list_slice(list_sort(list(DISTINCT lang)), 1, 20), ',') AS langs FROM documents GROUP BY source")
def bucket_rollup(spark, sf):
    langs = F.array_join(F.slice(F.sort_array(F.collect_set("lang")), 1, 20), ",")
    return read(spark, sf, "documents").groupBy(F.col("source").alias("bucket")).agg(F.count("*").alias("docs"), F.sum((F.col("n_chars") < 500).cast("int")).alias("short_docs"), langs.alias("langs"))


@query("SELECT d.source, count(*) AS docs, count(l.doc_id) AS labelled, count(*) FILTER (l.quality = 1) AS good, count(*) FILTER (l.toxic = 1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def doc_counts_conditional(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source").join(read(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query(f"WITH {CHUNKS} SELECT doc_id, ordinal, section, page_start, page_end, text FROM chunks")
def chunk_build_fixed(spark, sf):
    return chunks(spark, sf).select("doc_id", "ordinal", "section", "page_start", "page_end", "text")


@query(f"WITH {CHUNKS} SELECT doc_id, section, min(ordinal) AS first_ordinal FROM chunks GROUP BY doc_id, section")
def section_first_ordinal(spark, sf):
    return chunks(spark, sf).groupBy("doc_id", "section").agg(F.min("ordinal").alias("first_ordinal"))


@query(f"WITH {CHUNKS} SELECT c.doc_id, ordinal, d.source || '/' || d.doc_id AS title FROM chunks c JOIN documents d USING (doc_id) WHERE c.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def chunk_by_ids(spark, sf):
    ids = read(spark, sf, "labels").where("toxic = 1").select("doc_id")
    c = chunks(spark, sf).join(small(ids), "doc_id", "left_semi")
    return c.select("doc_id", "ordinal", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("title"))


@query(f"WITH {CHUNKS} SELECT doc_id, ordinal, page_start, page_end FROM chunks WHERE page_start <= 2 AND page_end >= 2")
def page_interval_lookup(spark, sf):
    return chunks(spark, sf).where("page_start <= 2 and page_end >= 2").select("doc_id", "ordinal", "page_start", "page_end")


@query(f"WITH {CHUNKS} SELECT doc_id, ordinal FROM chunks WHERE section = 0 ORDER BY doc_id, ordinal LIMIT 60")
def section_chunks_limit(spark, sf):
    return chunks(spark, sf).where("section = 0").select("doc_id", "ordinal").orderBy("doc_id", "ordinal").limit(60)


@query(f"WITH {CHUNKS} SELECT doc_id, ordinal FROM chunks WHERE contains(lower(text), 'token = ') ORDER BY doc_id, ordinal LIMIT 40")
def chunk_contains(spark, sf):
    return chunks(spark, sf).where(F.contains(F.lower("text"), F.lit("token = "))).select("doc_id", "ordinal").orderBy("doc_id", "ordinal").limit(40)


@query("SELECT doc_id, sha, first_doc, copies FROM (SELECT doc_id, sha256(text) AS sha, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_doc, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents) WHERE copies > 1")
def content_hash_duplicates(spark, sf):
    """Copies and the document whose content they reuse; two aggregations' worth of hashes move, not texts."""
    d = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    groups = d.groupBy("sha").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")
    return d.join(groups, "sha").select("doc_id", "sha", "first_doc", "copies")


_FILES = "case when doc_id % 10 = 3 then concat('new/', doc_id) else concat(source, '/', doc_id) end"


def _snapshots(spark, sf):
    """Two snapshots made from the documents: what is indexed, and what a folder holds now."""
    d = read(spark, sf, "documents")
    sha = F.sha2("text", 256)
    docs = d.where("doc_id % 7 <> 0").select("doc_id", F.expr("concat(source, '/', doc_id)").alias("rel"), F.col("n_chars").alias("size"), F.lit(1).cast("long").alias("mtime"), sha.alias("sha"), F.expr("case when doc_id % 13 = 0 then 'old' else 'fp' end").alias("fp"), F.expr("doc_id % 17 = 0").alias("missing"))
    files = d.where("doc_id % 11 <> 0").select(F.expr(_FILES).alias("rel"), F.expr("case when doc_id % 5 = 1 then n_chars + 1 else n_chars end").alias("size"), F.expr("case when doc_id % 5 = 2 then 2L else 1L end").alias("mtime"), F.expr("case when doc_id % 5 = 1 then sha2(concat(text, 'x'), 256) else sha2(text, 256) end").alias("sha"))
    return files, docs


_SNAP = """files AS (SELECT CASE WHEN doc_id % 10 = 3 THEN 'new/' || doc_id ELSE source || '/' || doc_id END AS rel,
   CASE WHEN doc_id % 5 = 1 THEN n_chars + 1 ELSE n_chars END AS size, CASE WHEN doc_id % 5 = 2 THEN 2 ELSE 1 END AS mtime,
   CASE WHEN doc_id % 5 = 1 THEN sha256(text || 'x') ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 11 <> 0),
 docs AS (SELECT doc_id, source || '/' || doc_id AS rel, n_chars AS size, 1 AS mtime, sha256(text) AS sha, CASE WHEN doc_id % 13 = 0 THEN 'old' ELSE 'fp' END AS fp, doc_id % 17 = 0 AS missing FROM documents WHERE doc_id % 7 <> 0),
 j AS (SELECT coalesce(f.rel, d.rel) AS rel, f.rel IS NULL AS no_file, d.rel IS NULL AS no_doc, f.sha AS sha, d.sha AS dsha, doc_id, fp, missing, (f.size = d.size AND f.mtime = d.mtime) AS same_stat
       FROM files f FULL JOIN docs d ON f.rel = d.rel),
 n AS (SELECT rel, sha, row_number() OVER (PARTITION BY sha ORDER BY rel) AS nth FROM j WHERE no_doc),
 g AS (SELECT doc_id AS gone, dsha AS sha, row_number() OVER (PARTITION BY dsha ORDER BY doc_id) AS nth FROM j WHERE no_file AND fp IN ('', 'fp')),
 m AS (SELECT n.rel, gone FROM n JOIN g USING (sha, nth)),
 live AS (SELECT sha, max(doc_id) AS dup FROM docs WHERE NOT missing AND fp IN ('', 'fp') GROUP BY sha),
 p AS (SELECT j.rel, CASE WHEN no_doc AND gone IS NOT NULL THEN 'moved' WHEN no_doc AND dup IS NOT NULL THEN 'duplicate' WHEN no_doc THEN 'new' WHEN no_file THEN 'missing'
     WHEN NOT same_stat AND j.sha <> dsha THEN 'changed' WHEN fp NOT IN ('', 'fp') THEN 'settings' WHEN NOT same_stat THEN 'touched' WHEN missing THEN 'restored' ELSE 'unchanged' END AS action,
     doc_id, CASE WHEN no_doc THEN coalesce(gone, dup) END AS from_doc
   FROM j LEFT JOIN m ON no_doc AND m.rel = j.rel LEFT JOIN live ON live.sha = j.sha WHERE NOT (no_file AND doc_id IN (SELECT gone FROM m)))"""


@query(f"WITH {_SNAP} SELECT rel, action, doc_id, from_doc FROM p")
def change_plan(spark, sf):
    return lib.change_plan(*_snapshots(spark, sf), "fp")


@query(f"WITH {_SNAP} SELECT rel, from_doc FROM p WHERE action = 'moved'")
def moved_files(spark, sf):
    return lib.change_plan(*_snapshots(spark, sf), "fp").where("action = 'moved'").select("rel", "from_doc")


@query(f"WITH {_SNAP} SELECT action, count(*) AS n FROM p GROUP BY action UNION ALL SELECT 'to_process', count(*) FROM p WHERE action IN ('new', 'changed', 'settings')")
def plan_summary(spark, sf):
    p = lib.change_plan(*_snapshots(spark, sf), "fp")
    by = p.groupBy("action").agg(F.count("*").alias("n"))
    return by.unionByName(p.where(F.col("action").isin("new", "changed", "settings")).agg(F.lit("to_process").alias("action"), F.count("*").alias("n")))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM (
  SELECT * FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 2 = 1)) WHERE nth = 1""")
def upsert_latest(spark, sf):
    o = read(spark, sf, "orders")
    out = lib.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return out.select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_cascade(spark, sf):
    victims = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return lib.delete_cascade(victims, "l_orderkey", read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))[0]


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def tombstone_filter(spark, sf):
    return read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels").where("quality = 0"), "doc_id", "left_anti")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 50")
def keep_last_n_runs(spark, sf):
    return lib.keep_last(read(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 50).select("user_id", "event_id")


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 + 5000000 AS doc_id, doc_id AS from_doc, 'clone' AS source FROM documents WHERE lang = 'es'")
def clone_documents(spark, sf):
    d = read(spark, sf, "documents").where("lang = 'es'").select("doc_id", F.col("doc_id").alias("from_doc"), "source")
    return lib.clone(d, "doc_id", 5_000_000, [F.asc("from_doc")], source="clone")


@query("SELECT doc_id + CASE WHEN lang = 'fr' THEN 1000000000 ELSE 0 END AS doc_id, source FROM documents")
def library_view(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source", "lang")
    return lib.two_libraries(d.where("lang <> 'fr'"), d.where("lang = 'fr'"), ["doc_id"]).select("doc_id", "source")


_SERIES = """SELECT o_orderkey AS doc_id, o_custkey AS series, o_orderpriority AS version,
 CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 5 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m') END AS doc_date,
 CASE WHEN o_custkey % 4 = 0 THEN chr(65 + (o_orderkey % 6)::INT) ELSE (o_orderkey % 4)::VARCHAR || '.' || (o_orderkey % 12)::VARCHAR END AS revision FROM orders"""


@query(f"""WITH d AS ({_SERIES}), k AS (SELECT *, CASE WHEN revision >= 'A' THEN [1, ascii(lower(revision)), 0] ELSE [0, split_part(revision, '.', 1)::INT, split_part(revision, '.', 2)::INT] END AS rk,
  revision >= 'A' AS letter FROM d),
 g AS (SELECT *, count(*) OVER w AS n, min((doc_date <> '')::INT) OVER w AS dated, min(letter::INT) OVER w AS l0, max(letter::INT) OVER w AS l1 FROM k WINDOW w AS (PARTITION BY series, version)),
 s AS (SELECT *, (CASE WHEN dated = 1 THEN doc_date ELSE '' END, rk) AS sk FROM g),
 t AS (SELECT *, max(sk) OVER (PARTITION BY series, version) AS top FROM s),
 u AS (SELECT *, sum((sk = top)::INT) OVER (PARTITION BY series, version) AS tops, max(CASE WHEN sk = top THEN doc_id END) OVER (PARTITION BY series, version) AS newest FROM t)
SELECT doc_id, CASE WHEN n > 1 AND (dated = 1 OR l0 = l1) AND tops = 1 AND doc_id <> newest THEN newest END AS superseded_by FROM u""")
def supersedence_latest(spark, sf):
    d = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("series"), F.col("o_orderpriority").alias("version"),
        F.expr("case when o_custkey % 3 = 0 and o_orderkey % 5 = 0 then '' else date_format(o_orderdate, 'yyyy-MM') end").alias("doc_date"),
        F.expr("case when o_custkey % 4 = 0 then char(65 + o_orderkey % 6) else concat(o_orderkey % 4, '.', o_orderkey % 12) end").alias("revision"),
    )
    return lib.supersedence(d, ["series", "version"])


@query("""WITH d AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 9 = 0 THEN 'errata' WHEN o_orderkey % 9 = 1 THEN 'guide' ELSE 'base' END AS doc_type, o_orderpriority AS domain, 's' || o_custkey AS series,
   CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE (o_orderkey % 3)::VARCHAR END AS version, CASE WHEN o_orderkey % 5 = 0 THEN 1 END AS superseded_by FROM orders),
 p AS (SELECT a.doc_id, b.doc_id AS target, a.version AS av, b.superseded_by IS NULL AS active, sum((b.superseded_by IS NULL)::INT) OVER (PARTITION BY a.doc_id) AS n
   FROM d a JOIN d b ON a.domain = b.domain AND a.series = b.series AND b.doc_type = 'base' WHERE a.doc_type = 'errata' AND (a.version = '' OR b.version IN ('', a.version)))
SELECT doc_id, target FROM p WHERE CASE WHEN av <> '' THEN active OR n = 0 ELSE active AND n = 1 END""")
def amendment_targets(spark, sf):
    d = read(spark, sf, "orders").selectExpr("o_orderkey as doc_id", "case when o_orderkey % 9 = 0 then 'errata' when o_orderkey % 9 = 1 then 'guide' else 'base' end as doc_type", "o_orderpriority as domain", "concat('s', o_custkey) as series", "case when o_orderkey % 4 = 0 then '' else string(o_orderkey % 3) end as version", "case when o_orderkey % 5 = 0 then 1 end as superseded_by")
    return lib.amendment_targets(d)


_PARAMS = "SELECT l_suppkey AS doc_id, p_type AS name, l_returnflag || ' at ' || l_linestatus AS conditions, (p_size % 4)::VARCHAR AS min, NULL::VARCHAR AS typ, (l_linenumber % 2)::VARCHAR AS max, 'ns' AS unit FROM lineitem JOIN part ON l_partkey = p_partkey"


def _params(spark, sf):
    j = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.selectExpr("l_suppkey as doc_id", "p_type as name", "concat(l_returnflag, ' at ', l_linestatus) as conditions", "string(p_size % 4) as min", "cast(null as string) as typ", "string(l_linenumber % 2) as max", "'ns' as unit")


@query(f"""WITH p AS ({_PARAMS}), v AS (SELECT lower(trim(name)) AS name, array_to_string(list_sort(regexp_extract_all(lower(conditions), '[\\p{{L}}\\p{{N}}_]+')), ' ') AS cond, doc_id, (min, typ, max, unit) AS val, coalesce(min, typ, max) || ' ' || unit AS shown FROM p)
SELECT name, cond, count(DISTINCT doc_id) AS docs, count(DISTINCT val) AS variants, array_to_string(list_sort(list(DISTINCT shown)), ' vs ') AS shown FROM v GROUP BY name, cond HAVING count(DISTINCT doc_id) > 1 AND count(DISTINCT val) > 1""")
def parameter_conflicts(spark, sf):
    return lib.conflicts(_params(spark, sf))


@query(f"""WITH p AS ({_PARAMS}) SELECT doc_id, name, count(DISTINCT conditions) AS conditions, count(DISTINCT (min, max)) AS variants FROM p GROUP BY doc_id, name HAVING count(DISTINCT conditions) >= 2 AND count(DISTINCT (min, max)) >= 2""")
def varying_conditions(spark, sf):
    """Parameters of one document that depend on a condition."""
    g = _params(spark, sf).groupBy("doc_id", "name").agg(F.countDistinct("conditions").alias("conditions"), F.countDistinct(F.struct("min", "max")).alias("variants"))
    return g.where("conditions >= 2 and variants >= 2")


@query("""WITH d AS (SELECT doc_id, source, lang, CASE WHEN quality IS NULL THEN [] ELSE ['Q' || quality, 'T' || toxic] END AS ents, coalesce(toxic = 1, false) AS sup, doc_id % 19 = 0 AS missing FROM documents LEFT JOIN labels USING (doc_id)),
 u AS (SELECT * FROM d WHERE NOT missing AND NOT sup)
SELECT 'bucket' AS ask, doc_id, 'user' AS reason FROM u WHERE source IN ('src1', 'src2') OR doc_id IN (5, 6)
UNION ALL SELECT 'domain', doc_id, 'user' FROM u WHERE lang IN ('de')
UNION ALL SELECT 'entity', doc_id, 'entity' FROM u WHERE list_contains(ents, 'Q0')
UNION ALL SELECT 'routed', doc_id, 'all' FROM u UNION ALL SELECT 'none', doc_id, 'user' FROM u WHERE false""")
def scope_ladder(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.col("source").alias("bucket"), F.col("lang").alias("domain"),
        F.expr("case when quality is null then array() else array(concat('Q', quality), concat('T', toxic)) end").alias("entities"),
        F.expr("coalesce(toxic = 1, false)").alias("superseded"), F.expr("doc_id % 19 = 0").alias("missing"),
    )
    asks = {"bucket": (["src1", "src2"], [5, 6], None, None, None), "domain": (None, None, ["de"], None, None), "entity": (None, None, None, ["q0"], None), "routed": (None, None, None, None, ["xx"]), "none": ([], None, None, None, None)}
    out = None
    for name, ask in asks.items():
        one = lib.scope(d, *ask).withColumn("ask", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("ask", "doc_id", "reason")


_ENTITIES = {"license": r"(?i)\blicen[sc]ed?\b", "email": r"[\w.]+@[\w.]+", "address": r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "key": r"(?i)\btoken\b"}
_ENTITY_SQL = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS entity, len(regexp_extract_all(text, '{v}')) AS n FROM documents" for k, v in _ENTITIES.items())


def _entity_scores(spark, sf):
    """One scan: all patterns are counted in a row, then turned into rows."""
    pairs = F.array(*[F.struct(F.lit(k).alias("entity"), F.regexp_count("text", F.lit(v)).cast("long").alias("n")) for k, v in _ENTITIES.items()])
    return read(spark, sf, "documents").select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.entity", "p.n").where("n > 0")


@query(f"SELECT doc_id, entity, n FROM ({_ENTITY_SQL}) WHERE n > 0")
def entity_scores(spark, sf):
    return _entity_scores(spark, sf)


@query(f"SELECT doc_id, entity FROM (SELECT doc_id, entity, n, max(n) OVER (PARTITION BY doc_id) AS top FROM ({_ENTITY_SQL}) WHERE n > 0) WHERE n >= greatest(2, 0.6 * top)")
def dominant_entities(spark, sf):
    from pyspark.sql import Window

    top = F.max("n").over(Window.partitionBy("doc_id"))
    return _entity_scores(spark, sf).withColumn("top", top).where("n >= greatest(2, 0.6 * top)").select("doc_id", "entity")


@query("SELECT conv_id, turn, role, dense_rank() OVER (PARTITION BY conv_id ORDER BY f) AS n FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id, role) AS f FROM conversations)")
def registry_numbering(spark, sf):
    return lib.number_sources(read(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "role", "turn")


@query("SELECT coalesce(d.doc_id, l.doc_id + 1000000) AS doc_id, d.source, l.quality FROM documents d FULL JOIN (SELECT CASE WHEN doc_id % 5 = 0 THEN doc_id + 1000000 ELSE doc_id END AS doc_id, quality FROM labels) l ON d.doc_id = l.doc_id")
def quality_full_outer(spark, sf):
    """Documents and quality records; either may lack the other."""
    d = read(spark, sf, "documents").select("doc_id", "source")
    q = read(spark, sf, "labels").select(F.expr("case when doc_id % 5 = 0 then doc_id + 1000000 else doc_id end").alias("q_id"), "quality")
    return d.join(q, F.col("doc_id") == F.col("q_id"), "full_outer").select(F.coalesce("doc_id", F.col("q_id") + 1000000).alias("doc_id"), "source", "quality")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high, round(sum(value), 4) AS total, min(event_id) AS first FROM events GROUP BY event_type")
def run_rollup(spark, sf):
    g = read(spark, sf, "events").groupBy("event_type")
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.round(F.sum("value"), 4).alias("total"), F.min("event_id").alias("first"))


@query("SELECT user_id, arg_max(event_id, (ts, event_type, event_id)) AS event_id, arg_max(event_type, (ts, event_type, event_id)) AS event_type FROM events GROUP BY user_id")
def settings_overlay(spark, sf):
    """The newest decision for a key wins; of equal times the higher layer."""
    g = read(spark, sf, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_type", "event_id")).alias("b"))
    return g.select("user_id", "b.event_id", "b.event_type")


@query("SELECT conv_id, count(*) AS turns, min(turn) AS first_turn, max(turn) AS last_turn, arg_min(left(text, 40), turn) AS title FROM conversations GROUP BY conv_id")
def chat_index(spark, sf):
    g = read(spark, sf, "conversations").groupBy("conv_id")
    return g.agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.min_by(F.substring("text", 1, 40), "turn").alias("title"))


@query(f"WITH {LINES} SELECT doc_id, page, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY doc_id, page")
def page_text_rollup(spark, sf):
    g = lines(spark, sf).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return g.select("doc_id", "page", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS missing FROM customer")
def root_missing_counts(spark, sf):
    o = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("missing"))
    j = read(spark, sf, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("missing", F.lit(0)).alias("missing"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphans_anti(spark, sf):
    """Customers without an order."""
    return read(spark, sf, "customer").select("c_custkey").join(read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_delete(spark, sf):
    c = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, lower(o_orderpriority), o_orderkey LIMIT 50 OFFSET 100")
def status_order_page(spark, sf):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return read(spark, sf, "orders").orderBy(rank, F.lower("o_orderpriority"), "o_orderkey").select("o_orderkey", "o_orderstatus").offset(100).limit(50)


@query("""WITH n AS (SELECT doc_id, lang || '/' || (n_chars // 7) AS k FROM documents), o AS (SELECT k, any_value(doc_id) AS doc_id FROM n WHERE doc_id % 2 = 0 GROUP BY k HAVING count(*) = 1),
 p AS (SELECT k, any_value(doc_id) AS doc_id FROM n WHERE doc_id % 2 = 1 GROUP BY k HAVING count(*) = 1) SELECT o.doc_id AS old_id, p.doc_id AS new_id FROM o JOIN p USING (k)""")
def relink_orphans(spark, sf):
    """Records whose key is unique on both sides are linked again."""
    n = read(spark, sf, "documents").select("doc_id", F.expr("concat(lang, '/', n_chars div 7)").alias("k"))
    return lib.relink(n.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "old_id"), n.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "new_id"), "k").select("old_id", "new_id")


@query("SELECT doc_id, CASE WHEN nth = 1 THEN rel ELSE rel || ' (' || nth || ')' END AS rel FROM (SELECT doc_id, lang || '/' || source AS rel, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS nth FROM documents)")
def publish_paths(spark, sf):
    """Paths that collide get a number."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("rel").orderBy("doc_id"))
    d = read(spark, sf, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("rel")).withColumn("nth", nth)
    return d.select("doc_id", F.when(F.col("nth") == 1, F.col("rel")).otherwise(F.concat("rel", F.lit(" ("), F.col("nth").cast("string"), F.lit(")"))).alias("rel"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def scope_intersect(spark, sf):
    return read(spark, sf, "documents").where("lang = 'en'").select("doc_id").intersect(read(spark, sf, "labels").where("quality = 1").select("doc_id"))


@query("SELECT doc_id, lower(translate(source || ' ' || lang, 'çÇğĞıIİöÖşŞüÜâîû', 'ccggiiioossuuaiu')) AS folded, CASE WHEN source = '' THEN '_root' ELSE regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g') || '-' || left(sha1(source), 6) END AS bucket_id FROM documents")
def bucket_ids(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", tx.fold(F.concat_ws(" ", "source", "lang")).alias("folded"), tx.slug(F.col("source")).alias("bucket_id"))
