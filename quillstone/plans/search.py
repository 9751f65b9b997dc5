"""Search queries over the documents, the benchmark's passages as questions, and the vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.catalog import query, read
from quillstone.functions import text as tx
from quillstone.operators import search as s
from quillstone.operators.bounds import small, spread
from quillstone.plans.adapters import CHUNKS, chunks
from quillstone.session import alive

_STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"
_TERMS = r"regexp_extract_all(lower(replace({0}, 'İ', 'i')), '[\p{{L}}\p{{N}}_]+')"

#: Distinct terms in order of appearance, without stop words, 48 at most.
QUERY_TERMS = f"""qterms AS (
  SELECT item_id AS query_id, term FROM (
    SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS nth FROM (
      SELECT item_id, term, min(pos) AS pos FROM (
        SELECT item_id, unnest({_TERMS.format("text")}) AS term, unnest(range(1, len({_TERMS.format("text")}) + 1)) AS pos FROM benchmark)
      WHERE length(term) >= 2 AND NOT list_contains({_STOP}, term) GROUP BY item_id, term))
  WHERE nth <= 48)"""


def _documents(spark, sf):
    return spread(read(spark, sf, "documents").select("doc_id", "text", "lang", "source"))


#: Indexes of this session, by what was indexed: the files with their sizes and times.
_INDEXES: dict[tuple, s.Index] = {}


def _index(spark, sf) -> s.Index:
    """The documents' index: built when it is first asked for, and again if the files have changed."""
    d = read(spark, sf, "documents")
    path = spark._jvm.org.apache.hadoop.fs.Path
    status = lambda f: path(f).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path(f))
    of = (spark.sparkContext.applicationId, *((f, status(f).getLen(), status(f).getModificationTime()) for f in sorted(d.inputFiles())))
    if of not in _INDEXES or not alive(_INDEXES[of].docs):
        _INDEXES[of] = s.build_index(_documents(spark, sf), "doc_id", ["text", "source", "lang"])
    return _INDEXES[of]


def _questions(spark, sf):
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), tx.search_terms(F.col("text")).alias("terms"))


def _bm25_sql(weights: dict[str, float], k: int, scope: str = "", columns: str = "query_id, doc_id, score, rank") -> str:
    fields = " UNION ALL ".join(f"SELECT doc_id, unnest({_TERMS.format(c)}) AS term, {w}::DOUBLE AS w FROM documents" for c, w in weights.items())
    length = " + ".join(f"len({_TERMS.format(c)})" for c in weights)
    return f"""WITH {QUERY_TERMS},
 post AS (SELECT doc_id, term, sum(w) AS tf FROM ({fields}) GROUP BY doc_id, term),
 size AS (SELECT doc_id, {length} AS len FROM documents),
 stats AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean FROM size),
 df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
 scored AS (
  SELECT q.query_id, p.doc_id, round(sum(greatest(CASE WHEN ln((n-df+0.5)/(df+0.5)) <= 0 THEN 1e-6 ELSE ln((n-df+0.5)/(df+0.5)) END, 1e-6)
     * tf * 2.2 / (tf + 1.2*(0.25 + 0.75*len/mean))), 8) AS score
  FROM qterms q JOIN post p USING (term) JOIN df USING (term) JOIN size s ON s.doc_id = p.doc_id CROSS JOIN stats {scope}
  GROUP BY q.query_id, p.doc_id),
 ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT {columns} FROM ranked WHERE rank <= {k}"""


_OUT = "query_id, doc_id, score, rank"


@query(_bm25_sql({"text": 1.0}, 10, columns=_OUT))
def bm25_topk(spark, sf):
    """The ten best documents for each benchmark passage."""
    return s.bm25(_index(spark, sf), "doc_id", {"text": 1.0}, _questions(spark, sf), 10)


@query(_bm25_sql({"text": 1.0, "source": 0.6, "lang": 0.3}, 10, columns=_OUT))
def bm25_weighted_fields(spark, sf):
    return s.bm25(_index(spark, sf), "doc_id", {"text": 1.0, "source": 0.6, "lang": 0.3}, _questions(spark, sf), 10)


@query(_bm25_sql({"text": 1.0}, 10, "JOIN documents d ON d.doc_id = p.doc_id AND d.lang = 'en'", _OUT))
def bm25_scoped(spark, sf):
    """Within one collection; corpus statistics stay global."""
    english = read(spark, sf, "documents").where("lang = 'en'").select("doc_id")
    return s.bm25(_index(spark, sf), "doc_id", {"text": 1.0}, _questions(spark, sf), 10, english)


@query(f"WITH {QUERY_TERMS} SELECT query_id, term FROM qterms")
def fts_terms(spark, sf):
    return _questions(spark, sf).select("query_id", F.explode("terms").alias("term"))


@query(f"SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents) GROUP BY doc_id, term")
def postings(spark, sf):
    return s.postings(_documents(spark, sf), "doc_id", {"text": 1.0})


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents) GROUP BY term")
def term_doc_freq(spark, sf):
    p = s.postings(_documents(spark, sf), "doc_id", {"text": 1.0})
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))


def _vector_queries(spark, sf, where="vec_id % 100 = 0"):
    return read(spark, sf, "embeddings").where(where).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _dense_sql(k: int, where: str = "true", extra: str = "") -> str:
    return f"""SELECT query_id, vec_id, score, rank FROM (
 SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 100 = 0 AND {where})) WHERE rank <= {k}"""


@query(_dense_sql(10))
def dense_topk(spark, sf):
    return s.dense(read(spark, sf, "embeddings"), "vec_id", _vector_queries(spark, sf), 10)


@query(_dense_sql(10, "v.label IN (1, 2, 3) AND (v.vec_id // 10) % 3 = 0"))
def dense_topk_masked(spark, sf):
    """The mask restricts before ranking."""
    v = read(spark, sf, "embeddings").where("label in (1, 2, 3) and (vec_id div 10) % 3 = 0")
    return s.dense(v, "vec_id", _vector_queries(spark, sf), 10)


@query("""SELECT query_id, vec_id, score, rank FROM (
 SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id + CASE WHEN v.label % 2 = 1 THEN 1000000000 ELSE 0 END AS vec_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 100 = 0)) WHERE rank <= 10""")
def dense_federated(spark, sf):
    """Two libraries: ids of the second are shifted; vectors of another length are skipped."""
    v = read(spark, sf, "embeddings")
    both = v.where("label % 2 = 0").unionByName(v.where("label % 2 = 1").withColumn("vec_id", F.col("vec_id") + 10**9))
    return s.dense(both, "vec_id", _vector_queries(spark, sf), 10)


@query("""SELECT label AS entity, query_id, vec_id, score, rank FROM (
 SELECT label, query_id, vec_id, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT v.label, q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 100 = 0 AND v.label IN (0, 1, 2))) WHERE rank <= 3""")
def per_entity_topk(spark, sf):
    """A pool of its own for each named entity: max(2, ceil(8 / 3)) candidates each."""
    v, q = read(spark, sf, "embeddings"), _vector_queries(spark, sf)
    pools = [s.dense(v.where(F.col("label") == e), "vec_id", q, 3).withColumn("entity", F.lit(e)) for e in (0, 1, 2)]
    out = pools[0].unionByName(pools[1]).unionByName(pools[2])
    return out.select("entity", "query_id", "vec_id", "score", "rank")


def _two_lists(spark, sf):
    d, q = _index(spark, sf), _questions(spark, sf)
    a = s.bm25(d, "doc_id", {"text": 1.0}, q, 50).select("query_id", F.lit(0).alias("list_id"), "doc_id", "rank")
    b = s.bm25(d, "doc_id", {"source": 1.0, "text": 0.5}, q, 50).select("query_id", F.lit(1).alias("list_id"), "doc_id", "rank")
    return a, b


_LIST_A = _bm25_sql({"text": 1.0}, 50, columns="query_id, doc_id, rank")
_LIST_B = _bm25_sql({"source": 1.0, "text": 0.5}, 50, columns="query_id, doc_id, rank")


# A passage's vector stands under its own number, a document's under its id.
_LIST_C = """SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT b.item_id AS query_id, v.vec_id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings v)) WHERE rank <= 50"""


def _dense_list(spark, sf):
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    items = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    q = v.join(small(items), F.col("doc_id") == F.col("query_id")).select("query_id", F.col("embedding").alias("vector"))
    return s.dense(v, "doc_id", q, 50).select("query_id", F.lit(2).alias("list_id"), "doc_id", "rank")


@query(f"""WITH l AS (SELECT query_id, 0 AS list_id, doc_id, rank FROM ({_LIST_A}) UNION ALL SELECT query_id, 1, doc_id, rank FROM ({_LIST_B}) UNION ALL SELECT query_id, 2, doc_id, rank FROM ({_LIST_C})),
 f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS score, min(list_id * 1000 + rank) AS first FROM l GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rank FROM f) WHERE rank <= 8""")
def rrf_hybrid(spark, sf):
    """Two lists by words, one by vectors, fused."""
    a, b = _two_lists(spark, sf)
    return s.fuse(a.unionByName(b).unionByName(_dense_list(spark, sf)), "doc_id").where("rank <= 8")


@query(f"""WITH l AS (SELECT query_id, 0 AS source, doc_id, rank FROM ({_LIST_A}) UNION ALL SELECT query_id, 1, doc_id, rank FROM ({_LIST_B}))
SELECT query_id, source, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, source) AS place FROM l) WHERE place <= 8""")
def interleave_rankings(spark, sf):
    a, b = (x.drop("list_id") for x in _two_lists(spark, sf))
    return s.interleave(a, b, ["query_id"], 8).select("query_id", "source", "doc_id", "place")


@query(f"""WITH a AS ({_LIST_A}), {QUERY_TERMS}, n AS (SELECT query_id, count(*) AS n FROM qterms GROUP BY query_id),
 t AS (SELECT doc_id, unnest(list_distinct({_TERMS.format('text')})) AS term FROM documents),
 h AS (SELECT a.query_id, a.doc_id, a.rank, count(q.term) AS hit FROM a LEFT JOIN t USING (doc_id) LEFT JOIN qterms q ON q.query_id = a.query_id AND q.term = t.term GROUP BY ALL),
 s AS (SELECT h.query_id, doc_id, rank AS old_rank, round(hit / n, 6) AS score FROM h JOIN n USING (query_id))
SELECT query_id, doc_id, score, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old_rank) AS new_rank FROM s) WHERE new_rank <= 8""")
def overlap_rerank(spark, sf):
    """Forty candidates and more, reranked by the share of the question's terms that they have. Texts are
    joined on only once the candidates are known."""
    a, _ = _two_lists(spark, sf)
    d = read(spark, sf, "documents").select("doc_id", "text")
    c = d.join(small(a.drop("list_id")), "doc_id").join(small(_questions(spark, sf)), "query_id")
    scored = c.select("query_id", "doc_id", F.col("rank").alias("old"), F.round(s.sigmoid_if_needed(s.overlap(F.col("terms"), tx.terms(F.col("text")))), 6).alias("score"))
    return s.top(scored, ["query_id"], [F.desc("score"), F.asc("old")], 8).select("query_id", "doc_id", "score", F.col("rank").alias("new_rank"))


_TOKENS = r"greatest(length(text)//4, floor(len(regexp_extract_all(text, '\S+'))*1.3))::BIGINT"


@query(f"""WITH {CHUNKS}, t AS (SELECT doc_id, ordinal, {_TOKENS} AS tokens FROM chunks),
 c AS (SELECT *, sum(tokens) OVER (PARTITION BY doc_id ORDER BY ordinal) AS used, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS nth FROM t)
SELECT doc_id, ordinal, tokens, used::BIGINT AS used FROM c WHERE used <= 1200 OR nth = 1""")
def budget_prefix(spark, sf):
    c = chunks(spark, sf).select("doc_id", "ordinal", tx.estimate_tokens(F.col("text")).alias("tokens"))
    return s.budget_prefix(c, ["doc_id"], [F.asc("ordinal")], "tokens", 1200)


@query(rf"""WITH {CHUNKS}, t AS (SELECT doc_id, ordinal, {_TOKENS} AS tokens FROM chunks),
 l AS (SELECT doc_id, list({{'key': ordinal, 'tokens': tokens}} ORDER BY tokens DESC, ordinal) AS items FROM t GROUP BY doc_id),
 f AS (SELECT doc_id, list_reduce(list_transform(items, lambda x: {{'used': x.tokens, 'kept': [x.key], 'key': x.key, 'tokens': x.tokens}}),
   lambda s, x: CASE WHEN s.used + x.tokens <= 500 THEN {{'used': s.used + x.tokens, 'kept': list_append(s.kept, x.key), 'key': x.key, 'tokens': x.tokens}}
      ELSE {{'used': s.used, 'kept': s.kept, 'key': x.key, 'tokens': x.tokens}} END,
   {{'used': 0::BIGINT, 'kept': []::BIGINT[], 'key': 0::BIGINT, 'tokens': 0::BIGINT}}) AS r FROM l)
SELECT doc_id, unnest(r.kept) AS ordinal FROM f""")
def budget_skip_fold(spark, sf):
    c = chunks(spark, sf).select("doc_id", F.col("ordinal").alias("key"), tx.estimate_tokens(F.col("text")).alias("tokens"))
    items = c.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("tokens")).alias("o"), "key", "tokens"))).alias("items"))
    return items.select("doc_id", F.explode(s.budget_skip(F.col("items"), 500)).alias("ordinal"))


_HITS = "(doc_id * 7 + ordinal * 3) % 5 < 2"


@query(f"""WITH {CHUNKS}, h AS (SELECT *, ordinal - row_number() OVER (PARTITION BY doc_id, section ORDER BY ordinal) AS island FROM chunks WHERE {_HITS})
SELECT doc_id, section, min(ordinal) AS first, max(ordinal) AS last, string_agg(text, chr(10) ORDER BY ordinal) AS text FROM h GROUP BY doc_id, section, island""")
def passage_islands(spark, sf):
    """Hits that follow one another in a section are one passage."""
    return s.passages(chunks(spark, sf).where(_HITS), ["doc_id", "section"], "ordinal", "text")


@query(f"""WITH {CHUNKS}, o AS (SELECT *, least(ordinal * 2, 12) AS ov, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS nth FROM chunks)
SELECT doc_id, min(ordinal) AS first, max(ordinal) AS last, string_agg(CASE WHEN nth > 1 THEN substring(text, ov + 1) ELSE text END, chr(10) ORDER BY ordinal) AS text FROM o GROUP BY doc_id""")
def join_chunks(spark, sf):
    """Chunks joined without the overlap that each repeats."""
    c = chunks(spark, sf).withColumn("ov", F.least(F.col("ordinal") * 2, F.lit(12)).cast("int"))
    return s.passages(c, ["doc_id"], "ordinal", "text", "ov").select("doc_id", "first", "last", "text")


@query(f"""WITH {CHUNKS}, h AS (SELECT doc_id, section, ordinal FROM chunks WHERE (doc_id + ordinal) % 11 = 0)
SELECT DISTINCT c.doc_id, c.section, c.ordinal FROM chunks c JOIN h ON c.doc_id = h.doc_id AND c.section = h.section AND c.ordinal BETWEEN h.ordinal - 1 AND h.ordinal + 1""")
def chunk_neighbors(spark, sf):
    c = chunks(spark, sf).select("doc_id", "section", "ordinal")
    return s.neighbours(c.where("(doc_id + ordinal) % 11 = 0"), c, ["doc_id", "section"], "ordinal", 1)


@query("""SELECT p_partkey, (2.0*((position('steel' IN lower(p_type)) > 0)::INT + (position('brass' IN lower(p_type)) > 0)::INT)
  + 0.2*((position('steel' IN lower(p_name)) > 0)::INT + (position('brass' IN lower(p_name)) > 0)::INT) + CASE WHEN p_brand LIKE '%#12' THEN 10 ELSE 0 END)::DOUBLE AS score FROM part
  WHERE lower(p_type) LIKE '%steel%' OR lower(p_type) LIKE '%brass%' OR lower(p_name) LIKE '%steel%' OR lower(p_name) LIKE '%brass%' OR p_brand LIKE '%#12'""")
def table_search_score(spark, sf):
    """Two for each term in the caption, a fifth in the body, ten for the label."""
    p = read(spark, sf, "part")
    has = lambda c, t: F.contains(F.lower(F.col(c)), F.lit(t)).cast("int")
    score = F.lit(0.0)
    for t in ("steel", "brass"):
        score = score + 2.0 * has("p_type", t) + 0.2 * has("p_name", t)
    score = score + F.when(F.col("p_brand").endswith("#12"), 10.0).otherwise(0.0)
    return p.select("p_partkey", F.round(score, 6).alias("score")).where("score > 0")
