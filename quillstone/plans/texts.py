"""Queries of text functions, cleaning, chunking, units, and loaders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.catalog import query, read
from quillstone.functions import text as tx
from quillstone.functions import units as un
from quillstone.operators import chunking, cleaning
from quillstone.plans.adapters import LINES, blocks, lines
from quillstone.sources import loaders


def _docs(spark, sf, **cols):
    return read(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in cols.items()])


@query(r"SELECT doc_id, greatest(length(text)//4, floor(len(regexp_extract_all(text, '\S+'))*1.3))::BIGINT AS tokens FROM documents")
def estimate_tokens(spark, sf):
    return _docs(spark, sf, tokens=tx.estimate_tokens(F.col("text")))


def _replace(x: str) -> str:
    for a, b in tx.LIGATURES:
        x = f"replace({x}, '{a}', '{b}')"
    return x


_NORMAL = f"""regexp_replace(regexp_replace(replace(replace(replace({_replace("text || chr(13) || chr(10) || '  ﬁx  termi-' || chr(10) || 'nation  '")}, chr(173), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)),
  '([a-z]{{2,}})-\n([a-z]{{2,}})', '\\1\\2', 'g'), '[ \t  -   　]+', ' ', 'g')"""


@query(f"""SELECT doc_id, trim(trim(regexp_replace(array_to_string(list_transform(string_split({_NORMAL}, chr(10)), lambda x: trim(x)), chr(10)), '\n{{3,}}', '\n\n', 'g'), chr(10) || ' ')) AS text FROM documents""")
def normalize_text(spark, sf):
    raw = F.concat("text", F.lit("\r\n  ﬁx  termi-\nnation  "))
    return _docs(spark, sf, text=tx.normalize(raw))


@query("SELECT doc_id, lower(translate(text, 'çÇğĞıIİöÖşŞüÜâîû', 'ccggiiioossuuaiu')) AS folded FROM documents")
def fold_letters(spark, sf):
    return _docs(spark, sf, folded=tx.fold(F.col("text")))


_TR = "[" + ", ".join(f"'{w}'" for w in tx.TURKISH_WORDS) + "]"


@query(rf"SELECT doc_id, CASE WHEN regexp_matches(text, '[{tx.TURKISH_LETTERS}]') OR list_has_any(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), {_TR}) THEN 'tr' ELSE 'en' END AS language FROM documents")
def detect_language(spark, sf):
    return _docs(spark, sf, language=tx.detect_language(F.col("text")))


@query(rf"WITH {LINES} SELECT doc_id, line_no, trim(regexp_replace(lower(line), '[ \t]+', ' ', 'g')) AS e_key, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '(^|[^\p{{L}}\p{{N}}_])[ivxlc]+($|[^\p{{L}}\p{{N}}_])', '\1#\2', 'g'), '(^|[^\p{{L}}\p{{N}}_])[ivxlc]+($|[^\p{{L}}\p{{N}}_])', '\1#\2', 'g'), '[ \t]+', ' ', 'g')) AS n_key FROM lines")
def number_key(spark, sf):
    return lines(spark, sf).select("doc_id", "line_no", tx.exact_key(F.col("line")).alias("e_key"), tx.number_key(F.col("line")).alias("n_key"))


def _scrub_sql(x: str) -> str:
    for pattern, new in tx.SCRUB:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{new.replace('$1', chr(92) + '1')}', 'g')"
    return x


_DIRTY = "'api_key=abc123 at https://host.example/x?y=1 key sk-abcdefgh1234 ' || text"


@query(rf"SELECT doc_id, substring(trim(regexp_replace({_scrub_sql(_DIRTY)}, '[ \t\n\r]+', ' ', 'g')), 1, 300) AS message FROM documents")
def scrub_documents(spark, sf):
    raw = F.concat(F.lit("api_key=abc123 at https://host.example/x?y=1 key sk-abcdefgh1234 "), F.col("text"))
    return _docs(spark, sf, message=tx.scrub(raw))


_CITED = "'see [' || (turn % 9) || '] and [' || turn || ',' || (turn + 2) || '-' || (turn + 4) || '] or [7-3] ' || text"


@query(rf"""WITH g AS (SELECT conv_id, turn, unnest(regexp_extract_all({_CITED}, '\[(\d+(?:\s*[,–-]\s*\d+)*)\]', 1)) AS g FROM conversations),
 p AS (SELECT conv_id, turn, trim(unnest(string_split(g, ','))) AS p FROM g)
SELECT conv_id, turn, p::INT AS n FROM p WHERE regexp_full_match(p, '\d+') UNION ALL
SELECT conv_id, turn, unnest(range(a, b + 1))::INT FROM (SELECT conv_id, turn, regexp_extract(p, '^(\d+)', 1)::INT AS a, regexp_extract(p, '(\d+)$', 1)::INT AS b FROM p WHERE NOT regexp_full_match(p, '\d+')) WHERE b > a AND b - a < 50""")
def citations_expand(spark, sf):
    c = read(spark, sf, "conversations")
    raw = F.expr("concat('see [', turn % 9, '] and [', turn, ',', turn + 2, '-', turn + 4, '] or [7-3] ', text)")
    return c.select("conv_id", "turn", F.explode(tx.citations(raw)).alias("n"))


@query()
def bare_numbers(spark, sf):
    """No SQL: needs look-behind."""
    c = read(spark, sf, "conversations").select("conv_id", "turn", F.expr("concat('1. takes 12,5 or 0x1F of [3] in ', turn, ' and ', conv_id * 7, '.5: ', text)").alias("text"))
    return c.select("conv_id", "turn", F.explode(tx.bare_numbers(F.col("text"))).alias("number"))


@query()
def sentence_split(spark, sf):
    """No SQL: needs look-behind and a fold."""
    d = read(spark, sf, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("nth", "sentence"))
    return d.select("doc_id", "nth", "sentence")


def _parts(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.expr("concat('t', p_size, ' is ', p_size * 10, ' ns or ', p_partkey % 7, ',', p_size % 10, ' µs at ', p_size, '.', p_partkey % 10, '-V, 1,200 mA to 3 A')").alias("text"))


@query()
def quantities(spark, sf):
    """No SQL: a pattern with look-behind, and several readings of a number."""
    return _parts(spark, sf).select("p_partkey", F.explode(un.find_quantities("text")).alias("q")).select("p_partkey", "q.*")


@query("SELECT p_partkey, true AS agrees FROM part")
def quantity_match(spark, sf):
    """Parts whose quantities agree with what another spelling of the value gives."""
    want = read(spark, sf, "part").select("p_partkey", F.expr("concat(p_size / 100, ' µs')").alias("want"))
    q = _parts(spark, sf).join(want, "p_partkey").select("p_partkey", un.find_quantities("text").alias("a"), un.find_quantities("want").alias("b"))
    return q.select("p_partkey", F.exists("a", lambda x: F.exists("b", lambda y: un.same(x, y))).alias("agrees"))


_UNIT_ROWS = ", ".join(f"('{u}', '{b}', {f!r}::DOUBLE)" for u, (b, f) in sorted(un.TABLE.items()))


@query(f"""WITH u(unit, base, factor) AS (VALUES {_UNIT_ROWS}), p AS (SELECT p_partkey, p_size, ['ns', 'mV', 'kHz', 'Gb/s', 'inch', 'zz'][(p_partkey % 6 + 1)::INT] AS unit FROM part)
SELECT p_partkey, p.unit, base, p_size * factor AS si FROM p LEFT JOIN u ON u.unit = p.unit""")
def to_si(spark, sf):
    names = F.array(*[F.lit(x) for x in ("ns", "mV", "kHz", "Gb/s", "inch", "zz")])
    p = read(spark, sf, "part").select("p_partkey", "p_size", F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int")).alias("unit"))
    return p.select("p_partkey", "unit", un.unit_column(F.col("unit"))["base"].alias("base"), un.to_si(F.col("p_size"), F.col("unit")).alias("si"))


_KIND = "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN p_size || ' - ' || (p_size + 3) WHEN 3 THEN '0.5*x' ELSE '-' || p_size || ',5' END"


@query(rf"""WITH p AS (SELECT p_partkey, {_KIND} AS v FROM part) SELECT p_partkey, CASE WHEN trim(v) IN ('', '-', '–', '—') THEN 'empty' WHEN regexp_full_match(trim(v), '[-+±]?\d+(?:[.,]\d+)*') THEN 'number'
  WHEN regexp_full_match(trim(v), '[-+±]?\d+(?:[.,]\d+)*\s*(?:-|–|to|~|\.\.\.?)\s*[-+±]?\d+(?:[.,]\d+)*') THEN 'range' WHEN regexp_matches(v, '\d') THEN 'expression' ELSE 'empty' END AS kind FROM p""")
def value_kind(spark, sf):
    v = F.expr("case p_partkey % 5 when 0 then '' when 1 then string(p_size) when 2 then concat(p_size, ' - ', p_size + 3) when 3 then '0.5*x' else concat('-', p_size, ',5') end")
    return read(spark, sf, "part").select("p_partkey", un.value_kind(v).alias("kind"))


# Pages of eight lines with a header and a footer: the documents have neither.
def _paged(spark, sf):
    d = lines(spark, sf).select("doc_id", "line_no", "line", (F.floor((F.col("line_no") - 1) / 8) + 1).alias("page"))
    p = d.select("doc_id", "page").distinct()
    head = p.select("doc_id", "page", (F.col("page") * 1000).alias("line_no"), F.expr("concat('Document ', doc_id, ' rev A')").alias("line"))
    foot = p.select("doc_id", "page", (F.col("page") * 1000 + 999).alias("line_no"), F.expr("concat('Page ', page, ' of 99')").alias("line"))
    body = d.select("doc_id", "page", (F.col("page") * 1000 + F.col("line_no") % 8 + 1).alias("line_no"), "line")
    return head.unionByName(body).unionByName(foot)


_PAGED = f"""{LINES}, d AS (SELECT doc_id, line_no, line, (line_no-1)//8 + 1 AS page FROM lines),
 pg AS (SELECT DISTINCT doc_id, page FROM d),
 paged AS (SELECT doc_id, page, page*1000 AS line_no, 'Document ' || doc_id || ' rev A' AS line FROM pg UNION ALL SELECT doc_id, page, page*1000 + line_no % 8 + 1, line FROM d UNION ALL SELECT doc_id, page, page*1000 + 999, 'Page ' || page || ' of 99' FROM pg),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no DESC) AS b,
   trim(regexp_replace(lower(line), '[ \\t]+', ' ', 'g')) AS e, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '(^|[^\\p{{L}}\\p{{N}}_])[ivxlc]+($|[^\\p{{L}}\\p{{N}}_])', '\\1#\\2', 'g'), '(^|[^\\p{{L}}\\p{{N}}_])[ivxlc]+($|[^\\p{{L}}\\p{{N}}_])', '\\1#\\2', 'g'), '[ \\t]+', ' ', 'g')) AS n FROM paged),
 kk AS (SELECT doc_id, page, line_no, line, (a = 1 OR b = 1) AS outer_, CASE WHEN (a <= 3 OR b <= 3) AND e <> '' THEN e END AS e_key,
   CASE WHEN (a = 1 OR b = 1) AND n <> '' AND len(regexp_extract_all(line, '\\S+')) <= 10 THEN n END AS n_key, CASE WHEN a = 1 OR b = 1 THEN n END AS n_all FROM k)"""


@query(f"WITH {_PAGED} SELECT doc_id, line_no, e_key, n_key FROM kk")
def header_footer_keys(spark, sf):
    return cleaning.edge_keys(_paged(spark, sf)).select("doc_id", "line_no", "e_key", "n_key")


@query(f"""WITH {_PAGED}, p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM kk GROUP BY doc_id),
 ec AS (SELECT doc_id, e_key, count(DISTINCT page) AS c FROM kk WHERE e_key IS NOT NULL GROUP BY doc_id, e_key), nc AS (SELECT doc_id, n_key, count(DISTINCT page) AS c FROM kk WHERE n_key IS NOT NULL GROUP BY doc_id, n_key)
SELECT kk.doc_id, kk.line_no, kk.line FROM kk JOIN p USING (doc_id) LEFT JOIN ec ON ec.doc_id = kk.doc_id AND ec.e_key = kk.e_key LEFT JOIN nc ON nc.doc_id = kk.doc_id AND nc.n_key = kk.n_all
WHERE NOT (pages >= 4 AND (coalesce(ec.c >= greatest(3, floor(0.08 * pages)), false) OR (outer_ AND (coalesce(nc.c >= greatest(3, floor(0.08 * pages)), false) OR coalesce(n_all = '#', false)))))""")
def header_footer_removed(spark, sf):
    return cleaning.headers_footers(_paged(spark, sf)).where("not dropped").select("doc_id", "line_no", "line")


@query(rf"""WITH {LINES}, t AS (SELECT doc_id, page, CASE WHEN doc_id % 4 = 0 THEN line || ' ....... ' || line_no ELSE line END AS line FROM lines),
 g AS (SELECT doc_id, page, count(*) FILTER (regexp_matches(line, '(\.\s?){{4,}}\s*[0-9ivxlcIVXLC]+\s*$|\s{{3,}}[0-9]+\s*$')) AS hits, count(*) AS lines FROM t WHERE trim(line) <> '' GROUP BY doc_id, page)
SELECT doc_id, page, hits, lines FROM g WHERE lines >= 5 AND hits >= 0.4 * lines""")
def toc_like_pages(spark, sf):
    line = F.expr("case when doc_id % 4 = 0 then concat(line, ' ....... ', line_no) else line end")
    return cleaning.toc_pages(lines(spark, sf).withColumn("line", line))


def _headed(spark, sf):
    """Lines with headings made from their numbers."""
    made = F.expr("case line_no % 6 when 1 then concat(line_no, ' Part Of Things') when 2 then concat(line_no % 40, '.', line_no % 3 + 1, ' Detail Of Matter') when 3 then '### Third level' when 4 then 'Appendix B Compliance' when 5 then '3.3 V supply rail' else line end")
    return lines(spark, sf).withColumn("line", made).withColumn("h", cleaning.heading(F.col("line"), F.lit(True)))


@query()
def headings(spark, sf):
    return _headed(spark, sf).where("h is not null").select("doc_id", "line_no", "h.level", "h.title")


@query()
def section_stack(spark, sf):
    b = _headed(spark, sf).select("doc_id", "line_no", F.col("h.level").alias("level"), F.col("h.title").alias("title"))
    return cleaning.section_stack(b, ["doc_id"], "line_no").select("doc_id", "line_no", cleaning.section_label(F.col("section")).alias("section"))


@query()
def chunk_adaptive(spark, sf):
    """No SQL: each chunk depends on the one before."""
    return chunking.chunk_documents(blocks(spark, sf))


@query()
def html_to_text(spark, sf):
    return loaders.html_blocks(read(spark, sf, "pages"), "page_id", "html")


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages")
def html_title(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages""")
def html_links(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))


@query()
def hash_embed(spark, sf):
    """No SQL: keyed hashes of words and trigrams."""
    return loaders.hash_embedding(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 64)
