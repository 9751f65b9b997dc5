"""DuckDB SQL for the queries that SQL can express. It goes by the definitions, not by the operators' steps,
wherever those are two things: op8 compares all pairs, op10 all strings of 100 bytes."""

from __future__ import annotations

from quillstone.llm import quality, sharding

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _md5(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15))::BIGINT"


def _lague(name: str, source: str, amount: str, blocks: str, key: str, out: str, by: str = "1") -> str:
    """CTEs that add ``out``: blocks by the highest quotients amount / (2k - 1) in each group."""
    return f"""{name}0 AS (SELECT *, sum({amount}::DOUBLE) OVER (PARTITION BY {by}) AS z_sum, count(*) OVER (PARTITION BY {by}) AS z_n FROM {source}),
 {name}1 AS (SELECT *, CASE WHEN z_sum > 0 AND {blocks} > z_n / 2.0::DOUBLE THEN floor({amount}::DOUBLE * ({blocks} - z_n / 2.0::DOUBLE) / z_sum + 0.5::DOUBLE) ELSE 0 END::BIGINT AS z_base,
   CASE WHEN z_sum > 0 THEN floor({amount}::DOUBLE * ({blocks} + z_n / 2.0::DOUBLE) / z_sum + 0.5::DOUBLE) ELSE 0 END::BIGINT + 1 AS z_top FROM {name}0),
 {name}2 AS (SELECT *, {blocks} - sum(z_base) OVER (PARTITION BY {by}) AS z_left FROM {name}1),
 {name}3 AS (SELECT *, unnest(range(z_base + 1, greatest(z_top, z_base + 1) + 1)) AS z_k FROM {name}2),
 {name}4 AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {amount}::DOUBLE / (2 * z_k - 1) DESC, {key}) <= z_left AND {amount} > 0 AS z_won FROM {name}3),
 {name} AS (SELECT * EXCLUDE (z_sum, z_n, z_base, z_top, z_left, z_k, z_nth, {out}_more, {out}_base), {out}_base + {out}_more AS {out} FROM (
   SELECT * EXCLUDE (z_won), any_value(z_base) OVER g AS {out}_base, sum(z_won::INT) OVER g AS {out}_more, row_number() OVER (PARTITION BY {by}, {key} ORDER BY z_k) AS z_nth
   FROM {name}4 WINDOW g AS (PARTITION BY {by}, {key})) WHERE z_nth = 1)"""


OP1 = f"""WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS n, {_md5("'mix'", "doc_id", "md5(text)")} AS h FROM documents),
 s0 AS (SELECT source, sum(n)::BIGINT AS size, row_number() OVER (ORDER BY source IS NULL, source) AS rnk FROM d GROUP BY source),
 s1 AS (SELECT *, ((rnk - 1) % 3 + 1)::DOUBLE AS w, size * 3.0::DOUBLE AS cap FROM s0),
 s2 AS (SELECT *, cap / w AS full_, sum(size) OVER ()::DOUBLE AS total, coalesce(sum(cap) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
   sum(w) OVER (ORDER BY cap / w, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s1),
 s3 AS (SELECT source, size, rnk, least(cap, w * coalesce(max(CASE WHEN (total - before) / rest <= full_ THEN (total - before) / rest END) OVER (), max(full_) OVER ())) AS target FROM s2),
 s4 AS (SELECT *, greatest(1, least(64, floor(coalesce(min(CASE WHEN target >= 1 THEN target END) OVER (), 1) / 32)))::BIGINT AS block FROM s3),
 s5 AS (SELECT *, round(sum(target) OVER () / block)::BIGINT AS all_ FROM s4),
 {_lague("s6", "s5", "target", "all_", "rnk", "quota")},
 s AS (SELECT source, size, rnk, target, block, quota, greatest(1, ceil(size / 65536::DOUBLE))::BIGINT AS all_shards FROM s6),
 sg AS (SELECT *, ceil(sqrt(all_shards::DOUBLE))::BIGINT AS groups, ceil(all_shards / ceil(sqrt(all_shards::DOUBLE)))::BIGINT AS shards FROM s),
 p AS (SELECT d.doc_id, d.source, d.n, d.h, s.rnk, d.h % s.groups AS grp, (d.h // s.groups) % s.shards AS shard FROM d JOIN sg s ON d.source IS NOT DISTINCT FROM s.source),
 l0 AS (SELECT rnk, grp, shard, sum(n)::BIGINT AS len FROM p GROUP BY rnk, grp, shard),
 g1 AS (SELECT g.rnk, g.grp, g.words, s.quota FROM (SELECT rnk, grp, sum(len)::BIGINT AS words FROM l0 GROUP BY rnk, grp) g JOIN s USING (rnk)),
 {_lague("g2", "g1", "words", "quota", "grp", "part", "rnk")},
 l1 AS (SELECT l0.*, g2.part, s.block, s.size, s.target FROM l0 JOIN g2 USING (rnk, grp) JOIN s USING (rnk)),
 {_lague("l2", "l1", "len", "part", "shard", "q", "rnk, grp")},
 l3 AS (SELECT *, least(q * block, len * 3) AS tokens, CASE WHEN len > 0 THEN {_md5("'mix'", "'first'", "rnk", "grp", "shard")} % ceil(len / block::DOUBLE)::BIGINT ELSE 0 END AS first FROM l2),
 l AS (SELECT rnk, grp, shard, len, size, target, CASE WHEN len > 0 THEN tokens // len ELSE 0 END AS epochs, tokens - CASE WHEN len > 0 THEN tokens // len ELSE 0 END * len AS rem, first * block AS off FROM l3),
 r AS (SELECT p.*, l.* EXCLUDE (rnk, grp, shard), sum(n) OVER (PARTITION BY p.rnk, p.grp, p.shard ORDER BY h, doc_id, n ROWS UNBOUNDED PRECEDING) - n AS begins FROM p JOIN l USING (rnk, grp, shard))
SELECT doc_id, n AS size, source, size::BIGINT AS source_size, target,
 (epochs * n + greatest(0, least(n, greatest(0, least(off + rem, len) - begins)) - least(n, greatest(0, off - begins))) + least(n, greatest(0, off + rem - len - begins)))::BIGINT AS taken FROM (SELECT * FROM r)"""

_NAMES = "[" + ", ".join(f"'{x}'" for x in sharding.names()) + "]"
_P = sharding.SLOTS

OP2 = f"""WITH RECURSIVE n AS (SELECT unnest({_NAMES}) AS name, unnest(range({sharding.SHARDS})) AS i),
 sh AS (SELECT i, {_md5("name", "'offset'")} % {_P} AS o, {_md5("name", "'skip'")} % {_P - 1} + 1 AS k FROM n),
 shi AS (SELECT sh.*, (SELECT min(x) FROM range(1, {_P}) t(x) WHERE x * k % {_P} = 1) AS inv FROM sh),
 f(t, free, slot) AS (
  SELECT -1::BIGINT, range({_P}), -1::BIGINT
  UNION ALL
  SELECT t + 1, list_filter(free, lambda x: x <> s), s FROM (
   SELECT f.t, f.free, (o + list_min(list_transform(free, lambda x: (x - o + {_P}) * inv % {_P})) * k) % {_P} AS s FROM f JOIN shi ON shi.i = (f.t + 1) % {sharding.SHARDS} WHERE f.t < {_P - 1}))
SELECT doc_id, d.slot, t % {sharding.SHARDS} AS shard FROM (SELECT doc_id, {_md5("doc_id")} % {_P} AS slot FROM documents) d JOIN f ON f.slot = d.slot"""


def _op4() -> str:
    ratios = {k: f"({hits} * {times} // greatest({units}, 1))" for k, (hits, units, times, _) in quality.RATIOS.items()}
    pairs = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS ratio, {ratios[k]} AS value, {hits} AS hits, {units} AS units FROM m WHERE NOT base_failed" for k, (hits, units, *_) in quality.RATIOS.items())

    def quantiles(name: str, keys: str) -> str:
        by = f"{keys}, ratio" if keys else "ratio"
        cols = ", ".join(f"min(CASE WHEN upto >= {q} * z.total THEN value END) AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75))
        return f"""{name} AS (SELECT {by}, max(z.total) AS docs, {cols}, sum(units) AS total, sum(CASE WHEN upto - n < {quality.TRIM} * z.total THEN hits END) AS hits, sum(CASE WHEN upto - n < {quality.TRIM} * z.total THEN units END) AS units FROM (
   SELECT {by}, n, hits, units, CASE WHEN bucket >= 0 THEN pow({quality.GAMMA}::DOUBLE, bucket + 0.5::DOUBLE) ELSE 0 END AS value, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS total
   FROM (SELECT {by}, bucket, sum(n) AS n, sum(hits) AS hits, sum(units) AS units FROM sk GROUP BY {by}, bucket)) z GROUP BY {by})"""

    names = ("docs", "q25", "q50", "q75", "total", "hits", "units")
    pick = ", ".join(f"CASE WHEN o.docs >= {quality.LEAST} THEN o.{q} WHEN l.docs >= {quality.LEAST} THEN l.{q} ELSE w.{q} END AS {q}" for q in names)
    fine, s = [], quality.SPREADS
    for k, (hits, units, _, mean) in quality.RATIOS.items():
        own = f"greatest({units}, 1)::DOUBLE"
        reach = f"{s}::DOUBLE * greatest(1::DOUBLE, sqrt(t.total::DOUBLE / t.docs::DOUBLE / {own}))"
        width = f"{quality.GAMMA - 1!r}::DOUBLE * t.q50"
        good = f"{ratios[k]} <= t.q50 + {reach} * (t.q75 - t.q50 + {width})"
        promised = f"(t.hits::DOUBLE * {own} / greatest(t.units, 1)::DOUBLE)"
        if mean:
            good += f" AND {ratios[k]} >= t.q50 - {reach} * (t.q50 - t.q25 + {width})"
        else:
            good += f" OR {hits} <= {promised} + {s}::DOUBLE * sqrt({promised}) + {s * s / 6}::DOUBLE"
        fine.append(f"bool_and(CASE WHEN t.ratio = '{k}' THEN {good} ELSE true END)")
    return rf"""WITH w0 AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM documents),
 g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM (SELECT doc_id, unnest(range(len(w) - 7)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS gram FROM w0 WHERE len(w) >= 8)),
 r AS (SELECT doc_id, sum(least(8, i - before))::BIGINT AS rep FROM (SELECT doc_id, i, lag(i, 1, -8) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g WHERE c > 1) GROUP BY doc_id),
 m0 AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
   (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words, len(ln) AS n_lines, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i-1])) AS n_same FROM w0 LEFT JOIN r USING (doc_id)),
 m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m0),
 sk AS (SELECT lang, source, ratio, bucket, count(*) AS n, sum(hits) AS hits, sum(units) AS units FROM (SELECT lang, source, ratio, hits, units, CASE WHEN value > 0 THEN floor(ln(value::DOUBLE) / ln({quality.GAMMA}::DOUBLE)) ELSE -1 END AS bucket FROM ({pairs})) GROUP BY ALL),
 {quantiles("w", "")}, {quantiles("l", "lang")}, {quantiles("o", "lang, source")},
 t AS (SELECT o.lang, o.source, o.ratio, {pick} FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.ratio = l.ratio JOIN w ON o.ratio = w.ratio),
 v AS (SELECT m.doc_id, {" AND ".join(fine)} AS fine FROM m JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source GROUP BY m.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(fine, false) AS kept FROM m LEFT JOIN v USING (doc_id)"""


OP4 = _op4()

OP8 = """WITH RECURSIVE l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
   AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.9),
 r(v, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v WHERE r.c < l.b),
 m AS (SELECT v, min(c) AS c FROM r GROUP BY v), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN m ON v = vec_id LEFT JOIN n ON n.a = vec_id"""

OP10 = """WITH b AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
 w AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(n - 99)) AS i FROM b WHERE n >= 100)),
 f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM w),
 g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM f WHERE nth > 1),
 s AS (SELECT doc_id, i, sum((before IS NULL OR i > before + 100)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
 c AS (SELECT doc_id, span, min(i) AS lo, max(i) + 100 AS hi FROM s GROUP BY doc_id, span),
 k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS upto FROM c),
 e AS (SELECT k.doc_id, sum(hi - lo)::BIGINT AS removed, count(*) AS spans, string_agg(substr(x, 2 * upto + 1, 2 * (lo - upto)), '' ORDER BY lo) || substr(any_value(x), 2 * max(hi) + 1) AS rest FROM k JOIN b USING (doc_id) GROUP BY k.doc_id)
SELECT b.doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(rest, x))) AS kept_sha256 FROM b LEFT JOIN e USING (doc_id)"""

OP11 = """WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20"""

#: CRC-32 of a list of bytes, over a table made by the polynomial's rule.
_CRC_TABLE = "(SELECT list(list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i))"


def _crc(data: str) -> str:
    return f"xor(list_reduce([4294967295] || {data}, lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"


_DIGITS = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)"


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


_RISE = "list_transform(range((len(l) + 15) // 16), lambda i: sha256(array_to_string(l[16 * i + 1 : 16 * i + 16], '')))"
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP12 = f"""WITH RECURSIVE crc AS MATERIALIZED {_CRC_TABLE},
 d0 AS MATERIALIZED (SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf(f"translate(text, {_UPPER})")} AS other, {_crc(_DIGITS)} % 5 = 0 AS hit FROM documents, crc),
 d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM d0),
 up AS (SELECT source, 0 AS k, list(leaf ORDER BY i) AS l FROM d GROUP BY source UNION ALL SELECT source, k + 1, {_RISE} FROM up WHERE len(l) > 1),
 sub AS MATERIALIZED (SELECT source, l[1] AS subroot, k AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM up WHERE len(l) = 1),
 top AS (SELECT 0 AS k, list(subroot ORDER BY i) AS l FROM sub UNION ALL SELECT k + 1, {_RISE} FROM top WHERE len(l) > 1),
 step AS (SELECT d.source, d.i AS leaf_i, u.k, l, d.i // (16 ** u.k)::BIGINT AS p FROM d JOIN up u ON d.source IS NOT DISTINCT FROM u.source WHERE len(l) > 1
  UNION ALL SELECT d.source, d.i, s.depth + t.k, l, s.i // (16 ** t.k)::BIGINT FROM d JOIN sub s ON d.source IS NOT DISTINCT FROM s.source, top t WHERE len(l) > 1),
 way AS MATERIALIZED (SELECT source, leaf_i, list({{'a': array_to_string(l[p - p % 16 + 1 : p], ''), 'b': array_to_string(l[p + 2 : p - p % 16 + 16], '')}} ORDER BY k) AS w FROM step GROUP BY source, leaf_i),
 f(source, leaf_i, k, h) AS (SELECT source, i, 0, CASE WHEN hit THEN other ELSE leaf END FROM d
  UNION ALL SELECT f.source, f.leaf_i, k + 1, sha256(w[k + 1].a || h || w[k + 1].b) FROM f JOIN way ON f.source IS NOT DISTINCT FROM way.source AND f.leaf_i = way.leaf_i WHERE k < len(w)),
 last AS (SELECT source, leaf_i, arg_max(h, k) AS h FROM f GROUP BY source, leaf_i),
 root AS (SELECT l[1] AS root FROM top WHERE len(l) = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(w, lambda x: x.a || x.b), ''), '')) AS proof_sha256, h AS folded_root, h = root AS verified
 FROM d JOIN sub s ON d.source IS NOT DISTINCT FROM s.source JOIN last ON last.source IS NOT DISTINCT FROM d.source AND last.leaf_i = d.i LEFT JOIN way ON way.source IS NOT DISTINCT FROM d.source AND way.leaf_i = d.i, root"""


def _features(table: str, key: str) -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"(SELECT {key}, len(w) AS n_words, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM (SELECT {key}, {words} AS w FROM {table}))"


_BYTES = "list_transform(range(strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), (2 * i + 1)::INT, 2))::BIGINT)"

OP13 = f"""WITH crc AS MATERIALIZED {_CRC_TABLE},
 d AS MATERIALIZED {_features("documents", "doc_id")}, b AS MATERIALIZED {_features("benchmark", "item_id")},
 h AS MATERIALIZED (SELECT f, {_crc(_BYTES)} % 10000 AS bucket FROM (SELECT f FROM d UNION SELECT f FROM b), crc),
 s AS (SELECT bucket, count(*)::DOUBLE AS s FROM d JOIN h USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*)::DOUBLE AS t FROM b JOIN h USING (f) GROUP BY bucket),
 g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT count(*) FROM d) + 10000.0::DOUBLE) / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM b) + 10000.0::DOUBLE))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
 w AS (SELECT doc_id, count(*) AS n_features, any_value(n_words) AS n_words, floor(sum(gain) / count(*)::DOUBLE)::BIGINT AS weight FROM d JOIN h USING (f) JOIN g USING (bucket) GROUP BY doc_id),
 a AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(n_words, 0) AS n_words, coalesce(weight, 0) AS weight,
   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN w USING (doc_id)),
 r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM a WHERE n_words >= 20)
SELECT a.doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM a LEFT JOIN r USING (doc_id)"""

ORACLES = {"op1_mixing": OP1, "op2_sharding": OP2, "op4_quality": OP4, "op8_vectors": OP8, "op10_suffixes": OP10, "op11_topk": OP11, "op12_manifest": OP12, "op13_resampling": OP13}
