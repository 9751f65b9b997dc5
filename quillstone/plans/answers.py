"""Queries of answer checking, evaluation, usage, conversations and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.catalog import query, read
from quillstone.functions import text as tx
from quillstone.operators import evaluate, support, verify
from quillstone.operators import search as s
from quillstone.operators.bounds import small
from quillstone.plans.search import _bm25_sql, _index, _questions
from quillstone.session import written
from quillstone.streaming import events as ev

# Answers made of order lines: an order is an answer, its lines are claims and sources.
_CLAIMS = "SELECT l_orderkey AS answer_id, l_linenumber AS claim_id, 'value ' || l_quantity::INT || ' and ' || (l_linenumber * 100) || ' hold' AS text, CASE WHEN l_linenumber % 4 = 3 THEN [] WHEN l_linenumber % 4 = 2 THEN [l_linenumber, 99] ELSE [l_linenumber] END AS cites FROM lineitem"
_SOURCES = "SELECT l_orderkey AS answer_id, l_linenumber AS n, CASE l_returnflag WHEN 'A' THEN 'document' WHEN 'N' THEN 'user' ELSE 'calc' END AS kind, l_linestatus = 'O' AS verified, 'states ' || CASE WHEN l_tax > 0.04 THEN l_quantity::INT ELSE 7777 END || ' and ' || (l_linenumber * 100) AS text, l_suppkey AS doc_id FROM lineitem"


def _lines(spark, sf, whole=False, rows=None):
    """One row for each line number of an order: the least by content. whole: an order's lines lie together, so that
    what follows by order needs no further shuffle. rows: so they do, and a task has about as many rows at most."""
    li = read(spark, sf, "lineitem")
    li = li.repartition("l_orderkey") if whole else li
    li = li.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-li.count() // rows)), "l_orderkey") if rows else li
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.withColumn("nth", F.row_number().over(w)).where("nth = 1")


_ONE = "(SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1)"
_CLAIMS, _SOURCES = _CLAIMS.replace("FROM lineitem", f"FROM {_ONE}"), _SOURCES.replace("FROM lineitem", f"FROM {_ONE}")


def _claims_and_sources(spark, sf):
    li = _lines(spark, sf)
    c = li.selectExpr(
        "l_orderkey as answer_id", "l_linenumber as claim_id", "concat('value ', int(l_quantity), ' and ', l_linenumber * 100, ' hold') as text",
        "case when l_linenumber % 4 = 3 then cast(array() as array<int>) when l_linenumber % 4 = 2 then array(l_linenumber, 99) else array(l_linenumber) end as cites",
    )
    src = li.selectExpr(
        "l_orderkey as answer_id", "l_linenumber as n", "case l_returnflag when 'A' then 'document' when 'N' then 'user' else 'calc' end as kind", "l_linestatus = 'O' as verified",
        "concat('states ', case when l_tax > 0.04 then int(l_quantity) else 7777 end, ' and ', l_linenumber * 100) as text", "l_suppkey as doc_id",
    )
    return c, src


_CHECKED = f"""c AS ({_CLAIMS}), s AS ({_SOURCES}), e AS (SELECT answer_id, claim_id, unnest(cites) AS n FROM c),
 j AS (SELECT e.answer_id, e.claim_id, count(*) AS asked, count(s.kind) AS there, count(*) FILTER (NOT s.verified) AS bad, string_agg(s.text, chr(10)) AS hay, min(CASE s.kind WHEN 'document' THEN 0 WHEN 'user' THEN 1 WHEN 'calc' THEN 2 END) AS p FROM e LEFT JOIN s USING (answer_id, n) GROUP BY ALL),
 x AS (SELECT c.answer_id, c.claim_id, coalesce(asked, 0) AS asked, coalesce(there, 0) AS there, coalesce(bad, 0) AS bad, p, len(list_filter(list_filter(regexp_extract_all(c.text, '[0-9]+'), lambda v: length(v) > 1), lambda v: NOT regexp_matches(coalesce(hay, ''), '(^|[^0-9])' || v || '($|[^0-9])'))) AS missing FROM c LEFT JOIN j USING (answer_id, claim_id)),
 k AS (SELECT answer_id, claim_id, list_filter([CASE WHEN asked = 0 THEN 'no_citation' END, CASE WHEN there < asked THEN 'invalid_citation' END, CASE WHEN bad > 0 THEN 'unverified_source' END, CASE WHEN there > 0 AND missing > 0 THEN 'value_missing' END], lambda v: v IS NOT NULL) AS codes, ['document', 'user', 'calc'][p + 1] AS provenance FROM x)"""


@query(f"WITH {_CHECKED} SELECT CASE WHEN len(codes) = 0 THEN 'pending' ELSE 'unsupported' END AS status, array_to_string(codes, ',') AS codes, count(*) AS n FROM k GROUP BY ALL")
def claim_status_counts(spark, sf):
    out = verify.check(*_claims_and_sources(spark, sf))
    return out.groupBy("status", F.array_join("codes", ",").alias("codes")).agg(F.count("*").alias("n"))


@query(f"WITH {_CHECKED} SELECT answer_id, claim_id, provenance FROM k")
def provenance_priority(spark, sf):
    return verify.check(*_claims_and_sources(spark, sf)).select("answer_id", "claim_id", "provenance")


@query(f"WITH {_CHECKED} SELECT answer_id, claim_id, 50 AS add FROM k WHERE len(codes) = 1 AND codes[1] = 'value_missing'")
def citation_repair(spark, sf):
    """Claims that lack a value take the one further source that has it: no other line's source has both of their numbers."""
    c, src = _claims_and_sources(spark, sf)
    # One more source for each answer, in which all its values stand.
    every = c.groupBy("answer_id").agg(F.array_join(F.array_sort(F.collect_list("text")), "; ").alias("text"))
    more = every.select("answer_id", F.lit(50).alias("n"), F.lit("document").alias("kind"), F.lit(True).alias("verified"), "text", F.lit(1).cast("long").alias("doc_id"))
    src = src.unionByName(more)
    return verify.repair(verify.check(c, src), c, src)


_GIVEN = "SELECT l_orderkey AS answer_id, l_linenumber AS claim_id, CASE WHEN l_quantity < 30 THEN 'supported' WHEN l_quantity < 40 THEN 'unsupported' ELSE 'maybe' END AS verdict FROM lineitem WHERE l_tax < 0.06"


def _given(spark, sf):
    return read(spark, sf, "lineitem").where("l_tax < 0.06").selectExpr("l_orderkey as answer_id", "l_linenumber as claim_id", "case when l_quantity < 30 then 'supported' when l_quantity < 40 then 'unsupported' else 'maybe' end as verdict")


_VERDICTS = f"""c AS ({_CLAIMS}), g AS (SELECT answer_id, claim_id, count(*) AS times, min(verdict) AS v FROM ({_GIVEN}) GROUP BY ALL),
 v AS (SELECT c.answer_id, c.claim_id, CASE WHEN times IS NULL THEN 'missing' WHEN times > 1 OR v NOT IN ('supported', 'partial', 'unsupported') THEN 'invalid' ELSE v END AS verdict FROM c LEFT JOIN g USING (answer_id, claim_id))"""


@query(f"WITH {_VERDICTS} SELECT answer_id, claim_id, verdict FROM v")
def strict_verdicts(spark, sf):
    return verify.verdicts(_claims_and_sources(spark, sf)[0], _given(spark, sf))


@query(f"""WITH {_VERDICTS}, n AS (SELECT answer_id, count(*) FILTER (verdict = 'supported') AS kept, count(*) FILTER (verdict IN ('missing', 'invalid')) AS flagged, count(*) FILTER (verdict IN ('partial', 'unsupported')) AS dropped FROM v GROUP BY answer_id)
SELECT answer_id, CASE WHEN kept = 0 AND flagged = 0 THEN 'not_found' WHEN kept = 0 THEN 'unverified' WHEN flagged > 0 THEN 'warning' WHEN dropped > 0 THEN 'corrected' ELSE 'supported' END AS status, kept, flagged, dropped FROM n""")
def answer_status(spark, sf):
    return verify.compose(verify.verdicts(_claims_and_sources(spark, sf)[0], _given(spark, sf)))


@query()
def answer_claims(spark, sf):
    """Rows only: a parser of Markdown."""
    made = F.expr("concat('# Head\n', text, ' [1]\n\n| a | b |\n|---|---|\n| x | 5 ns [2-3] |\n```\ncode 7\n```\n- item e.g. this one [', turn, ']. And next.')")
    c = read(spark, sf, "conversations").select("conv_id", "turn", F.explode(verify.parse_claims(made)).alias("c"))
    return c.select("conv_id", "turn", "c.line", "c.kind", "c.text", F.array_join(F.transform("c.cites", lambda x: x.cast("string")), ",").alias("cites"), "c.section")


@query()
def support_units(spark, sf):
    """The fewest sentences and rows of the first document that holds a passage which carry it. Rows only: a technical term is told by its capitals."""
    d = read(spark, sf, "documents").select("doc_id", "text")
    b = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("needle"))
    pairs = s.containing(_index(spark, sf), d, b).join(small(b), "query_id").select(F.col("query_id").alias("claim_id"), "doc_id", F.col("needle").alias("text"))
    first = pairs.groupBy("claim_id").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("x")).select("claim_id", "x.doc_id", "x.text")
    first = written(first, "first")
    held = d.join(small(first.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", F.posexplode(verify.units("text")).alias("unit_id", "x"))
    units = written(held.select("doc_id", "unit_id", "x.kind", "x.text", "x.header"), "units")
    return support.cover(first, units).select("claim_id", F.col("unit_id").cast("int").alias("unit_id"), "score", (F.col("nth") + 1).cast("int").alias("nth"))


def _ranked(spark, sf):
    """The rank of the first document that holds the passage, for each passage that some document holds."""
    d, b = read(spark, sf, "documents").select("doc_id", "text"), read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("needle"))
    gold = written(s.containing(_index(spark, sf), d, b), "gold")
    hits = s.bm25(_index(spark, sf), "doc_id", {"text": 1.0}, _questions(spark, sf), 8)
    first = hits.join(gold, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return gold.select("query_id").distinct().join(first, "query_id", "left")


@query(f"""WITH gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), h AS ({_bm25_sql({"text": 1.0}, 8, columns="query_id, doc_id, rank")}),
 f AS (SELECT query_id, min(rank) AS r FROM h JOIN gold USING (query_id, doc_id) GROUP BY query_id), q AS (SELECT DISTINCT query_id FROM gold), j AS (SELECT r FROM q LEFT JOIN f USING (query_id))
SELECT count(*) AS n, round(avg(coalesce((r <= 1)::INT, 0)), 3) AS recall_1, round(avg(coalesce((r <= 3)::INT, 0)), 3) AS recall_3, round(avg(coalesce((r <= 5)::INT, 0)), 3) AS recall_5, round(avg(coalesce((r <= 8)::INT, 0)), 3) AS recall_8, round(avg(coalesce(1.0::DOUBLE / r, 0)), 3) AS mrr FROM j""")
def recall_at_k_mrr(spark, sf):
    return evaluate.retrieval(_ranked(spark, sf), "first_rank")


_RESULTS = """SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN 'x' END AS error, doc_id % 5 <> 0 AS answerable, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE toxic = 0 END AS answered,
 CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality = 1 END AS correct, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE toxic = 0 AND quality = 0 END AS wrong, doc_id % 7 = 0 AS clarified, doc_id % 4 = 0 AS clarify,
 CASE WHEN doc_id % 2 = 0 THEN quality = 1 END AS source_correct, CASE WHEN doc_id < 0 THEN true END AS page_correct FROM labels"""


def _results(spark, sf):
    return read(spark, sf, "labels").selectExpr(
        "case when doc_id % 23 = 0 then 'x' end as error", "doc_id % 5 <> 0 as answerable", "case when doc_id % 11 = 0 then null else toxic = 0 end as answered",
        "case when doc_id % 3 = 0 then null else quality = 1 end as correct", "case when doc_id % 3 = 0 then null else toxic = 0 and quality = 0 end as wrong", "doc_id % 7 = 0 as clarified",
        "doc_id % 4 = 0 as clarify", "case when doc_id % 2 = 0 then quality = 1 end as source_correct", "case when doc_id < 0 then true end as page_correct",
    )


@query(f"WITH r AS ({_RESULTS}) " + " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) FILTER (coalesce({a}, false) AND coalesce({b}, false)) AS num, count(*) FILTER (coalesce({b}, false)) AS den, round(count(*) FILTER (coalesce({a}, false) AND coalesce({b}, false)) / nullif(count(*) FILTER (coalesce({b}, false)), 0), 3) AS rate FROM r WHERE error IS NULL" for k, (a, b) in evaluate.ANSWER.items()))
def answer_rates(spark, sf):
    """A rate over nothing is null (page_accuracy here)."""
    return evaluate.answers(_results(spark, sf))


@query("SELECT user_id, count(*) AS questions, sum(floor(value + 0.5))::BIGINT AS tokens, floor(sum(floor(value + 0.5)) / count(*) + 0.5)::BIGINT AS mean_tokens, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id")
def usage_per_user(spark, sf):
    n = F.floor(F.col("value") + 0.5).cast("long")
    g = read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("questions"), F.sum(n).alias("tokens"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    return g.select("user_id", "questions", "tokens", F.floor(F.col("tokens") / F.col("questions") + 0.5).cast("long").alias("mean_tokens"), "last_type")


@query("""WITH c AS (SELECT event_type AS stage, value AS seconds, CASE WHEN event_id % 3 = 0 THEN value * 0.25 END AS first_token, (event_id % 500) AS tokens, event_id % 9 <> 0 AS ok FROM events)
SELECT stage, count(*) AS calls, round(sum(seconds), 3) AS seconds, round(max(first_token), 3) AS first_token, sum(tokens)::BIGINT AS tokens, count(*) FILTER (NOT ok) AS failed,
 round(sum(tokens) / CASE WHEN sum(greatest(0, seconds - coalesce(first_token, 0))) > 0.05 THEN sum(greatest(0, seconds - coalesce(first_token, 0))) END, 4) AS tokens_per_s FROM c GROUP BY stage""")
def call_telemetry(spark, sf):
    c = read(spark, sf, "events").selectExpr("event_type as stage", "value as seconds", "case when event_id % 3 = 0 then value * 0.25 end as first_token", "event_id % 500 as tokens", "event_id % 9 <> 0 as ok")
    busy = F.sum(F.greatest(F.lit(0.0), F.col("seconds") - F.coalesce("first_token", F.lit(0.0))))
    g = c.groupBy("stage").agg(F.count("*").alias("calls"), F.round(F.sum("seconds"), 3).alias("seconds"), F.round(F.max("first_token"), 3).alias("first_token"), F.sum("tokens").alias("t"), F.count_if(~F.col("ok")).alias("failed"), busy.alias("busy"))
    return g.select("stage", "calls", "seconds", "first_token", F.col("t").alias("tokens"), "failed", F.round(F.try_divide(F.col("t"), F.when(F.col("busy") > 0.05, F.col("busy"))), 4).alias("tokens_per_s"))


@query("SELECT count(*) AS n, count(*) FILTER (event_type IN ('click', 'purchase')) AS up, count(*) FILTER (value < 20) AS down, count(DISTINCT user_id) AS users FROM events")
def feedback_summary(spark, sf):
    e = read(spark, sf, "events")
    return e.agg(F.count("*").alias("n"), F.count_if(F.col("event_type").isin("click", "purchase")).alias("up"), F.count_if(F.col("value") < 20).alias("down"), F.countDistinct("user_id").alias("users"))


@query(r"""SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN left(t, 400) ELSE t END AS text FROM (SELECT *, regexp_replace(text, '\[\d+(?:\s*[,–-]\s*\d+)*\]', '', 'g') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations) WHERE nth <= 6""")
def conversation_tail(spark, sf):
    """The last six messages, without citations; an assistant's are cut."""
    c = s.top(read(spark, sf, "conversations"), ["conv_id"], [F.desc("turn")], 6)
    t = F.regexp_replace("text", r"\[\d+(?:\s*[,–-]\s*\d+)*\]", "")
    return c.select("conv_id", "turn", "role", F.when(F.col("role") == "assistant", F.substring(t, 1, 400)).otherwise(t).alias("text"))


@query(r"""WITH u AS (SELECT conv_id, turn, regexp_extract(lower(text), '\b(the|and|of)\b') AS e, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations WHERE role = 'user')
SELECT conv_id, arg_max(e, turn) AS entity FROM u WHERE nth <= 3 AND e <> '' GROUP BY conv_id""")
def entity_carry_over(spark, sf):
    """The entity that the latest of the last three questions names."""
    u = s.top(read(spark, sf, "conversations").where("role = 'user'"), ["conv_id"], [F.desc("turn")], 3)
    u = u.select("conv_id", "turn", F.regexp_extract(F.lower("text"), r"\b(the|and|of)\b", 0).alias("e")).where("e <> ''")
    return u.groupBy("conv_id").agg(F.max_by("e", "turn").alias("entity"))


_DAYS = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def _day(df):
    return df.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(_DAYS)
def usage_stream_tumbling(spark, sf):
    """The stream itself, in complete mode, so that no window stays open."""
    return _day(ev.run_available(spark, f"{sf}/events.parquet", ev.tumbling, "complete"))


@query(_DAYS)
def usage_batch_tumbling(spark, sf):
    return _day(ev.tumbling(read(spark, sf, "events")))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM i GROUP BY user_id, island""")
def usage_stream_session(spark, sf):
    """The stream itself, in complete mode, so that no session stays open."""
    out = ev.run_available(spark, f"{sf}/events.parquet", ev.sessions, "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def usage_stream_totals(spark, sf):
    return ev.run_available(spark, f"{sf}/events.parquet", ev.totals, "complete").withColumn("total", F.round("total", 4))


@query("SELECT event_id FROM events")
def dedup_stream(spark, sf):
    """Every event twice in the stream, once in what comes out."""
    twice = lambda e: ev.once(e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))), ["event_id"]).select("event_id")
    return ev.run_available(spark, f"{sf}/events.parquet", twice, "append").select("event_id")


@query("SELECT event_id AS stream_id, 'for ' || event_type || (CASE WHEN event_id % 4 = 0 THEN '' ELSE ' end' END) AS answer, 'of ' || user_id || (CASE WHEN event_id % 4 = 0 THEN ' end' ELSE '' END) AS thoughts FROM events")
def think_split_stream(spark, sf):
    """Answers that arrive in pieces of five characters; one in four never closes its thought."""
    whole = F.expr("concat('for ', event_type, '<think>of ', user_id, case when event_id % 4 = 0 then '' else '</think>' end, ' end')")
    cut = lambda e: ev.split_thoughts(e.withColumn("t", whole).select(F.col("event_id").alias("stream_id"), F.posexplode(F.regexp_extract_all("t", F.lit("(?s).{1,5}"), F.lit(0))).alias("at", "text")))
    return ev.run_available(spark, f"{sf}/events.parquet", cut, "complete")
