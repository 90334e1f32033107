"""Single look-ups, checks, views, windows and text rules as queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import entities as E
from ..operators import facts as FA
from ..operators import messages as M
from ..operators import relationships as R
from ..operators import temporal as T
from ..operators import views as V
from ..streaming import ingest as I
from . import extraction as X
from . import fixtures as FX
from .fixtures import A_SQL, N_SQL, R_SQL, table

ENTITY = ["id", "tenant_id", "entity_type", "canonical_name", "conversation_id"]
_ENT = ", ".join(ENTITY)


def people(spark, sf_dir):
    return E.upsert(FX.arrivals(spark, sf_dir))


def edges(spark, sf_dir):
    return R.resolve(FX.assertions(spark, sf_dir))


def entity_by_name(spark, sf_dir):
    return E.by_name(people(spark, sf_dir), "t1", "c2024-01-01", "user-1").select(*ENTITY)


BY_NAME_SQL = f"WITH {N_SQL} SELECT {_ENT} FROM ent WHERE tenant_id = 't1' AND conversation_id = 'c2024-01-01' AND canonical_name = 'user-1' ORDER BY created_at, id LIMIT 1"


def resolved_entity(spark, sf_dir):
    return E.resolve_entity(people(spark, sf_dir), "t1", "user-1").select(*ENTITY)


RESOLVED_SQL = f"""WITH {N_SQL}, pool AS (SELECT ent.*, aliases FROM ent JOIN al USING (id) WHERE tenant_id = 't1' ORDER BY created_at DESC, id LIMIT 1000)
SELECT {_ENT} FROM pool WHERE contains(lower(canonical_name), 'user-1') OR len(list_filter(aliases, lambda x: contains(lower(x), 'user-1'))) > 0 ORDER BY created_at DESC, id LIMIT 1"""


def merge_checks(spark, sf_dir):
    """Customers with an odd key are entities; each customer is to be merged into the one of half its key."""
    c = table(spark, sf_dir, "customer")
    known = c.where(F.col("c_custkey") % 2 == 1).select(F.col("c_custkey").alias("id"))
    half = F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey")).otherwise(F.floor(F.col("c_custkey") / 2).cast("long"))
    return E.check_merge(known, c.select(F.col("c_custkey").alias("dup"), half.alias("primary"))).withColumnRenamed("primary", "kept")


CHECKS_SQL = """WITH p AS (SELECT c_custkey AS dup, CASE WHEN c_custkey % 10 = 0 THEN c_custkey ELSE c_custkey // 2 END AS kept FROM customer), k AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 1),
e AS (SELECT dup, kept, CASE WHEN dup = kept THEN 'cannot merge an entity with itself' WHEN kept NOT IN (SELECT id FROM k) THEN 'primary entity not found' WHEN dup NOT IN (SELECT id FROM k) THEN 'duplicate entity not found' END AS error FROM p)
SELECT * FROM e WHERE error IS NOT NULL"""


def redirected_edges(spark, sf_dir):
    """How many edges a merge of the users 21, 63, ... into those 21 below redirects."""
    p, user = people(spark, sf_dir), F.regexp_extract("id", r"user-(\d+)$", 1).try_cast("long")
    pairs = p.where((F.col("entity_type") == "PERSON") & (user % 42 == 21)).select(F.col("id").alias("dup"), F.regexp_replace("id", r"user-\d+$", F.concat(F.lit("user-"), user - 21)).alias("primary"))
    return R.redirected_count(E.merge(p, edges(spark, sf_dir), pairs)[1])


REDIRECTED_SQL = f"""WITH {A_SQL}
SELECT count(*) AS redirected FROM a WHERE user_id % 42 = 21 AND regexp_replace(source_id, 'user-[0-9]+$', 'user-' || (user_id - 21)) IN (SELECT source_id FROM a)"""


def last_orders(spark, sf_dir):
    """Rows saved by customer: the last write wins."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    return FA.last_write(rows)


LAST_SQL = "SELECT o_custkey AS id, max(o_orderkey) AS seq, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey"


def _run_messages(spark, sf_dir):
    m, n = X.messages(spark, sf_dir), F.col("seq")
    facts = F.when(n % 29 == 0, F.lit("[oops")).otherwise(F.col("facts_json"))
    return m.withColumns({"facts_json": facts, "started_at": F.col("timestamp"), "completed_at": F.timestamp_add("MICROSECOND", (n % 1000) * 250, F.col("timestamp"))})


def extraction_runs(spark, sf_dir):
    return M.runs(_run_messages(spark, sf_dir)).select("message_id", "tenant_id", "status", "error_text", "ended_after", "processing_time_ms")


RUNS_SQL = """SELECT 'm' || event_id AS message_id, 't' || (user_id % 3) AS tenant_id, CASE WHEN error_text IS NULL THEN 'completed' ELSE 'failed' END AS status, error_text,
  CASE WHEN known THEN 'all' ELSE 'entities' END AS ended_after, (event_id % 1000) * 250 / 1000.0::DOUBLE AS processing_time_ms
FROM (SELECT *, event_id % 19 <> 0 AND event_id % 23 <> 0 AS known, CASE WHEN event_id % 23 = 0 THEN 'entities: not JSON' WHEN event_id % 29 = 0 AND event_id % 19 <> 0 THEN 'facts: not JSON' END AS error_text FROM events)"""


def reprocessable(spark, sf_dir):
    """Ids that still count as processed once failed runs are rolled back."""
    m = _run_messages(spark, sf_dir)
    return M.rollback(m.select("message_id"), M.runs(m))


REPROCESS_SQL = "SELECT 'm' || event_id AS message_id FROM events WHERE NOT (event_id % 23 = 0 OR (event_id % 29 = 0 AND event_id % 19 <> 0))"


def duplicate_candidates(spark, sf_dir):
    """Of a label, up to three vectors each that are alike in their first three places."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("block"), F.slice("embedding", 1, 3).alias("embedding"))
    return E.duplicate_candidates(v, v)


CANDIDATES_SQL = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[])[1:3] AS e FROM embeddings),
p AS (SELECT a.vec_id AS probe_id, b.vec_id AS match_id, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
k AS (SELECT probe_id, match_id, round(c, 9) AS score, row_number() OVER (PARTITION BY probe_id ORDER BY round(c, 9) DESC, match_id) AS rank FROM p WHERE c > 0.85) SELECT * FROM k WHERE rank <= 3"""

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({0}) % 1000000 = 0 THEN '' ELSE strftime({0}, '.%f') END || '+00:00'"


def entity_view(spark, sf_dir):
    return V.view(people(spark, sf_dir), V.ENTITY_DETAIL).select("id", "entity_type", "canonical_name", "created_at", "last_mentioned", F.size("source_messages").cast("long").alias("n_messages"), "metadata")


ENTITY_VIEW_SQL = f"WITH {N_SQL} SELECT id, entity_type, canonical_name, {_ISO.format('created_at')} AS created_at, {_ISO.format('last_mentioned')} AS last_mentioned, n_messages, NULL::VARCHAR AS metadata FROM ent"


def evolution_view(spark, sf_dir):
    rows = T.evolution(edges(spark, sf_dir), "prefers").withColumnRenamed("predecessor", "supersedes")
    return V.view(rows, V.EVOLUTION).select("source_id", "target_id", "rel_type", "version", "valid_from", "valid_to", "recorded_from", "supersedes", "evidence")


EVOLUTION_VIEW_SQL = f"""WITH {R_SQL}
SELECT source_id, target_id, rel_type, version, {_ISO.format('valid_from')} AS valid_from, {_ISO.format('valid_to')} AS valid_to, {_ISO.format('recorded_from')} AS recorded_from,
  lag(seq) OVER (PARTITION BY tenant_id, group_id, source_id, rel_type ORDER BY valid_from, seq) AS supersedes, NULL::VARCHAR AS evidence FROM r WHERE rel_type = 'prefers'"""


def commitment_view(spark, sf_dir):
    return V.view(FA.active_commitments(FX.commitments(spark, sf_dir)), V.COMMITMENT)


COMMITMENT_VIEW_SQL = f"""SELECT o_orderkey AS id, o_custkey AS entity_id, NULL::VARCHAR AS text, 'active' AS status, {_ISO.format('o_orderdate')} AS created_at, {_ISO.format('(o_orderdate + to_days(30))')} AS target_date, NULL::VARCHAR AS confidence
FROM orders WHERE o_orderstatus = 'O'"""


def _said(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("conversation_id"), F.col("ts").cast("timestamp").alias("timestamp"))


def _plain(rows, window):
    at = lambda c: F.col(f"{window}.{c}").cast("timestamp_ntz").alias(f"{c}_at")
    return rows.select("conversation_id", at("start"), at("end"), "messages")


def activity_by_hour(spark, sf_dir):
    return _plain(I.activity(_said(spark, sf_dir)), "window")


def activity_sliding(spark, sf_dir):
    """Days that begin every twelve hours."""
    return _plain(I.activity(_said(spark, sf_dir), "1 day", "12 hours"), "window")


def activity_sessions(spark, sf_dir):
    """Sessions that a pause of six hours ends."""
    return _plain(I.sessions(_said(spark, sf_dir), "6 hours"), "session_window")


HOUR_SQL = "SELECT 'u' || user_id AS conversation_id, date_trunc('hour', ts)::TIMESTAMP AS start_at, date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR AS end_at, count(*) AS messages FROM events GROUP BY ALL"
SLIDING_SQL = """WITH w AS (SELECT user_id, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS b FROM events), s AS (SELECT user_id, b AS s FROM w UNION ALL SELECT user_id, b - INTERVAL 12 HOUR FROM w)
SELECT 'u' || user_id AS conversation_id, s AS start_at, s + INTERVAL 1 DAY AS end_at, count(*) AS messages FROM s GROUP BY ALL"""
SESSION_SQL = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT 'u' || user_id AS conversation_id, min(ts) AS start_at, max(ts) + INTERVAL 6 HOUR AS end_at, count(*) AS messages FROM s GROUP BY user_id, k"""


def text_periods(spark, sf_dir):
    """Year and month in file names, some of which have none."""
    o = table(spark, sf_dir, "orders")
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    name = F.when(key % 5 == 0, F.concat(F.lit("x"), F.date_format(day, "yyyyMMdd"))).when(key % 5 == 1, F.concat(F.lit("20"), F.date_format(day, "yyyyMM"), F.lit(".zip"))).otherwise(F.concat(F.lit("pool_"), F.date_format(F.timestamp_add("YEAR", F.lit(10), day), "yyyyMM"), F.lit("_v1.zip")))
    return o.select(key.alias("id"), name.alias("name")).select("id", "name", S.extract_year(F.col("name")).alias("year"), S.extract_yyyymm(F.col("name")).alias("month"))


#: DuckDB's patterns have no look-around, so digits are looked at in runs of their own.
PERIODS_SQL = r"""WITH n AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'x' || strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN '20' || strftime(o_orderdate, '%Y%m') || '.zip' ELSE 'pool_' || strftime(o_orderdate + INTERVAL 10 YEAR, '%Y%m') || '_v1.zip' END AS name FROM orders)
SELECT id, name, nullif(regexp_extract(name, '(20[0-9]{2})', 1), '') AS year, list_filter(regexp_extract_all(name, '[0-9]+'), lambda d: regexp_full_match(d, '20[0-9]{2}(0[1-9]|1[0-2])'))[1] AS month FROM n"""


def temporal_markers(spark, sf_dir):
    n, at = F.col("event_id"), F.col("ts").cast("timestamp_ntz")
    marker = F.element_at(F.array(*map(F.lit, ("now", "yesterday", "last week", "always", "infer", "2023-05-06T07:08:09", "some day"))), (n % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(n.alias("id"), F.when(n % 50 != 0, marker).alias("marker"), at.alias("said")).select("id", "marker", S.temporal_marker(F.col("marker"), F.col("said")).alias("holds_from"))


MARKERS_SQL = """WITH m AS (SELECT event_id AS id, CASE WHEN event_id % 50 <> 0 THEN ['now', 'yesterday', 'last week', 'always', 'infer', '2023-05-06T07:08:09', 'some day'][event_id % 7 + 1] END AS marker, ts FROM events)
SELECT id, marker, CASE marker WHEN 'yesterday' THEN ts - INTERVAL 1 DAY WHEN 'last week' THEN ts - INTERVAL 7 DAY WHEN 'always' THEN ts - INTERVAL 365 DAY WHEN '2023-05-06T07:08:09' THEN TIMESTAMP '2023-05-06 07:08:09' ELSE ts END AS holds_from FROM m"""


def parsed_times(spark, sf_dir):
    n, at = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(n % 4 == 0, F.concat(at, F.lit("Z"))).when(n % 4 == 1, F.concat(at, F.lit("+02:00"))).when(n % 4 == 2, at).otherwise(F.lit("soon"))
    return table(spark, sf_dir, "events").select(n.alias("id"), text.alias("text")).select("id", "text", S.parse_time(F.col("text")).alias("at_utc"))


TIMES_SQL = """WITH e AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t, date_trunc('second', ts)::TIMESTAMP AS s FROM events)
SELECT id, CASE id % 4 WHEN 0 THEN t || 'Z' WHEN 1 THEN t || '+02:00' WHEN 2 THEN t ELSE 'soon' END AS text, CASE id % 4 WHEN 1 THEN s - INTERVAL 2 HOUR WHEN 3 THEN NULL ELSE s END AS at_utc FROM e"""


def context_budget(spark, sf_dir):
    """Of each conversation the edges that fit into 60 tokens, the surest for a token first."""
    e = edges(spark, sf_dir).select("conversation_id", F.col("seq").alias("item_id"), F.round(F.col("confidence") * 100).cast("long").alias("value"), (3 + F.col("seq") % 9).alias("tokens"))
    return M.within_budget(e, 60)


#: Item after item in the order of choice; what doesn't fit is passed over.
BUDGET_SQL = f"""WITH RECURSIVE {A_SQL},
i AS (SELECT conversation_id, seq AS item_id, CAST(round(confidence * 100) AS BIGINT) AS value, 3 + seq % 9 AS tokens FROM a),
o AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY value / tokens::DOUBLE DESC, value DESC, item_id) AS k FROM i WHERE value > 0),
t AS (
  SELECT conversation_id, 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS place, false AS taken FROM o GROUP BY ALL
  UNION ALL
  SELECT o.conversation_id, o.k, t.used + CASE WHEN t.used + o.tokens <= 60 THEN o.tokens ELSE 0 END, t.place + CASE WHEN t.used + o.tokens <= 60 THEN 1 ELSE 0 END, t.used + o.tokens <= 60
  FROM t JOIN o ON o.conversation_id = t.conversation_id AND o.k = t.k + 1 WHERE t.used < 60)
SELECT o.conversation_id, o.item_id, o.value, o.tokens, t.place, t.used FROM t JOIN o USING (conversation_id, k) WHERE taken"""

_ALL = [
    (entity_by_name, BY_NAME_SQL), (resolved_entity, RESOLVED_SQL), (merge_checks, CHECKS_SQL), (redirected_edges, REDIRECTED_SQL), (last_orders, LAST_SQL),
    (extraction_runs, RUNS_SQL), (reprocessable, REPROCESS_SQL), (duplicate_candidates, CANDIDATES_SQL), (entity_view, ENTITY_VIEW_SQL), (evolution_view, EVOLUTION_VIEW_SQL),
    (commitment_view, COMMITMENT_VIEW_SQL), (activity_by_hour, HOUR_SQL), (activity_sliding, SLIDING_SQL), (activity_sessions, SESSION_SQL),
    (text_periods, PERIODS_SQL), (temporal_markers, MARKERS_SQL), (parsed_times, TIMES_SQL), (context_budget, BUDGET_SQL),
]
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLE = {f.__name__: sql for f, sql in _ALL}
