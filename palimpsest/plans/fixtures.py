"""The graph inputs that the test tables stand for, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TYPES = {"purchase": "prefers", "error": "avoids", "click": "discussed", "view": "mentioned_with", "signup": "has_goal"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assertions(spark: SparkSession, sf_dir: str, out_of_order: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "events")
    tenant, group = F.concat(F.lit("t"), F.col("user_id") % 3), F.concat(F.lit("g"), F.col("user_id") % 7)
    days = lambda n: F.timestamp_add("DAY", n, F.col("ts"))
    kind = F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv])
    return e.select(
        F.col("event_id").alias("seq"), tenant.alias("tenant_id"), group.alias("group_id"), F.concat(F.lit("c"), F.date_format("ts", "yyyy-MM-dd")).alias("conversation_id"), F.concat(F.lit("m"), "event_id").alias("message_id"),
        F.concat_ws(":", tenant, group, F.lit("PERSON"), F.concat(F.lit("user-"), "user_id")).alias("source_id"), F.concat_ws(":", tenant, group, F.lit("PREFERENCE"), F.concat(F.lit("item-"), F.get_json_object("props", "$.k"))).alias("target_id"),
        F.element_at(kind, F.col("event_type")).alias("rel_type"), ((F.col("event_id") % 101).cast("double") / F.lit(100.0)).alias("confidence"),
        (days(-(F.col("event_id") % 3)) if out_of_order else F.col("ts")).alias("valid_from"), days(F.col("event_id") % 5).alias("recorded_from"),
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity row per endpoint and event."""
    a = assertions(spark, sf_dir)
    user = F.regexp_extract("source_id", r"user-(\d+)$", 1)
    alias = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("User "), user)).otherwise(F.concat(F.lit("user_"), user))
    side = lambda c, t, al, k: a.select(F.col(c).alias("id"), (F.col("seq") * 2 + k).alias("seq"), "tenant_id", "group_id", "conversation_id", F.lit(t).alias("entity_type"), F.element_at(F.split(c, ":"), -1).alias("canonical_name"), F.col("valid_from").alias("created_at"), F.col("valid_from").alias("last_mentioned"), F.array(al).alias("aliases"), F.array("message_id").alias("source_messages"))
    return side("source_id", "PERSON", alias, 0).unionByName(side("target_id", "PREFERENCE", F.element_at(F.split("target_id", ":"), -1), 1))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.element_at(F.split("o_orderpriority", "-"), 2)
    pop = F.when(F.col("o_orderkey") % 2 == 0, key).when(F.col("o_orderkey") % 5 == 0, F.lit("MEDIUM"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("entity_id"), key.alias("fact_key"), pop.alias("supersedes_key"), F.col("o_orderdate").alias("valid_from"))


def commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.create_map(*[F.lit(x) for x in ("O", "active", "F", "completed", "P", "missed")])
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity_id"), F.element_at(status, F.col("o_orderstatus")).alias("status"), F.col("o_orderdate").alias("created_at"), F.timestamp_add("DAY", F.lit(30), F.col("o_orderdate")).alias("target_date"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("fannie", "ginnie", "edgar"))), (F.col("o_custkey") % 3).cast("int") + 1)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("record_id"), name.alias("source"), F.when(F.col("o_orderkey") % 50 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("event_date"), F.col("o_totalprice").alias("price"))


A_SQL = """a AS (SELECT event_id AS seq, 't' || (user_id % 3) AS tenant_id, 'g' || (user_id % 7) AS group_id, 'c' || strftime(ts, '%Y-%m-%d') AS conversation_id, 'm' || event_id AS message_id,
  't' || (user_id % 3) || ':g' || (user_id % 7) || ':PERSON:user-' || user_id AS source_id,
  't' || (user_id % 3) || ':g' || (user_id % 7) || ':PREFERENCE:item-' || json_extract_string(props, '$.k') AS target_id,
  CASE event_type WHEN 'purchase' THEN 'prefers' WHEN 'error' THEN 'avoids' WHEN 'click' THEN 'discussed' WHEN 'view' THEN 'mentioned_with' WHEN 'signup' THEN 'has_goal' END AS rel_type,
  CAST(event_id % 101 AS DOUBLE) / 100.0::DOUBLE AS confidence, ts AS valid_from, ts + to_days(CAST(event_id % 5 AS INTEGER)) AS recorded_from, user_id FROM events)"""
R_SQL = A_SQL + """, k AS (SELECT *, CASE WHEN rel_type IN ('prefers', 'avoids') THEN 1 END AS cl FROM a),
r AS (SELECT k.* EXCLUDE (cl), CASE WHEN cl = 1 THEN row_number() OVER (PARTITION BY tenant_id, group_id, source_id, rel_type ORDER BY seq) ELSE 1 END AS version,
  CASE WHEN cl = 1 THEN lead(valid_from) OVER (PARTITION BY tenant_id, group_id, source_id, cl ORDER BY seq) END AS valid_to,
  CASE WHEN cl = 1 THEN lead(valid_from) OVER (PARTITION BY tenant_id, group_id, source_id, cl ORDER BY seq) END AS recorded_to,
  CAST(CASE WHEN cl = 1 AND lag(seq) OVER (PARTITION BY tenant_id, group_id, source_id, cl ORDER BY seq) IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS conflicts FROM k)"""
N_SQL = A_SQL + """, n AS (
  SELECT source_id AS id, seq * 2 AS seq, tenant_id, group_id, conversation_id, 'PERSON' AS entity_type, split_part(source_id, ':', 4) AS canonical_name, valid_from AS tm, CASE WHEN seq % 2 = 0 THEN 'User ' ELSE 'user_' END || user_id AS alias, message_id FROM a
  UNION ALL SELECT target_id, seq * 2 + 1, tenant_id, group_id, conversation_id, 'PREFERENCE', split_part(target_id, ':', 4), valid_from, split_part(target_id, ':', 4), message_id FROM a),
al AS (SELECT id, list(alias ORDER BY s) AS aliases FROM (SELECT id, alias, min(seq) AS s FROM n GROUP BY id, alias) GROUP BY id),
ent AS (SELECT id, min(tenant_id) AS tenant_id, min(entity_type) AS entity_type, min(canonical_name) AS canonical_name, arg_min(conversation_id, seq) AS conversation_id, arg_min(tm, seq) AS created_at, arg_max(tm, seq) AS last_mentioned, count(*) AS n_messages FROM n GROUP BY id)"""
F_SQL = """f AS (SELECT o_orderkey AS seq, o_custkey AS entity_id, split_part(o_orderpriority, '-', 2) AS fact_key, CASE WHEN o_orderkey % 2 = 0 THEN split_part(o_orderpriority, '-', 2) WHEN o_orderkey % 5 = 0 THEN 'MEDIUM' END AS supersedes_key, o_orderdate AS valid_from FROM orders),
o AS (SELECT entity_id, fact_key AS key, seq, valid_from, 1 AS push FROM f UNION ALL SELECT entity_id, supersedes_key, seq, valid_from, 0 FROM f WHERE supersedes_key IS NOT NULL),
p AS (SELECT *, sum(push) OVER w AS pu, sum(1 - push) OVER w AS po FROM o WINDOW w AS (PARTITION BY entity_id, key ORDER BY seq, push ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, greatest(0, max(po - pu) OVER (PARTITION BY entity_id, key ORDER BY seq, push ROWS UNBOUNDED PRECEDING)) AS fail FROM p),
z AS (SELECT *, coalesce(lag(fail) OVER (PARTITION BY entity_id, key ORDER BY seq, push), 0) = fail AS ok FROM q),
m AS (SELECT g.seq AS old, t.seq AS new, t.valid_from AS tm FROM z g JOIN z t ON g.entity_id = t.entity_id AND g.key = t.key AND g.push = 1 AND t.push = 0 AND t.ok AND g.pu = t.po - t.fail),
fs AS (SELECT f.*, a.tm AS valid_to, b.old AS supersedes_seq, CASE WHEN a.tm IS NULL THEN 'active' ELSE 'superseded' END AS status FROM f LEFT JOIN m a ON f.seq = a.old LEFT JOIN m b ON f.seq = b.new)"""
C_SQL = """rec AS (SELECT o_orderkey AS seq, CAST(o_orderkey AS VARCHAR) AS record_id, CASE o_custkey % 3 WHEN 0 THEN 'fannie' WHEN 1 THEN 'ginnie' ELSE 'edgar' END AS source, CASE WHEN o_orderkey % 50 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS event_date, o_totalprice AS price FROM orders),
sp AS (SELECT *, CASE WHEN event_date IS NULL THEN 'unspecified' WHEN event_date <= '1998-12-31' THEN 'train' WHEN event_date <= '2000-12-31' THEN 'eval' ELSE 'holdout' END AS split FROM rec)"""
_h = lambda x: f"(CAST(('0x' || substr(sha256({x}), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE)"
# Fixed values, as the operator must have them: bias by source in the order of the branches, and factor by profile.
_B = ("stability", "distress", "refi")
_BIAS = {"edgar": (0.36, 0.34, 0.30), "fannie": (0.42, 0.23, 0.35), "ginnie": (0.28, 0.30, 0.42)}
_FACTOR = "CASE profile WHEN 'baseline' THEN 1.0::DOUBLE WHEN 'reduced_context' THEN 0.96::DOUBLE WHEN 'distractor' THEN 0.90::DOUBLE END"


def _raw(i: int, b: str) -> str:
    bias = "CASE source " + " ".join(f"WHEN '{s}' THEN {x[i]}::DOUBLE" for s, x in _BIAS.items()) + " ELSE 0.33::DOUBLE END"
    own, noise = _h(f"record_id || '::{b}'"), _h(f"record_id || '::noise::{b}'")
    return f"((0.65::DOUBLE * {own} + 0.35::DOUBLE * {bias}) * {_FACTOR} + CASE WHEN profile = 'distractor' THEN 0.02::DOUBLE * {noise} ELSE 0.0::DOUBLE END)"


def scored_sql(source: str) -> str:
    """The scoring of a table of records as three common table expressions; the last is sc."""
    return f"""pr AS (SELECT t.*, unnest(['baseline', 'reduced_context', 'distractor']) AS profile FROM {source} t),
raw AS (SELECT *, {", ".join(f"{_raw(i, b)} AS r{i}" for i, b in enumerate(_B))}, least(CAST(floor({_h("record_id || '::truth'")} * 3) AS INTEGER), 2) AS tr FROM pr),
nrm AS (SELECT *, {", ".join(f"round(r{i} / (r0 + r1 + r2), 9) AS s{i}" for i in range(3))} FROM raw),
sc AS (SELECT *, greatest(s0, s1, s2) AS confidence, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS top,
  (s0 - (tr = 0)::INT::DOUBLE) * (s0 - (tr = 0)::INT::DOUBLE) + (s1 - (tr = 1)::INT::DOUBLE) * (s1 - (tr = 1)::INT::DOUBLE) + (s2 - (tr = 2)::INT::DOUBLE) * (s2 - (tr = 2)::INT::DOUBLE) AS brier FROM nrm)"""


S_SQL = C_SQL + ", " + scored_sql("sp")
METRICS_SQL = "count(*) AS n, round(avg((top = tr)::INT::DOUBLE), 9) AS accuracy, round(avg(confidence), 7) AS mean_confidence, round(avg(brier), 7) AS mean_brier, CAST(sum((top = 0)::INT) AS BIGINT) AS n_stability, CAST(sum((top = 1)::INT) AS BIGINT) AS n_distress, CAST(sum((top = 2)::INT) AS BIGINT) AS n_refi"
