"""The ingest pipeline over a table: every event is a message with the output that extraction models give, as JSON.

Some messages list nothing, some aren't JSON, some name an unknown type, some
mention what only an earlier message of the conversation introduced, and some
mention what nobody did.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import messages as M
from .fixtures import EVENT_TYPES, F_SQL, table


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    user, item = F.col("user_id").cast("string"), F.get_json_object("props", "$.k")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv]), F.col("event_type"))
    entity = lambda name, canonical, type_: F.struct(name.alias("name"), canonical.alias("canonical"), type_.alias("type"), F.lit(0.9).alias("confidence"))
    person = entity(F.concat(F.lit("User "), user), F.concat(F.lit("user-"), user), F.lit("PERSON"))
    thing = entity(F.concat(F.lit("Item "), item), F.concat(F.lit("item-"), item), F.when(n % 17 == 0, "ALIEN").when(F.col("event_type") == "signup", "GOAL").otherwise("PREFERENCE"))
    listed = F.when(n % 19 == 0, F.array().cast("array<struct<name string, canonical string, type string, confidence double>>")).when(n % 5 == 0, F.array(person)).otherwise(F.array(person, thing))
    said = F.struct(
        F.concat(F.lit("user "), user).alias("source_mention"), F.when(n % 13 == 0, "Nobody").otherwise(F.concat(F.lit("ITEM  "), item)).alias("target_mention"),
        F.when(n % 11 == 0, "runs_on").otherwise(kind).alias("type"), F.lit("said so").alias("evidence"), ((n % 101).cast("double") / 100.0).alias("confidence"),
    )
    key = F.concat(F.lit("last_"), "event_type")
    fact = F.struct(person["name"].alias("entity_mention"), key.alias("fact_key"), F.concat(F.lit("item "), item).alias("fact_text"), F.when(n % 2 == 0, key).when(n % 3 == 0, "last_error").alias("supersedes_key"), F.lit(0.9).alias("confidence"))
    promise = F.struct(person["name"].alias("entity_mention"), F.lit("come back").alias("text"), F.date_format(F.timestamp_add("DAY", F.lit(30), F.col("ts")), "yyyy-MM-dd").alias("target_date"), F.lit(0.9).alias("confidence"))
    json = lambda name, rows: F.to_json(F.struct(rows.alias(name))).alias(f"{name}_json")
    return e.select(
        F.concat(F.lit("m"), "event_id").alias("message_id"), n.alias("seq"), F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant_id"), F.concat(F.lit("g"), F.col("user_id") % 7).alias("group_id"),
        F.concat(F.lit("c"), F.date_format("ts", "yyyy-MM-dd")).alias("conversation_id"), F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        F.when(n % 23 == 0, F.lit("{broken")).otherwise(json("entities", listed)).alias("entities_json"), json("relationships", F.array(said)),
        json("facts", F.when(F.col("event_type").isin("purchase", "error"), F.array(fact)).otherwise(F.array().cast("array<struct<entity_mention string, fact_key string, fact_text string, supersedes_key string, confidence double>>"))),
        json("commitments", F.when(F.col("event_type") == "signup", F.array(promise)).otherwise(F.array().cast("array<struct<entity_mention string, text string, target_date string, confidence double>>"))),
        F.to_json(F.struct(F.lit("ok").alias("opening_state"), (n % 2 == 0).alias("breakthrough"))).alias("summary_json"),
    )


#: m: the messages.  ent: what they list and is known.  here: the first arrival of each name in a conversation.  e: resolved edges.
X_SQL = """m AS (SELECT event_id AS seq, 'm' || event_id AS message_id, 't' || (user_id % 3) AS tenant_id, 'g' || (user_id % 7) AS group_id, 'c' || strftime(ts, '%Y-%m-%d') AS conversation_id, ts AS tm,
  event_type, 'user-' || user_id AS person, 'item-' || json_extract_string(props, '$.k') AS item, CAST(event_id % 101 AS DOUBLE) / 100.0::DOUBLE AS c,
  CASE event_type WHEN 'purchase' THEN 'prefers' WHEN 'error' THEN 'avoids' WHEN 'click' THEN 'discussed' WHEN 'view' THEN 'mentioned_with' WHEN 'signup' THEN 'has_goal' END AS said FROM events),
live AS (SELECT *, tenant_id || ':' || group_id || ':PERSON:' || person AS source_id FROM m WHERE seq % 19 <> 0 AND seq % 23 <> 0),
ent AS (
  SELECT message_id, tenant_id, conversation_id, seq * 1000 AS seq, source_id AS id, person AS name, 'PERSON' AS entity_type, tm FROM live
  UNION ALL SELECT message_id, tenant_id, conversation_id, seq * 1000 + 1, tenant_id || ':' || group_id || CASE event_type WHEN 'signup' THEN ':GOAL:' ELSE ':PREFERENCE:' END || item, item, CASE event_type WHEN 'signup' THEN 'GOAL' ELSE 'PREFERENCE' END, tm
  FROM live WHERE seq % 5 <> 0 AND seq % 17 <> 0),
since AS (SELECT tenant_id, conversation_id, name, id, min(seq) AS since FROM ent GROUP BY ALL),
here AS (SELECT tenant_id, conversation_id, name, min(since) AS since, arg_min(id, since) AS id FROM since GROUP BY ALL),
rel AS (SELECT live.seq * 1000 AS seq, live.message_id, live.tenant_id, live.group_id, live.source_id, coalesce(own.id, CASE WHEN here.since < live.seq * 1000 THEN here.id END) AS target_id,
    CASE WHEN live.seq % 11 = 0 THEN 'relates_to' ELSE said END AS rel_type, CASE WHEN live.seq % 11 = 0 THEN 'runs_on' END AS original_type, live.tm AS valid_from,
    CASE WHEN abs(1.0::DOUBLE - c) <= least(abs(0.8::DOUBLE - c), abs(0.6::DOUBLE - c), abs(0.4::DOUBLE - c)) THEN 1.0 WHEN abs(0.8::DOUBLE - c) <= least(abs(0.6::DOUBLE - c), abs(0.4::DOUBLE - c)) THEN 0.8 WHEN abs(0.6::DOUBLE - c) <= abs(0.4::DOUBLE - c) THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence
  FROM live LEFT JOIN ent own ON own.message_id = live.message_id AND own.name = live.item LEFT JOIN here ON here.tenant_id = live.tenant_id AND here.conversation_id = live.conversation_id AND here.name = live.item
  WHERE live.seq % 13 <> 0),
cl AS (SELECT *, CASE WHEN rel_type IN ('prefers', 'avoids') THEN 1 END AS cl FROM rel WHERE target_id IS NOT NULL),
e AS (SELECT * EXCLUDE (cl), CASE WHEN cl = 1 THEN row_number() OVER (PARTITION BY tenant_id, group_id, source_id, rel_type ORDER BY seq) ELSE 1 END AS version,
  CASE WHEN cl = 1 THEN lead(valid_from) OVER (PARTITION BY tenant_id, group_id, source_id, cl ORDER BY seq) END AS valid_to,
  CAST(CASE WHEN cl = 1 AND lag(seq) OVER (PARTITION BY tenant_id, group_id, source_id, cl ORDER BY seq) IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS conflicts FROM cl)"""

EDGE = ["seq", "message_id", "tenant_id", "group_id", "source_id", "target_id", "rel_type", "original_type", "confidence", "version", "valid_from", "valid_to", "conflicts"]
EDGES_SQL = f"WITH {X_SQL} SELECT {', '.join(EDGE)} FROM e"
RESPONSE_SQL = f"""WITH {X_SQL},
n AS (SELECT message_id, count(*) AS entities FROM ent GROUP BY message_id),
r AS (SELECT message_id, count(*) AS relationships, CAST(sum(conflicts) AS BIGINT) AS conflicts FROM e GROUP BY message_id)
SELECT m.message_id, coalesce(entities, 0) AS entities, coalesce(relationships, 0) AS relationships, coalesce(conflicts, 0) AS conflicts
FROM m LEFT JOIN n USING (message_id) LEFT JOIN r USING (message_id)"""
ENTITIES_SQL = f"""WITH {X_SQL}
SELECT id, any_value(entity_type) AS entity_type, any_value(name) AS canonical_name, arg_min(conversation_id, seq) AS conversation_id, arg_min(tm, seq) AS created_at, arg_max(tm, seq) AS last_mentioned, count(*) AS n_messages
FROM ent GROUP BY id"""
#: The facts of the messages, superseded by the same steps as the catalogue's facts.
_OWN_FACTS = """f AS (SELECT seq * 1000 AS seq, source_id AS entity_id, 'last_' || event_type AS fact_key, CASE WHEN seq % 2 = 0 THEN 'last_' || event_type WHEN seq % 3 = 0 THEN 'last_error' END AS supersedes_key, tm AS valid_from
  FROM live WHERE event_type IN ('purchase', 'error')),"""
_STEPS = F_SQL.partition("\n")[2].replace("m AS (SELECT g", "pairs AS (SELECT g").replace("JOIN m a", "JOIN pairs a").replace("JOIN m b", "JOIN pairs b")
FACTS_SQL = f"WITH {X_SQL}, {_OWN_FACTS}\n{_STEPS} SELECT seq, entity_id, fact_key, supersedes_key, valid_from, valid_to, supersedes_seq, status FROM fs"
COMMITMENTS_SQL = f"""WITH {X_SQL}
SELECT tenant_id || ':commitment:' || message_id || ':0' AS id, source_id AS entity_id, 'come back' AS text, 'active' AS status, tm AS created_at, date_trunc('day', tm + to_days(30))::TIMESTAMP AS target_date, 1.0::DOUBLE AS confidence
FROM live WHERE event_type = 'signup'"""
SUMMARIES_SQL = f"WITH {X_SQL} SELECT tenant_id || ':summary:' || message_id AS id, message_id, 'ok' AS opening_state, '' AS closing_state, seq % 2 = 0 AS breakthrough FROM live"


def _part(name: str, *columns: str):
    return lambda spark, sf_dir: M.extract(messages(spark, sf_dir))[name].select(*columns)


def ingest_response(spark, sf_dir):
    rows = messages(spark, sf_dir)
    return M.ingest_response(rows, M.extract(rows))


QUERIES = {
    "pipeline_coaching": _part("edges", *EDGE),
    "ingest_response": ingest_response,
    "extract_entities": lambda s, d: M.extract(messages(s, d))["entities"].select("id", "entity_type", "canonical_name", "conversation_id", "created_at", "last_mentioned", F.size("source_messages").cast("long").alias("n_messages")),
    "extract_facts": _part("facts", "seq", "entity_id", "fact_key", "supersedes_key", "valid_from", "valid_to", "supersedes_seq", "status"),
    "extract_commitments": _part("commitments", "id", "entity_id", "text", "status", "created_at", "target_date", "confidence"),
    "extract_summaries": _part("summaries", "id", "message_id", "opening_state", "closing_state", "breakthrough"),
}
ORACLE = {
    "pipeline_coaching": EDGES_SQL, "ingest_response": RESPONSE_SQL, "extract_entities": ENTITIES_SQL, "extract_facts": FACTS_SQL,
    "extract_commitments": COMMITMENTS_SQL, "extract_summaries": SUMMARIES_SQL,
}
