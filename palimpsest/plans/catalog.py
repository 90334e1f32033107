"""Every operator as a query over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import entities as E
from ..operators import facts as FA
from ..operators import messages as M
from ..operators import relationships as R
from ..operators import research as X
from ..operators import temporal as T
from ..operators import views as V
from ..sources import files as SRC
from . import analytics, extraction, lookups
from . import fixtures as FX
from .fixtures import A_SQL, C_SQL, F_SQL, METRICS_SQL, N_SQL, R_SQL, S_SQL, scored_sql, table

AT, KNOWN, NOW = "2024-01-15", "2024-01-20", "2024-02-01"
EDGE = ["seq", "tenant_id", "group_id", "source_id", "target_id", "rel_type", "confidence", "version", "valid_from", "valid_to", "recorded_from", "recorded_to", "conflicts"]
E_COLS = ", ".join(EDGE)
QUERIES, ORACLE = analytics.QUERIES | extraction.QUERIES | lookups.QUERIES, analytics.ORACLE | extraction.ORACLE | lookups.ORACLE


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def edges(spark, sf, **options):
    return R.resolve(FX.assertions(spark, sf, options.pop("out_of_order", False)), **options)


def people(spark, sf):
    return E.upsert(FX.arrivals(spark, sf))


def scored(spark, sf):
    return X.score(X.expand_profiles(X.with_split(FX.records(spark, sf), "1998-12-31", "2000-12-31")))


query("resolve_relationships", f"WITH {R_SQL} SELECT {E_COLS} FROM r")(lambda s, d: edges(s, d).select(*EDGE))
query("resolve_out_of_order", f"WITH {R_SQL.replace('ts AS valid_from', 'ts - to_days(CAST(event_id % 3 AS INTEGER)) AS valid_from')} SELECT {E_COLS} FROM r")(lambda s, d: edges(s, d, out_of_order=True).select(*EDGE))
query("resolve_spec_mode", f"WITH {R_SQL.replace('lead(valid_from) OVER (PARTITION BY tenant_id, group_id, source_id, cl ORDER BY seq) END AS recorded_to', 'lead(recorded_from) OVER (PARTITION BY tenant_id, group_id, source_id, cl ORDER BY seq) END AS recorded_to')} SELECT {E_COLS} FROM r")(lambda s, d: edges(s, d, mode="spec").select(*EDGE))
_V = "valid_from <= TIMESTAMP '{0}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{0}')"
_K = "recorded_from <= TIMESTAMP '{0}' AND (recorded_to IS NULL OR recorded_to > TIMESTAMP '{0}')"
query("world_state_as_of", f"WITH {R_SQL} SELECT {E_COLS} FROM r WHERE {_V.format(AT)}")(lambda s, d: T.world_state(edges(s, d), ntz(AT)).select(*EDGE))
query("knowledge_as_of", f"WITH {R_SQL} SELECT {E_COLS} FROM r WHERE {_K.format(AT)}")(lambda s, d: T.knowledge(edges(s, d), ntz(AT)).select(*EDGE))
query("bitemporal_modes", f"WITH {R_SQL} SELECT {E_COLS}, 'world_state' AS timeline FROM r WHERE {_V.format(AT)} UNION ALL SELECT {E_COLS}, 'knowledge' FROM r WHERE {_K.format(AT)}")(lambda s, d: T.point_in_time(edges(s, d), ntz(AT), "bitemporal").select(*EDGE, "timeline"))
query("bitemporal_intersection", f"WITH {R_SQL} SELECT {E_COLS} FROM r WHERE {_V.format(AT)} AND {_K.format(KNOWN)}")(lambda s, d: T.intersection(edges(s, d), ntz(AT), ntz(KNOWN)).select(*EDGE))
query("evolution", f"WITH {R_SQL} SELECT {E_COLS} FROM r WHERE tenant_id = 't1' AND source_id LIKE '%:user-1' AND rel_type = 'prefers'")(lambda s, d: T.evolution(T.of_source(edges(s, d), None, "t1", None).where(S.short_name(F.col("source_id")) == "user-1"), "prefers").select(*EDGE))
query("evolution_timeline", f"WITH {R_SQL} SELECT seq, source_id, target_id, rel_type, version, valid_from, valid_to, CASE WHEN valid_to IS NULL THEN 'active' ELSE 'superseded' END AS status, lag(seq) OVER (PARTITION BY tenant_id, group_id, source_id, rel_type ORDER BY valid_from, seq) AS predecessor FROM r WHERE rel_type IN ('prefers', 'avoids')")(
    lambda s, d: T.evolution(edges(s, d).where(F.col("rel_type").isin("prefers", "avoids"))).select("seq", "source_id", "target_id", "rel_type", "version", "valid_from", "valid_to", "status", "predecessor"))
query("active_relationships", f"WITH {R_SQL} SELECT {E_COLS} FROM r WHERE valid_to IS NULL AND recorded_to IS NULL AND tenant_id = 't1'")(lambda s, d: R.active(edges(s, d), tenant="t1").select(*EDGE))
_RATE = "CASE rel_type WHEN 'prefers' THEN 0.05::DOUBLE WHEN 'avoids' THEN 0.04::DOUBLE WHEN 'knows' THEN 0.005::DOUBLE WHEN 'discussed' THEN 0.03::DOUBLE WHEN 'mentioned_with' THEN 0.1::DOUBLE WHEN 'has_goal' THEN 0.02::DOUBLE ELSE 0.01::DOUBLE END"
_DEC = f"greatest(confidence * exp(-{_RATE} * {{0}}::DOUBLE * (date_diff('microsecond', valid_from, TIMESTAMP '{NOW}') / 86400000000.0::DOUBLE)), 0.1::DOUBLE)"
query("active_with_decay", f"WITH {R_SQL} SELECT seq, source_id, target_id, rel_type, round({_DEC.format(1.0)}, 9) AS decayed FROM r WHERE valid_to IS NULL AND recorded_to IS NULL")(lambda s, d: R.active_with_decay(edges(s, d), ntz(NOW)).select("seq", "source_id", "target_id", "rel_type", "decayed"))
query("decay_presets", f"WITH {A_SQL} SELECT seq, round({_DEC.format(2.0)}, 9) AS fast, round({_DEC.format(1.0)}, 9) AS normal, round({_DEC.format(0.5)}, 9) AS slow FROM a")(
    lambda s, d: FX.assertions(s, d).select("seq", *[F.round(S.decayed_confidence(F.col("confidence"), F.col("rel_type"), F.col("valid_from"), ntz(NOW), p), 9).alias(p) for p in ("fast", "normal", "slow")]))
query("reinforced_confidence", f"WITH {A_SQL} SELECT seq, round(least(0.7::DOUBLE * confidence + 0.3::DOUBLE * ({_DEC.format(1.0)}), 1.0::DOUBLE), 9) AS reinforced FROM a")(
    lambda s, d: FX.assertions(s, d).select("seq", F.round(S.reinforced_confidence(S.decayed_confidence(F.col("confidence"), F.col("rel_type"), F.col("valid_from"), ntz(NOW)), F.col("confidence")), 9).alias("reinforced")))
query("snap_confidence", f"WITH {A_SQL}, l AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE), (1, 0.8::DOUBLE), (2, 0.6::DOUBLE), (3, 0.4::DOUBLE)) t(i, x)) SELECT seq, confidence, arg_min(x, abs(x - confidence) * 1e9 + i * 1e-9) AS snapped FROM (SELECT a.seq, a.confidence, l.i, l.x, row_number() OVER (PARTITION BY a.seq ORDER BY abs(l.x - a.confidence), l.i) AS k FROM a, l) WHERE k = 1 GROUP BY seq, confidence")(
    lambda s, d: FX.assertions(s, d).select("seq", "confidence", S.snap_confidence(F.col("confidence")).alias("snapped")))
query("normalize_names", r"SELECT c_custkey AS id, regexp_replace(trim(regexp_replace(lower(c_name), '[^\p{L}\p{N}_\s]', '', 'g')), '\s+', '-', 'g') AS norm FROM customer")(
    lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("id"), S.normalize_name(F.col("c_name")).alias("norm")))
# Whole names and texts; no SQL, since DuckDB's white space and trim are ASCII only.
query("normalize_texts")(
    lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("id"), S.normalize_name(F.col("c_name")).alias("norm")).union(table(s, d, "documents").select(-1 - F.col("doc_id"), S.normalize_name(F.col("text")))))
ENT = ["id", "tenant_id", "entity_type", "canonical_name", "conversation_id", "created_at", "last_mentioned"]
_EC = ", ".join(f"ent.{c}" for c in ENT)
query("upsert_entities", f"WITH {N_SQL} SELECT {_EC}, array_to_string(al.aliases, '|') AS aliases, ent.n_messages FROM ent JOIN al USING (id)")(
    lambda s, d: people(s, d).select(*ENT, F.array_join("aliases", "|").alias("aliases"), F.size("source_messages").cast("long").alias("n_messages")))
query("list_entities", f"WITH {N_SQL} SELECT {_EC} FROM ent WHERE tenant_id = 't1' AND entity_type = 'PERSON' ORDER BY created_at DESC, id LIMIT 25 OFFSET 1")(lambda s, d: E.listing(people(s, d), "t1", entity_type="PERSON", limit=25, offset=1).select(*ENT))
query("recent_entities", f"WITH {N_SQL} SELECT {_EC} FROM ent WHERE tenant_id = 't1' AND last_mentioned >= TIMESTAMP '2024-01-20' ORDER BY last_mentioned DESC, id LIMIT 20")(lambda s, d: E.recent(people(s, d), "t1", ntz("2024-01-20")).select(*ENT))
query("search_entities", f"WITH {N_SQL}, pool AS (SELECT {_EC}, aliases FROM ent JOIN al USING (id) WHERE tenant_id = 't1' ORDER BY created_at DESC, id LIMIT 1000) SELECT {_EC.replace('ent.', '')} FROM pool WHERE contains(lower(canonical_name), 'user 1') OR len(list_filter(aliases, lambda x: contains(lower(x), 'user 1'))) > 0 ORDER BY created_at DESC, id LIMIT 20")(lambda s, d: E.search(people(s, d), "t1", "USER 1").select(*ENT))
query("get_entity", f"WITH {N_SQL} SELECT {_EC} FROM ent WHERE id = 't1:g1:PERSON:user-1'")(lambda s, d: E.by_id(people(s, d), "t1:g1:PERSON:user-1").select(*ENT))


def _merge(s, d):
    p = people(s, d)
    user = F.regexp_extract("id", r"user-(\d+)$", 1)
    dup = p.where((F.col("entity_type") == "PERSON") & (user.try_cast("long") % 42 == 21)).select(F.col("id").alias("dup"), F.regexp_replace("id", r"user-\d+$", F.concat(F.lit("user-"), user.try_cast("long") - 21)).alias("primary"))
    return E.merge(p, edges(s, d), dup)[1].select("seq", "source_id", "target_id", "redirected")


query("merge_entities", f"""WITH {A_SQL}, dup AS (SELECT DISTINCT source_id AS dup, regexp_replace(source_id, 'user-[0-9]+$', 'user-' || (user_id - 21)) AS prim FROM a WHERE user_id % 42 = 21),
ok AS (SELECT * FROM dup WHERE prim IN (SELECT source_id FROM a))
SELECT seq, coalesce(prim, source_id) AS source_id, target_id, prim IS NOT NULL AS redirected FROM a LEFT JOIN ok ON source_id = dup""")(_merge)


def _messages(s, d):
    c = table(s, d, "conversations").select(F.substring(F.sha2(F.concat_ws(":", "conv_id", "turn"), 256), 1, 16).alias("message_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "role", F.length("text").cast("long").alias("chars"), "turn")
    return c.drop("turn").unionByName(c.where(F.col("turn") % 3 == 0).withColumn("seq", F.col("seq") + 1_000_000_000).drop("turn"))


query("dedup_messages", "WITH c AS (SELECT substr(sha256(conv_id || ':' || turn), 1, 16) AS message_id, conv_id * 1000 + turn AS seq, role, CAST(length(text) AS BIGINT) AS chars, turn FROM conversations), m AS (SELECT message_id, seq, role, chars FROM c UNION ALL SELECT message_id, seq + 1000000000, role, chars FROM c WHERE turn % 3 = 0) SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY seq) AS k FROM m) WHERE k = 1")(lambda s, d: M.first_arrivals(_messages(s, d)))
FACT = ["seq", "entity_id", "fact_key", "supersedes_key", "valid_from", "valid_to", "supersedes_seq", "status"]
query("fact_supersession", f"WITH {F_SQL} SELECT {', '.join(FACT)} FROM fs")(lambda s, d: FA.supersede(FX.facts(s, d)).select(*FACT))
query("active_facts", f"WITH {F_SQL} SELECT {', '.join(FACT)} FROM fs WHERE status = 'active' AND fact_key = 'URGENT'")(lambda s, d: FA.facts_of(FA.supersede(FX.facts(s, d)), key="URGENT").select(*FACT))
query("commitments_active", "SELECT o_orderkey AS id, o_custkey AS entity_id, 'active' AS status, o_orderdate AS created_at, o_orderdate + to_days(30) AS target_date FROM orders WHERE o_orderstatus = 'O'")(lambda s, d: FA.active_commitments(FX.commitments(s, d)))


def _mentions(s, d):
    c = table(s, d, "customer")
    pool = c.select(F.lit("t").alias("tenant_id"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("canonical_name"), F.array(F.concat(F.lit("No "), "c_custkey"), F.concat(F.lit("Seg "), "c_mktsegment")).alias("aliases"), F.col("c_custkey").alias("pos"))
    asked = c.select(F.lit("t").alias("tenant_id"), F.col("c_custkey").alias("mention_id"), F.when(F.col("c_custkey") % 4 == 0, F.upper("c_name")).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit(" no  "), "c_custkey", F.lit("!"))).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("seg "), F.lower("c_mktsegment"))).otherwise("nobody").alias("mention"))
    return E.resolve_mentions(asked, pool, ["tenant_id"]).select("mention_id", "mention", "entity_id")


query("mention_resolution", """WITH q AS (SELECT c_custkey AS mention_id, CASE c_custkey % 4 WHEN 0 THEN upper(c_name) WHEN 1 THEN ' no  ' || c_custkey || '!' WHEN 2 THEN 'seg ' || lower(c_mktsegment) ELSE 'nobody' END AS mention, c_custkey, c_name, c_mktsegment FROM customer)
SELECT mention_id, mention, CASE mention_id % 4 WHEN 2 THEN (SELECT CAST(min(c2.c_custkey) AS VARCHAR) FROM customer c2 WHERE c2.c_mktsegment = q.c_mktsegment) ELSE CAST(c_custkey AS VARCHAR) END AS entity_id FROM q WHERE mention_id % 4 <> 3""")(_mentions)


def _snapshot(s, d):
    f = FA.supersede(FX.facts(s, d)).withColumn("entity_id", F.concat(F.lit("t"), F.col("entity_id") % 3, F.lit(":g"), F.col("entity_id") % 7, F.lit(":PERSON:user-"), F.col("entity_id")))
    return M.snapshot(people(s, d), edges(s, d), f)


_F2 = F_SQL.replace("p AS (", "pp AS (").replace("FROM p)", "FROM pp)").replace("m AS (", "mm AS (").replace("JOIN m a", "JOIN mm a").replace("JOIN m b", "JOIN mm b")
query("conversation_snapshot", f"""WITH {R_SQL}, {N_SQL[len(A_SQL) + 2:]}, {_F2},
li AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, conversation_id ORDER BY created_at DESC, id) AS k FROM ent) WHERE k <= 500),
tr AS (SELECT e.tenant_id, e.conversation_id, count(*) AS relationship_count FROM (SELECT DISTINCT source_id, target_id, rel_type FROM r WHERE valid_to IS NULL AND recorded_to IS NULL) x JOIN li e ON e.id = x.source_id GROUP BY ALL),
fc AS (SELECT e.tenant_id, e.conversation_id, count(*) AS fact_count FROM fs JOIN li e ON e.id = 't' || (fs.entity_id % 3) || ':g' || (fs.entity_id % 7) || ':PERSON:user-' || fs.entity_id WHERE fs.status = 'active' GROUP BY ALL)
SELECT tenant_id, conversation_id, count(*) AS entity_count, string_agg(canonical_name, '|' ORDER BY k) AS entity_names, coalesce(any_value(relationship_count), 0) AS relationship_count, coalesce(any_value(fact_count), 0) AS fact_count
FROM li LEFT JOIN tr USING (tenant_id, conversation_id) LEFT JOIN fc USING (tenant_id, conversation_id) GROUP BY tenant_id, conversation_id""")(lambda s, d: _snapshot(s, d).withColumn("entity_names", F.array_join("entity_names", "|")))
_deltas = lambda s, d: M.deltas(people(s, d), edges(s, d), FA.supersede(FX.facts(s, d)).withColumn("fact_text", F.col("status")))
query("snapshot_deltas", f"""WITH {R_SQL}, {N_SQL[len(A_SQL) + 2:]}, {_F2}
SELECT conversation_id, 1 AS position, 'added' AS change_type, 'entity' AS artifact_type, id AS artifact_id, 'New entity: ' || canonical_name || ' (' || entity_type || ')' AS summary FROM ent
UNION ALL SELECT conversation_id, 2, 'added', 'relationship', source_id || '->' || target_id, split_part(source_id, ':', 4) || ' ' || rel_type || ' ' || split_part(target_id, ':', 4) FROM r
UNION ALL SELECT NULL, 3, CASE WHEN supersedes_seq IS NULL THEN 'added' ELSE 'superseded' END, 'fact', CAST(seq AS VARCHAR), fact_key || ': ' || status FROM fs""")(_deltas)


def _similar(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("block"), "embedding")
    return E.similar(v, v, threshold=0.3)


query("similar_entities", """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id AS probe_id, b.vec_id AS match_id, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
k AS (SELECT probe_id, match_id, round(c, 9) AS score, row_number() OVER (PARTITION BY probe_id ORDER BY round(c, 9) DESC, match_id) AS rank FROM p WHERE c > 0.3) SELECT * FROM k WHERE rank <= 5""")(_similar)


def _probes(s, d):
    u = FX.assertions(s, d).select("source_id").distinct()
    return u.withColumn("probe_at", F.explode(F.array(*[ntz(f"2024-01-{k:02d}") for k in (5, 12, 19, 26)])))


_P = "pb AS (SELECT source_id, unnest([TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-12', TIMESTAMP '2024-01-19', TIMESTAMP '2024-01-26']) AS probe_at FROM (SELECT DISTINCT source_id FROM a))"
query("as_of_join", f"WITH {R_SQL}, {_P} SELECT pb.source_id, pb.probe_at, r.seq, r.target_id, r.rel_type FROM pb JOIN r ON r.source_id = pb.source_id AND r.valid_from <= pb.probe_at AND (r.valid_to IS NULL OR r.valid_to > pb.probe_at)")(lambda s, d: T.as_of_join(_probes(s, d), edges(s, d), on=["source_id"], at="probe_at").select("source_id", "probe_at", "seq", "target_id", "rel_type"))
query("as_of_anti", f"WITH {R_SQL}, {_P} SELECT pb.source_id, pb.probe_at FROM pb WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rel_type = 'prefers' AND r.source_id = pb.source_id AND r.valid_from <= pb.probe_at AND (r.valid_to IS NULL OR r.valid_to > pb.probe_at))")(lambda s, d: T.as_of_join(_probes(s, d), edges(s, d).where(F.col("rel_type") == "prefers"), on=["source_id"], at="probe_at", how="left_anti"))
query("version_max", f"WITH {R_SQL} SELECT source_id, rel_type, max(version) AS max_version FROM r GROUP BY ALL")(lambda s, d: R.version_max(edges(s, d)))


def _terminate(s, d):
    ended, _ = R.terminate(edges(s, d), (F.col("tenant_id") == "t1") & (F.col("rel_type") == "prefers"), ntz(NOW))
    return ended.where((F.col("valid_to") == ntz(NOW)) & (F.col("recorded_to") == ntz(NOW))).agg(F.count(F.lit(1)).alias("terminated"))


query("terminate_count", f"WITH {R_SQL} SELECT count(*) AS terminated FROM r WHERE tenant_id = 't1' AND rel_type = 'prefers' AND valid_to IS NULL AND recorded_to IS NULL")(_terminate)
def _corrections(s, d):
    """Every event is a message; the first word of every third makes it a correction."""
    e = edges(s, d).withColumn("recorded_from", F.col("valid_from"))
    said = e.select("tenant_id", "conversation_id", "message_id", F.col("valid_from").alias("at"), F.concat(F.when(F.col("seq") % 3 == 0, "Actually, ").otherwise("Well, "), "rel_type").alias("text"))
    return R.retract(e, said.where(R.is_correction(F.col("text"))), minutes=600).select(*EDGE)


_OLD = "o.tenant_id = n.tenant_id AND o.conversation_id = n.conversation_id AND o.recorded_to IS NULL AND o.valid_from <= n.valid_from AND o.valid_from >= n.valid_from - INTERVAL 600 MINUTE AND o.seq < n.seq"
query("correction_retract", f"""WITH {R_SQL}, seen AS (SELECT n.seq AS own, n.valid_from AS tm, n.source_id AS s, n.rel_type AS t, n.target_id AS g, o.seq, o.source_id, o.rel_type, o.target_id,
  row_number() OVER (PARTITION BY n.seq ORDER BY o.valid_from DESC, o.seq DESC) AS k FROM r n JOIN r o ON n.seq % 3 = 0 AND {_OLD}),
hit AS (SELECT * FROM seen WHERE k <= 5 AND source_id = s AND rel_type = t AND target_id <> g), gone AS (SELECT seq, min(tm) AS tm FROM hit GROUP BY seq)
SELECT r.seq, tenant_id, group_id, r.source_id, r.target_id, r.rel_type, CASE WHEN gone.tm IS NOT NULL THEN 0.0 WHEN r.seq IN (SELECT own FROM hit) THEN 0.95 ELSE confidence END::DOUBLE AS confidence, version, valid_from,
  CASE WHEN gone.tm IS NOT NULL THEN valid_from ELSE valid_to END AS valid_to, valid_from AS recorded_from, coalesce(gone.tm, recorded_to) AS recorded_to, conflicts FROM r LEFT JOIN gone USING (seq)""")(_corrections)
query("is_correction", r"SELECT doc_id AS id, regexp_matches(lower(text), '(^actually,?\s)|(\bi meant\b)|(^correction:)|(^no,?\s)|(sorry,?\s.*misspoke)|(let me clarify)') AS correction FROM documents")(lambda s, d: table(s, d, "documents").select(F.col("doc_id").alias("id"), R.is_correction(F.col("text")).alias("correction")))
query("current_state", f"WITH {R_SQL} SELECT seq, target_id, rel_type, round({_DEC.format(1.0)}, 9) AS decayed FROM r WHERE valid_to IS NULL AND recorded_to IS NULL AND source_id = 't1:g1:PERSON:user-1' ORDER BY decayed DESC, seq LIMIT 20")(
    lambda s, d: R.current_state(edges(s, d), "t1:g1:PERSON:user-1", ntz(NOW)).select("seq", "target_id", "rel_type", "decayed"))
query("world_state_of_name", f"WITH {R_SQL}, {N_SQL[len(A_SQL) + 2:]} SELECT {E_COLS} FROM r WHERE {_V.format(AT)} AND source_id IN (SELECT id FROM ent WHERE tenant_id = 't1' AND canonical_name = 'user-1')")(
    lambda s, d: T.world_state(T.of_source(edges(s, d), people(s, d), "t1", "User 1"), ntz(AT)).select(*EDGE))
query("endpoint_stubs", f"WITH {A_SQL} SELECT DISTINCT target_id AS id FROM a")(lambda s, d: R.endpoint_stubs(edges(s, d), people(s, d).where(F.col("entity_type") == "PERSON")))
query("edge_view", f"WITH {R_SQL} SELECT source_id, target_id, rel_type, confidence, strftime(valid_from, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(valid_from) % 1000000 = 0 THEN '' ELSE strftime(valid_from, '.%f') END || '+00:00' AS valid_from, version FROM r WHERE tenant_id = 't1' AND valid_to IS NULL AND recorded_to IS NULL")(
    lambda s, d: V.view(R.active(edges(s, d), tenant="t1"), V.EDGE).select("source_id", "target_id", "rel_type", "confidence", "valid_from", "version"))
query("existing_edges", f"WITH {R_SQL}, live AS (SELECT source_id, target_id, rel_type, arg_min(confidence, seq) AS confidence FROM r WHERE valid_to IS NULL AND recorded_to IS NULL GROUP BY ALL) SELECT a.message_id, split_part(a.source_id, ':', 4) AS source, split_part(live.target_id, ':', 4) AS target, live.rel_type AS type, live.confidence FROM a JOIN live USING (source_id)")(
    lambda s, d: M.existing_edges(FX.assertions(s, d).select("message_id", F.col("source_id").alias("id")), edges(s, d)))


def _manifest(s, d):
    r = FX.records(s, d).where(F.col("event_date").isNotNull())
    first, last = X.period_range(F.regexp_replace(F.substring("event_date", 1, 7), "-", ""))
    return X.manifest(r.select("source", F.length("record_id").cast("long").alias("bytes"), first.alias("date"), last.alias("end_date")))


query("source_manifest", f"WITH {C_SQL} SELECT source, count(*) AS files, CAST(sum(length(record_id)) AS BIGINT) AS total_bytes, min(left(event_date, 7) || '-01') AS first_date, max(strftime(last_day(CAST(event_date AS DATE)), '%Y-%m-%d')) AS last_date FROM rec WHERE event_date IS NOT NULL GROUP BY source")(_manifest)
_split = lambda s, d: X.with_split(FX.records(s, d), "1998-12-31", "2000-12-31")
query("time_splits", f"WITH {C_SQL} SELECT seq, record_id, source, event_date, price, split FROM sp")(lambda s, d: _split(s, d).select("seq", "record_id", "source", "event_date", "price", "split"))
query("split_matrix", f"WITH {C_SQL} SELECT n.split, s.source, count(sp.seq) AS records FROM (SELECT unnest(['train', 'eval', 'holdout', 'unspecified']) AS split) n CROSS JOIN (SELECT DISTINCT source FROM rec) s LEFT JOIN sp ON sp.split = n.split AND sp.source = s.source GROUP BY ALL")(lambda s, d: X.split_matrix(_split(s, d)))
query("split_membership", f"WITH {C_SQL} SELECT record_id, arg_max(split, seq) AS split FROM sp GROUP BY record_id")(lambda s, d: X.membership(_split(s, d)))
query("fixture_sample", f"WITH {C_SQL} SELECT seq, record_id, source, event_date, price, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY seq) AS k FROM sp) WHERE k <= 50")(lambda s, d: X.fixture_sample(_split(s, d), 50).select("seq", "record_id", "source", "event_date", "price", "split"))
query("experiment_metrics", f"WITH {S_SQL} SELECT profile, {METRICS_SQL} FROM sc GROUP BY profile")(lambda s, d: X.metrics(scored(s, d), "profile"))
query("profile_agreement", f"WITH {S_SQL} SELECT round(coalesce(avg((x.top = y.top)::INT::DOUBLE), 0.0), 9) AS agreement, count(*) AS n FROM sc x JOIN sc y ON x.record_id = y.record_id AND x.profile = 'baseline' AND y.profile = 'distractor'")(lambda s, d: X.agreement(scored(s, d), "baseline", "distractor"))
query("calibration_bins", f"WITH {S_SQL}, b AS (SELECT least(CAST(floor(least(greatest(confidence, 0.0), 1.0) * 10) AS INTEGER), 9) AS bin, * FROM sc), g AS (SELECT bin, count(*) AS n, round(avg((top = tr)::INT::DOUBLE), 9) AS accuracy, round(avg(confidence), 7) AS mean_confidence FROM b GROUP BY bin) SELECT CAST(k.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, accuracy, mean_confidence FROM (SELECT unnest(range(10)) AS bin) k LEFT JOIN g ON k.bin = g.bin")(lambda s, d: X.calibration(scored(s, d)))
_AGREE = "round(avg((top = base)::INT::DOUBLE), 9) AS agreement"
query("budget_sweep", f"""WITH {C_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY seq) AS rn FROM sp), cut AS (SELECT * FROM k WHERE rn <= 100),
{scored_sql("cut")}, e AS (SELECT CAST(unnest([25, 50, 100]) AS INTEGER) AS budget),
m AS (SELECT sc.*, e.budget, max(CASE WHEN profile = 'baseline' THEN top END) OVER (PARTITION BY e.budget, record_id) AS base FROM sc JOIN e ON rn <= e.budget)
SELECT budget, profile, {METRICS_SQL}, {_AGREE} FROM m GROUP BY budget, profile""")(lambda s, d: X.budget_sweep(_split(s, d), [25, 50, 100]))
_chain = lambda s, d: X.research_pipeline(FX.records(s, d), train_until="1998-12-31", eval_until="2000-12-31")
_CHAIN = f"{C_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY seq) AS rn FROM sp), cut AS (SELECT * FROM k WHERE rn <= 250), {scored_sql('cut')}"
_NAME = lambda c: f"CASE {c} WHEN 0 THEN 'stability' WHEN 1 THEN 'distress' ELSE 'refi' END"
query("research_profiles", f"WITH {_CHAIN} SELECT profile, {METRICS_SQL} FROM sc GROUP BY profile")(lambda s, d: _chain(s, d)["profiles"])
query("research_samples", f"""WITH {_CHAIN}, o AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY list_position(['train', 'eval', 'holdout', 'unspecified'], split), seq) AS sample FROM sc)
SELECT profile, sample, record_id, s0 AS score_stability, s1 AS score_distress, s2 AS score_refi, {_NAME("top")} AS top, {_NAME("tr")} AS truth FROM o WHERE sample <= 3""")(
    lambda s, d: _chain(s, d)["samples"].select("profile", "sample", "record_id", "score_stability", "score_distress", "score_refi", "top", "truth"))
query("research_agreement", f"""WITH {_CHAIN} SELECT y.profile AS other, round(coalesce(avg((x.top = y.top)::INT::DOUBLE), 0.0), 9) AS agreement, count(*) AS n FROM sc x JOIN sc y ON x.record_id = y.record_id AND x.profile = 'baseline' AND y.profile <> 'baseline' GROUP BY y.profile""")(
    lambda s, d: (lambda c: c["agreement_reduced"].withColumn("other", F.lit("reduced_context")).unionByName(c["agreement_distractor"].withColumn("other", F.lit("distractor"))))(_chain(s, d)))
query("manifest_totals", f"WITH {C_SQL} SELECT count(*) AS files, CAST(sum(length(record_id)) AS BIGINT) AS total_bytes, min(left(event_date, 7) || '-01') AS first_date, max(strftime(last_day(CAST(event_date AS DATE)), '%Y-%m-%d')) AS last_date FROM rec WHERE event_date IS NOT NULL")(lambda s, d: X.manifest_totals(_manifest(s, d)))
query("source_periods", f"WITH {C_SQL} SELECT source, array_to_string(list_sort(list(DISTINCT left(event_date, 4))), ',') AS periods, min(left(event_date, 4)) AS first_period, max(left(event_date, 4)) AS last_period FROM rec WHERE event_date IS NOT NULL GROUP BY source")(
    lambda s, d: X.periods_by_source(FX.records(s, d).select("source", F.substring("event_date", 1, 4).alias("period"))).withColumn("periods", F.array_join("periods", ",")))
query("source_scaffold", f"WITH {C_SQL} SELECT record_id, source, list_position(['fannie', 'ginnie', 'edgar'], source) - 1 AS source_rank FROM rec")(
    lambda s, d: X.scaffold([FX.records(s, d).where(F.col("source") == name).select("record_id", "source") for name in ("fannie", "ginnie", "edgar")]))
query("reduced_metadata", "SELECT event_id, json_extract_string(props, '$.k') AS kept, CAST(1 AS BIGINT) AS n_keys FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", S.reduced_metadata(F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("z"), F.lit("y")))).alias("m")).select("event_id", F.element_at("m", "k").alias("kept"), F.size("m").cast("long").alias("n_keys")))
query("link_extract", """SELECT link, count(*) AS pages FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages) GROUP BY link""")(lambda s, d: SRC.links(table(s, d, "pages")))
query("latest_periods", "WITH f AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS period FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01') SELECT o_orderkey, period FROM f WHERE period IN (SELECT DISTINCT period FROM f ORDER BY period DESC LIMIT 3)")(
    lambda s, d: SRC.latest_periods(table(s, d, "orders").select("o_orderkey", F.concat(F.lit("monthly_"), F.date_format("o_orderdate", "yyyyMM"), F.lit(".zip")).alias("name")), 3).select("o_orderkey", "period"))
#: Paragraph after paragraph: chunk, its words so far and its first paragraph; without words so far the next one starts it anew.
CHUNK_SQL = r"""WITH RECURSIVE p AS (
  SELECT doc_id, unnest(x) AS text, unnest(range(1, len(x) + 1)) AS k FROM (SELECT doc_id, list_filter(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda p: trim(p) <> '') AS x FROM documents)
), w AS (
  SELECT *, len(list_filter(string_split_regex(text, '[\t\n\x0B\f\r ]+'), lambda t: t <> '')) AS words FROM p
), r AS (
  SELECT doc_id, k, 0 AS chunk, words AS n, k AS first FROM w WHERE k = 1
  UNION ALL
  SELECT w.doc_id, w.k, CASE WHEN n = 0 OR n + words <= 400 THEN chunk ELSE chunk + 1 END, CASE WHEN n + words <= 400 OR n = 0 THEN n + words ELSE words END, CASE WHEN n = 0 OR n + words > 400 THEN w.k ELSE first END
  FROM r JOIN w ON w.doc_id = r.doc_id AND w.k = r.k + 1
), c AS (SELECT doc_id, chunk, max(first) AS first, arg_max(n, k) AS n FROM r GROUP BY ALL)
SELECT c.doc_id, CAST(c.chunk AS INTEGER) AS chunk, string_agg(w.text, chr(10) || chr(10) ORDER BY w.k) AS text
FROM c JOIN r USING (doc_id, chunk) JOIN w ON w.doc_id = r.doc_id AND w.k = r.k WHERE c.n > 0 AND r.k >= c.first GROUP BY ALL"""
query("chunk_paragraphs", CHUNK_SQL)(lambda s, d: SRC.chunk_text(table(s, d, "documents").withColumn("text", F.regexp_replace("text", "\n", "\n\n")), 400))
