"""Queries over the state of the graph through time, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import analytics as AN
from ..operators import relationships as R
from ..operators import temporal as T
from ..operators import topics as TP
from ..operators.stored import shared_folder
from ..sources import files as SRC
from . import fixtures as FX
from .fixtures import R_SQL, table

BEFORE, AFTER, UNTIL = "2024-01-10", "2024-01-20", "2024-02-01"


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def edges(spark, sf_dir):
    return R.resolve(FX.assertions(spark, sf_dir))


def as_of_join_keyless(spark, sf_dir):
    """How many preferences hold at every event, and the first of them."""
    probes = table(spark, sf_dir, "events").select(F.col("event_id").alias("probe"), F.col("ts").alias("at"))
    wanted = {"n": ("sum", F.lit(1)), "first_seq": ("min", F.col("seq"))}
    found = T.as_of_aggregate(probes, edges(spark, sf_dir).where(F.col("rel_type").isin("prefers", "avoids")), wanted)
    return probes.join(found, "at").select("probe", "n", "first_seq")


KEYLESS_SQL = f"""WITH {R_SQL}
SELECT e.event_id AS probe, count(*) AS n, min(r.seq) AS first_seq
FROM events e JOIN r ON r.rel_type IN ('prefers', 'avoids') AND r.valid_from <= e.ts AND (r.valid_to IS NULL OR r.valid_to > e.ts)
GROUP BY e.event_id"""


def as_of_profile(spark, sf_dir):
    """What was believed at the start of every hour: edges, the last of them, and their confidence in hundredths."""
    hours = table(spark, sf_dir, "events").select(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour")).distinct()
    wanted = {"n": ("sum", F.lit(1)), "last_seq": ("max", F.col("seq")), "hundredths": ("sum", F.round(F.col("confidence") * 100).cast("long"))}
    return T.as_of_aggregate(hours, edges(spark, sf_dir), wanted, axis="recorded", at="hour")


PROFILE_SQL = f"""WITH {R_SQL}, h AS (SELECT DISTINCT date_trunc('hour', ts)::TIMESTAMP AS hour FROM events)
SELECT h.hour, count(*) AS n, max(r.seq) AS last_seq, CAST(sum(CAST(round(r.confidence * 100) AS BIGINT)) AS BIGINT) AS hundredths
FROM h JOIN r ON r.recorded_from <= h.hour AND (r.recorded_to IS NULL OR r.recorded_to > h.hour) AND (r.recorded_to IS NULL OR r.recorded_from < r.recorded_to)
GROUP BY h.hour"""


def graph_diff(spark, sf_dir):
    """What changed from ten days to twenty, as it was known on each of them."""
    return T.diff(edges(spark, sf_dir), (ntz(BEFORE), ntz(BEFORE)), (ntz(AFTER), ntz(AFTER)))


_HOLDS = "valid_from <= TIMESTAMP '{0}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{0}') AND recorded_from <= TIMESTAMP '{0}' AND (recorded_to IS NULL OR recorded_to > TIMESTAMP '{0}')"
_TRIPLE = "tenant_id, group_id, source_id, rel_type, target_id"
_STATE = "SELECT {t}, seq, version, valid_from, confidence FROM (SELECT *, row_number() OVER (PARTITION BY {t} ORDER BY version DESC, seq DESC) AS k FROM r WHERE {w}) WHERE k = 1"
DIFF_SQL = f"""WITH {R_SQL},
x AS ({_STATE.format(t=_TRIPLE, w=_HOLDS.format(BEFORE))}),
y AS ({_STATE.format(t=_TRIPLE, w=_HOLDS.format(AFTER))})
SELECT {_TRIPLE},
  CASE WHEN x.seq IS NULL THEN 'added' WHEN y.seq IS NULL THEN 'ended' WHEN x.version = y.version AND x.valid_from = y.valid_from THEN 're-believed' ELSE 'changed' END AS change,
  x.seq AS was_seq, y.seq AS now_seq, x.confidence AS was_confidence, y.confidence AS now_confidence
FROM x FULL JOIN y USING ({_TRIPLE}) WHERE x.seq IS DISTINCT FROM y.seq"""


def learned_decay(spark, sf_dir):
    """Daily rates at which preferences end, with their bounds."""
    return AN.learn_decay(edges(spark, sf_dir), ntz(UNTIL))


DECAY_SQL = f"""WITH {R_SQL},
t AS (SELECT rel_type, coalesce(valid_to <= TIMESTAMP '{UNTIL}', false) AS over, valid_from, valid_to FROM r WHERE valid_from <= TIMESTAMP '{UNTIL}'),
g AS (SELECT rel_type, CAST(sum(over::INT) AS BIGINT) AS ended, CAST(sum((NOT over)::INT) AS BIGINT) AS open,
  nullif(CAST(sum(greatest(date_diff('microsecond', valid_from, CASE WHEN over THEN valid_to ELSE TIMESTAMP '{UNTIL}' END), 0)) AS DOUBLE) / 86400000000.0::DOUBLE, 0.0) AS days FROM t GROUP BY rel_type)
SELECT rel_type, ended, open, round(coalesce(days, 0.0), 6) AS exposure_days, round(ended / days, 9) AS rate,
  round(CASE WHEN ended > 0 THEN ended / days / exp(1.96::DOUBLE / sqrt(ended::DOUBLE)) ELSE ended / days END, 9) AS low,
  round(CASE WHEN ended > 0 THEN ended / days * exp(1.96::DOUBLE / sqrt(ended::DOUBLE)) ELSE -ln(0.05::DOUBLE) / days END, 9) AS high FROM g"""


def strength_trend(spark, sf_dir):
    """Decayed strength of every source and type by day, its peak, and whether it weakens."""
    return AN.strength(edges(spark, sf_dir))


_RATES = "CASE rel_type WHEN 'prefers' THEN 0.05::DOUBLE WHEN 'avoids' THEN 0.04::DOUBLE WHEN 'discussed' THEN 0.03::DOUBLE WHEN 'mentioned_with' THEN 0.1::DOUBLE WHEN 'has_goal' THEN 0.02::DOUBLE ELSE 0.01::DOUBLE END"
_MASS = f"""{R_SQL},
m AS (SELECT tenant_id, source_id, rel_type, CAST(date_diff('day', DATE '1970-01-01', CAST(valid_from AS DATE)) AS BIGINT) AS day, round(sum(confidence), 6) AS mass FROM r GROUP BY ALL)"""
_SERIES = "PARTITION BY tenant_id, source_id, rel_type"
STRENGTH_SQL = f"""WITH {_MASS},
f AS (SELECT *, {_RATES} AS rate, list({{'d': day, 'm': mass}}) OVER ({_SERIES} ORDER BY day RANGE BETWEEN 27 PRECEDING AND CURRENT ROW) AS near FROM m),
s AS (SELECT * EXCLUDE (near, rate), round(list_sum(list_transform(near, lambda x: x.m * exp(-rate * (day - x.d)::DOUBLE))), 6) AS strength FROM f),
p AS (SELECT *, max(strength) OVER ({_SERIES} ORDER BY day RANGE BETWEEN 27 PRECEDING AND CURRENT ROW) AS peak FROM s)
SELECT *, strength < 0.5::DOUBLE * peak AS weakening FROM p"""


def strength_anomalies(spark, sf_dir):
    """Days on which a source's edges of a type are far from its median day."""
    return AN.anomalies(edges(spark, sf_dir))


ANOMALY_SQL = f"""WITH {_MASS},
c AS (SELECT tenant_id, source_id, rel_type, median(mass) AS median FROM m GROUP BY ALL),
o AS (SELECT m.*, c.median, abs(mass - c.median) AS off FROM m JOIN c USING (tenant_id, source_id, rel_type)),
d AS (SELECT tenant_id, source_id, rel_type, round(median(off), 6) AS spread FROM o GROUP BY ALL)
SELECT tenant_id, source_id, rel_type, day, mass, round(median, 6) AS median, spread, round(off / (1.4826::DOUBLE * spread), 6) AS score
FROM o JOIN d USING (tenant_id, source_id, rel_type) WHERE spread > 0 AND round(off / (1.4826::DOUBLE * spread), 6) >= 3.0"""


def corrections_in_order(spark, sf_dir):
    """Every event is a message; every third corrects what its conversation said in the ten hours before, one after the other."""
    e = edges(spark, sf_dir).withColumn("recorded_from", F.col("valid_from"))
    said = e.where(F.col("seq") % 3 == 0).select("tenant_id", "conversation_id", "message_id", F.col("valid_from").alias("at"))
    return R.retract_in_order(e, said, minutes=600).select("seq", "source_id", "rel_type", "target_id", "confidence", "valid_to", "recorded_to")


#: The fold as a recursion over the corrections of each conversation, with the list of what has been ended so far.
ORDER_SQL = f"""WITH RECURSIVE {R_SQL},
c AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, conversation_id ORDER BY valid_from, seq) AS step FROM r WHERE seq % 3 = 0),
near AS (SELECT c.tenant_id, c.conversation_id, c.step, list({{'seq': o.seq, 'hit': o.source_id = c.source_id AND o.rel_type = c.rel_type AND o.target_id <> c.target_id}} ORDER BY o.valid_from DESC, o.seq DESC) AS seen
  FROM c JOIN r o ON o.tenant_id = c.tenant_id AND o.conversation_id = c.conversation_id AND o.recorded_to IS NULL
   AND o.valid_from <= c.valid_from AND o.valid_from >= c.valid_from - INTERVAL 600 MINUTE AND o.seq < c.seq GROUP BY ALL),
fold AS (
  SELECT tenant_id, conversation_id, 0::BIGINT AS step, []::BIGINT[] AS gone, []::BIGINT[] AS own FROM c GROUP BY ALL
  UNION ALL
  SELECT c.tenant_id, c.conversation_id, c.step, list_concat(gone, new), new
  FROM (SELECT fold.tenant_id, fold.conversation_id, fold.step, fold.gone,
          coalesce(list_transform(list_filter(list_filter(near.seen, lambda x: NOT list_contains(fold.gone, x.seq))[1:5], lambda x: x.hit), lambda x: x.seq), []) AS new
        FROM fold LEFT JOIN near ON near.tenant_id = fold.tenant_id AND near.conversation_id = fold.conversation_id AND near.step = fold.step + 1) f
  JOIN c ON c.tenant_id = f.tenant_id AND c.conversation_id = f.conversation_id AND c.step = f.step + 1),
done AS (SELECT c.seq AS by_seq, c.valid_from AS tm, unnest(fold.own) AS seq FROM fold JOIN c USING (tenant_id, conversation_id, step))
SELECT r.seq, r.source_id, r.rel_type, r.target_id,
  CASE WHEN d.seq IS NOT NULL THEN 0.0 WHEN r.seq IN (SELECT by_seq FROM done) THEN 0.95 ELSE r.confidence END::DOUBLE AS confidence,
  CASE WHEN d.seq IS NOT NULL THEN r.valid_from ELSE r.valid_to END AS valid_to, coalesce(d.tm, r.recorded_to) AS recorded_to
FROM r LEFT JOIN done d ON d.seq = r.seq"""


def entity_importance(spark, sf_dir):
    """Every entity's importance by the active edges, decayed to the first of February."""
    return AN.importance(edges(spark, sf_dir), ntz(UNTIL)).withColumn("importance", F.round("importance", 9))


def topic_clusters(spark, sf_dir):
    """Topics of the embeddings over three periods of a third of them each."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3).cast("long").alias("period"), "embedding")
    return TP.topics(e, near=0.2).withColumn("likeness", F.round("likeness", 6))


def world_state_stored(spark, sf_dir):
    """The state of the world as of a day, read from a stored graph: only files whose time it may be are opened."""
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    SRC.write_graph(edges(spark, sf_dir), path, file_rows=GRAPH_ROWS)
    return SRC.read_graph(spark, path, valid_at=ntz(BEFORE)).select(*EDGE)


GRAPH_ROWS = 5_000
EDGE = ["seq", "tenant_id", "group_id", "source_id", "target_id", "rel_type", "confidence", "version", "valid_from", "valid_to", "recorded_from", "recorded_to", "conflicts"]
STORED_SQL = f"WITH {R_SQL} SELECT {', '.join(EDGE)} FROM r WHERE valid_from <= TIMESTAMP '{BEFORE}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{BEFORE}')"

QUERIES = {
    "as_of_join_keyless": as_of_join_keyless, "as_of_profile": as_of_profile, "graph_diff": graph_diff, "world_state_stored": world_state_stored, "learned_decay": learned_decay,
    "strength_trend": strength_trend, "strength_anomalies": strength_anomalies, "corrections_in_order": corrections_in_order, "entity_importance": entity_importance, "topic_clusters": topic_clusters,
}
ORACLE = {
    "as_of_join_keyless": KEYLESS_SQL, "as_of_profile": PROFILE_SQL, "graph_diff": DIFF_SQL, "world_state_stored": STORED_SQL, "learned_decay": DECAY_SQL,
    "strength_trend": STRENGTH_SQL, "strength_anomalies": ANOMALY_SQL, "corrections_in_order": ORDER_SQL,
}
