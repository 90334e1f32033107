"""Messages: dedup, runs, context, extraction output to rows, the ingest pipeline, snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import scalars as S
from . import entities as E
from . import facts as FA
from . import relationships as R

#: The extraction output by stage, as JSON in columns of the messages.
SCHEMAS = {
    "entities": "entities array<struct<name string, canonical string, type string, confidence double>>",
    "relationships": "relationships array<struct<source_mention string, target_mention string, type string, evidence string, temporal_marker string, confidence double, structured_evidence struct<text string, context string>>>",
    "facts": "facts array<struct<entity_mention string, fact_key string, fact_text string, supersedes_key string, confidence double>>",
    "commitments": "commitments array<struct<entity_mention string, text string, target_date string, confidence double>>",
    "summary": "opening_state string, key_shift string, closing_state string, breakthrough boolean",
}


def first_arrivals(messages: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """The first row of each message id by seq, without ids processed before."""
    first = messages.withColumn("_k", F.row_number().over(W.partitionBy("message_id").orderBy("seq"))).where(F.col("_k") == 1).drop("_k")
    return first if processed is None else first.join(processed.select("message_id"), "message_id", "left_anti")


#: The context of a message: days back, entities, facts of each, edges, characters of evidence.
LOOKBACK_DAYS, CONTEXT_ENTITIES, CONTEXT_FACTS, CONTEXT_EDGES, EVIDENCE_CHARS = 7, 20, 5, 20, 100


def runs(messages: DataFrame) -> DataFrame:
    """A run per message: status, error_text, the stage it ended after, and its times.

    Output that isn't JSON fails the run.  A message without a known entity is completed
    after its first stage, so what later stages hold doesn't matter.  prompt_id and
    the model's settings are carried if messages have them; so are started_at and
    completed_at, which give processing_time_ms.
    """
    parsed = lambda k: F.try_parse_json(f"{k}_json").isNotNull() | F.col(f"{k}_json").isNull()
    listed = F.from_json("entities_json", SCHEMAS["entities"])["entities"]
    known = F.coalesce(F.exists(listed, lambda x: x["type"].isin(*S.ENTITY_TYPES) & x["canonical"].isNotNull()), F.lit(False))
    later = [F.when(known & ~parsed(k), F.lit(f"{k}: not JSON")) for k in SCHEMAS if k != "entities" and f"{k}_json" in messages.columns]
    error = F.nullif(F.concat_ws("; ", F.when(~parsed("entities"), F.lit("entities: not JSON")), *later), F.lit(""))
    carried = [c for c in ("prompt_id", "prompt_sha256", "provider", "model", "temperature", "started_at", "completed_at") if c in messages.columns]
    rows = messages.select("message_id", "tenant_id", "conversation_id", *carried, error.alias("error_text"), F.when(known, "all").otherwise("entities").alias("ended_after"))
    rows = rows.withColumn("status", F.when(F.col("error_text").isNull(), "completed").otherwise("failed"))
    if {"started_at", "completed_at"} <= set(carried):
        rows = rows.withColumn("processing_time_ms", F.timestamp_diff("MICROSECOND", "started_at", "completed_at") / 1000.0)
    return rows


def rollback(processed: DataFrame, finished: DataFrame) -> DataFrame:
    """Ids that count as processed: those of failed runs don't, so their messages may come again."""
    return processed.join(finished.where(F.col("status") == "failed").select("message_id"), "message_id", "left_anti")


def context(messages: DataFrame, entities: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Per message what is known before it: entities (name, type, known_facts) and relationships (source, target, type, evidence).

    The tables hold the state that the messages of a batch find.  A conversation's
    entities are those last mentioned, 20 at most and none older than seven days;
    each has its first five active facts; its edges are the first 20 distinct
    active ones.  The lists are cut before messages join them, so a message costs
    no more rows than its context has.
    """
    top = F.row_number().over(W.partitionBy("tenant_id", "conversation_id").orderBy(F.desc("last_mentioned"), "id"))
    recent = entities.withColumn("rank", top).where(F.col("rank") <= CONTEXT_ENTITIES).select("tenant_id", "conversation_id", "id", "rank", "canonical_name", "entity_type", "last_mentioned")
    nth = F.row_number().over(W.partitionBy("entity_id").orderBy("seq"))
    held = facts.where(F.col("status") == "active").withColumn("_k", nth).where(F.col("_k") <= CONTEXT_FACTS)
    held = held.groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("_k", "fact_key", "fact_text", "confidence"))).alias("f"))
    known = F.transform("f", lambda x: F.struct(x["fact_key"].alias("key"), x["fact_text"].alias("text"), x["confidence"].alias("confidence")))
    rows = messages.select("message_id", "tenant_id", "conversation_id", "timestamp").join(recent, ["tenant_id", "conversation_id"], "left").where(F.col("id").isNull() | (F.col("last_mentioned") >= F.timestamp_add("DAY", F.lit(-LOOKBACK_DAYS), F.col("timestamp"))))
    rows = rows.where(F.col("id").isNotNull())
    named = rows.join(held, "id", "left").select("message_id", "rank", F.struct("rank", F.col("canonical_name").alias("name"), F.col("entity_type").alias("type"), known.alias("known_facts")).alias("e"))
    listed = named.groupBy("message_id").agg(F.array_sort(F.collect_list("e")).alias("entities"))
    live = R.distinct_triples(edges.where(R.is_active())).select(F.col("source_id").alias("id"), "seq", "source_id", "target_id", "rel_type", F.coalesce(F.substring("evidence", 1, EVIDENCE_CHARS), F.lit("")).alias("evidence"))
    first = F.row_number().over(W.partitionBy("id").orderBy("seq"))
    live = live.withColumn("nth", first).where(F.col("nth") <= CONTEXT_EDGES)
    place = F.row_number().over(W.partitionBy("message_id").orderBy("rank", "nth"))
    linked = rows.select("message_id", "id", "rank").join(live, "id").withColumn("nth", place).where(F.col("nth") <= CONTEXT_EDGES)
    edge = F.struct("nth", S.short_name(F.col("source_id")).alias("source"), S.short_name(F.col("target_id")).alias("target"), F.col("rel_type").alias("type"), "evidence")
    linked = linked.groupBy("message_id").agg(F.array_sort(F.collect_list(edge)).alias("relationships"))
    return messages.select("message_id").join(listed, "message_id", "left").join(linked, "message_id", "left").select("message_id", F.coalesce("entities", F.array()).alias("entities"), F.coalesce("relationships", F.array()).alias("relationships"))


def existing_edges(mentioned: DataFrame, edges: DataFrame) -> DataFrame:
    """mentioned (message_id, id): the distinct active edges that go out of a message's entities, with their confidence.

    Triples are made distinct once for each source, and a source hands on one list,
    so the join has a row for each mention however many edges its source has had.
    """
    first = edges.where(R.is_active()).groupBy("source_id", "rel_type", "target_id").agg(F.min_by("confidence", "seq").alias("confidence"))
    listed = first.groupBy("source_id").agg(F.collect_list(F.struct("target_id", "rel_type", "confidence")).alias("e"))
    found = mentioned.select("message_id", F.col("id").alias("source_id")).distinct().join(listed, "source_id")
    rows = found.select("message_id", "source_id", F.inline("e"))
    return rows.select("message_id", S.short_name(F.col("source_id")).alias("source"), S.short_name(F.col("target_id")).alias("target"), F.col("rel_type").alias("type"), "confidence")


def _unpack(messages: DataFrame, stage: str, *carried: str) -> DataFrame:
    parsed = messages.withColumn("_p", F.from_json(f"{stage}_json", SCHEMAS[stage]))
    return parsed.select("message_id", "seq", "tenant_id", "group_id", "conversation_id", "timestamp", *carried, F.posexplode(f"_p.{stage}").alias("i", "x"))


def extract(messages: DataFrame) -> dict[str, DataFrame]:
    """messages with JSON columns of each stage to entity arrivals, edges (resolved), facts (superseded), commitments, summaries.

    A message id stands on one row (see ``first_arrivals``).  A message without
    entities goes no further.  Unknown entity types are skipped, unknown
    relationship types become relates_to, unresolved mentions drop their row; ids
    keep the raw array's index.

    A message's own entities are in its own row, so mentions of them are resolved
    there without a shuffle.  Only mentions that it doesn't hold look for what the
    conversation knew before.
    """
    m = messages.withColumn("group_id", S.effective_group(F.col("group_id"), F.col("conversation_id")))
    listed = F.transform(F.from_json("entities_json", SCHEMAS["entities"])["entities"], lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    m = _once(m, _e=F.filter(listed, lambda r: r["x"]["type"].isin(*S.ENTITY_TYPES) & r["x"]["canonical"].isNotNull()))
    live = m.where(F.size("_e") > 0)
    raw = live.select("message_id", "seq", "tenant_id", "group_id", "conversation_id", "timestamp", F.inline("_e"))
    arrivals = raw.select(
        S.entity_id(F.col("tenant_id"), F.col("group_id"), F.col("x.type"), F.col("x.canonical")).alias("id"), "tenant_id", "group_id", "conversation_id", F.col("x.type").alias("entity_type"), F.col("x.canonical").alias("canonical_name"),
        F.array("x.name").alias("aliases"), F.array("message_id").alias("source_messages"), F.col("timestamp").alias("created_at"), F.col("timestamp").alias("last_mentioned"), (F.col("seq") * 1000 + F.col("i")).alias("seq"), "message_id", "i",
    )
    named = lambda r: F.struct(S.entity_id(F.col("tenant_id"), F.col("group_id"), r["x"]["type"], r["x"]["canonical"]).alias("id"), S.normalize_name(r["x"]["canonical"]).alias("name"), S.normalize_name(r["x"]["name"]).alias("alias"))
    live = _once(live, _names=F.transform("_e", named))
    rel = _once(_unpack(live, "relationships", "_names"), _s=S.normalize_name(F.col("x.source_mention")), _t=S.normalize_name(F.col("x.target_mention")))
    rel = _once(rel, source_id=_own("_s"), target_id=_own("_t")).drop("_names")
    here = F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
    keys = ["tenant_id", "conversation_id"]
    known = _known_before(arrivals, keys)
    before = lambda c: F.coalesce(F.col(f"{c}_id"), F.when(F.col(f"_{c}.since") < F.col("seq") * 1000, F.col(f"_{c}.id")))
    asked = rel.where(~here)
    for c, norm in (("source", "_s"), ("target", "_t")):
        asked = asked.join(known.select(*keys, F.col("norm").alias(norm), F.col("m").alias(f"_{c}")), [*keys, norm], "left")
    asked = asked.withColumns({"source_id": before("source"), "target_id": before("target")}).where(here).select(rel.columns)
    rel = rel.where(here).unionByName(asked)
    edges = rel.select(
        (F.col("seq") * 1000 + F.col("i")).alias("seq"), "tenant_id", "group_id", "conversation_id", "message_id", "source_id", "target_id", S.relationship_type(F.col("x.type")).alias("rel_type"),
        F.when(~F.col("x.type").isin(*S.RELATIONSHIP_TYPES), F.col("x.type")).alias("original_type"), S.snap_confidence(F.col("x.confidence")).alias("confidence"), F.col("x.evidence").alias("evidence"),
        F.when(F.col("x.structured_evidence").isNotNull(), F.array(F.struct("message_id", F.col("x.structured_evidence.text").alias("text"), F.col("x.structured_evidence.context").alias("context"), F.col("timestamp").alias("observed_at")))).alias("structured_evidence"),
        F.col("timestamp").alias("valid_from"), F.col("timestamp").alias("recorded_from"),
    )
    mentioned = lambda stage: _once(_once(_unpack(live, stage, "_names"), _s=S.normalize_name(F.col("x.entity_mention"))), entity_id=_own("_s")).where(F.col("entity_id").isNotNull())
    fact_rows = mentioned("facts").select(
        F.concat_ws(":", "tenant_id", F.lit("fact"), "message_id", "i").alias("id"), "tenant_id", "entity_id", (F.col("seq") * 1000 + F.col("i")).alias("seq"), F.col("x.fact_key").alias("fact_key"), F.col("x.fact_text").alias("fact_text"),
        F.nullif(F.col("x.supersedes_key"), F.lit("")).alias("supersedes_key"), S.snap_confidence(F.col("x.confidence")).alias("confidence"), F.col("timestamp").alias("valid_from"),
    )
    com = mentioned("commitments").select(
        F.concat_ws(":", "tenant_id", F.lit("commitment"), "message_id", "i").alias("id"), "tenant_id", "entity_id", F.col("x.text").alias("text"), F.lit("active").alias("status"), F.col("timestamp").alias("created_at"),
        F.try_to_timestamp(F.col("x.target_date")).cast("timestamp_ntz").alias("target_date"), S.snap_confidence(F.col("x.confidence")).alias("confidence"),
    )
    s = live.withColumn("s", F.from_json("summary_json", SCHEMAS["summary"]))
    summaries = s.select(F.concat_ws(":", "tenant_id", F.lit("summary"), "message_id").alias("id"), "message_id", F.coalesce("s.opening_state", F.lit("")).alias("opening_state"), F.col("s.key_shift").alias("key_shift"), F.coalesce("s.closing_state", F.lit("")).alias("closing_state"), F.coalesce("s.breakthrough", F.lit(False)).alias("breakthrough"))
    return {"arrivals": arrivals, "entities": E.upsert(arrivals), "edges": R.resolve(edges), "facts": FA.supersede(fact_rows, ("tenant_id", "entity_id")), "commitments": com, "summaries": summaries}


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are worked out once a row: as a generator's, which filters and lambdas above don't repeat."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _own(norm: str) -> Column:
    """The first entity of the row's ``_names`` whose name, else alias, is the normal form."""
    first = lambda part: F.get(F.filter("_names", lambda e: e[part] == F.col(norm)), F.lit(0))["id"]
    return F.coalesce(first("name"), first("alias"))


def _known_before(arrivals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, norm, m: by conversation and normal form the first entity that had it (since, pass, id).

    An entity counts from its first arrival under whatever name.  A mention meets
    one row, so a long conversation costs no pairs.
    """
    earlier = arrivals.groupBy(*keys, "id").agg(F.min("seq").alias("since"), F.min_by("canonical_name", "seq").alias("name"), F.collect_set(F.col("aliases")[0]).alias("aliases"))
    form = lambda p, text: F.struct(F.lit(p).alias("pass"), S.normalize_name(text).alias("norm"))
    forms = earlier.select(*keys, "id", "since", F.inline(F.array_append(F.transform("aliases", lambda a: form(2, a)), form(1, F.col("name")))))
    return forms.where(F.col("norm").isNotNull()).groupBy(*keys, "norm").agg(F.min(F.struct("since", "pass", "id")).alias("m"))


def ingest_response(messages: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Per message: how many entities, edges and conflicts came of it.  All are counted in one shuffle, which the join reads."""
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    entities = parts["arrivals"].select("message_id", one.alias("entities"), none.alias("relationships"), none.alias("conflicts"))
    edges = parts["edges"].select("message_id", none.alias("entities"), one.alias("relationships"), "conflicts")
    counts = entities.unionByName(edges).groupBy("message_id").agg(*[F.sum(c).alias(c) for c in ("entities", "relationships", "conflicts")])
    return messages.select("message_id").join(counts, "message_id", "left").na.fill(0)


def snapshot(entities: DataFrame, edges: DataFrame, facts: DataFrame, limit: int = 500) -> DataFrame:
    """Per tenant and conversation: counts of entities, distinct active triples and active facts, and the entities' names.

    The newest ``limit`` entities of a conversation are its entities, as in its listing.
    """
    newest = F.row_number().over(W.partitionBy("tenant_id", "conversation_id").orderBy(F.desc("created_at"), "id"))
    listed = entities.withColumn("_k", newest).where(F.col("_k") <= limit)
    mine = listed.select("tenant_id", "conversation_id", F.col("id").alias("source_id"))
    triples = edges.where(R.is_active()).select("source_id", "target_id", "rel_type").distinct().join(mine, "source_id").groupBy("tenant_id", "conversation_id").agg(F.count(F.lit(1)).alias("relationship_count"))
    held = facts.where(F.col("status") == "active").select(F.col("entity_id").alias("source_id")).join(mine, "source_id").groupBy("tenant_id", "conversation_id").agg(F.count(F.lit(1)).alias("fact_count"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("_k", "canonical_name"))), lambda r: r["canonical_name"])
    base = listed.groupBy("tenant_id", "conversation_id").agg(F.count(F.lit(1)).alias("entity_count"), names.alias("entity_names"))
    return base.join(triples, ["tenant_id", "conversation_id"], "left").join(held, ["tenant_id", "conversation_id"], "left").na.fill(0, ["relationship_count", "fact_count"])


def deltas(entities: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """A row per change, in the order of position (entities, relationships, facts): change_type, artifact_type, artifact_id, summary."""
    row = lambda df, k, kind, change, ident, text: df.select(
        F.col("conversation_id") if "conversation_id" in df.columns else F.lit(None).cast("string").alias("conversation_id"), F.lit(k).alias("position"), change.alias("change_type"), F.lit(kind).alias("artifact_type"), ident.cast("string").alias("artifact_id"), text.alias("summary")
    )
    added, side = F.lit("added"), lambda c: S.short_name(F.col(c))
    fact_id = F.col("id") if "id" in facts.columns else F.col("seq")
    e = row(entities, 1, "entity", added, F.col("id"), F.concat(F.lit("New entity: "), "canonical_name", F.lit(" ("), "entity_type", F.lit(")")))
    r = row(edges, 2, "relationship", added, F.concat("source_id", F.lit("->"), "target_id"), F.concat(side("source_id"), F.lit(" "), "rel_type", F.lit(" "), side("target_id")))
    f = row(facts, 3, "fact", F.when(F.col("supersedes_seq").isNotNull(), "superseded").otherwise("added"), fact_id, F.concat("fact_key", F.lit(": "), "fact_text"))
    return e.unionByName(r).unionByName(f)


def within_budget(items: DataFrame, budget: int, by: str = "conversation_id") -> DataFrame:
    """items (``by``, item_id, value, tokens) that a greedy choice takes under so many tokens for each group, with place (its order) and used (tokens so far).

    The most value for a token comes first, then the greater value, then the lesser
    id; an item that no longer fits is passed over.  Items without a value above 0, or with
    less than a token, are never taken; nor those larger than the budget.  A group's
    items are read in order as a stream with one number of state, so a long one
    costs no memory.
    """
    rows = items.where((F.col("value") > 0) & (F.col("tokens") > 0) & (F.col("tokens") <= budget))
    dealt = rows.withColumn("_ratio", F.col("value") / F.col("tokens")).repartition(by).sortWithinPartitions(by, F.desc("_ratio"), F.desc("value"), "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used, place, begun = None, 0, 0, False
        for b in batches:
            keep, places, totals = [], [], []
            for k, (g, n) in enumerate(zip(b.column(by).to_pylist(), b.column("tokens").to_pylist())):
                if not begun or g != group:
                    group, used, place, begun = g, 0, 0, True
                if used + n <= budget:
                    used, place = used + n, place + 1
                    keep.append(k)
                    places.append(place)
                    totals.append(used)
            taken = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(places, pa.int64()), pa.array(totals, pa.int64())], names=[*b.schema.names, "place", "used"])

    schema = T.StructType([*dealt.schema.fields, T.StructField("place", T.LongType()), T.StructField("used", T.LongType())])
    return dealt.mapInArrow(run, schema).drop("_ratio")
