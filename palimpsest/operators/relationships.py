"""Versioned edges: resolution of conflicts, termination, decay, corrections."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from .stored import checkpointed

#: Types that close earlier edges, and the class that shares one open edge.
CLOSING = {"prefers": "preference", "avoids": "preference"}
KEYS = ["tenant_id", "group_id", "source_id"]


def edge_class(rel_type: Column) -> Column:
    return F.when(rel_type.isin(*CLOSING), F.lit("preference"))


def resolve(assertions: DataFrame, *, mode: str = "code", prior: DataFrame | None = None) -> DataFrame:
    """Assertions in arrival order (seq) to versioned edges with four time columns.

    A closing type ends the open edge of its class when the next one arrives.
    mode "code" ends belief at the next edge's valid_from; "spec" at its
    recorded_from.  prior: open edges and last versions of earlier batches, as
    resolved rows; those it closes are returned again.  One shuffle and one sort
    by source and class serve all columns: versions are counted by type inside the
    class, and types that close nothing have none but the first.
    """
    never = F.lit(None).cast("timestamp_ntz")
    rows = assertions.withColumn("_v0", F.lit(0).cast("long")).withColumn("_to", never).withColumn("_known", never)
    if prior is not None:  # what ended before keeps its end
        rows = rows.unionByName(prior.select(*assertions.columns, F.col("version").alias("_v0"), F.col("valid_to").alias("_to"), F.col("recorded_to").alias("_known")))
    rows = rows.withColumn("_class", edge_class(F.col("rel_type")))
    by_class = W.partitionBy(*KEYS, "_class").orderBy("seq")
    so_far = by_class.rowsBetween(W.unboundedPreceding, 0)
    end = F.lead("valid_from").over(by_class)
    known = F.lead("valid_from" if mode == "code" else "recorded_from").over(by_class)
    closing = F.col("_class").isNotNull()
    of_type = lambda kind, value: F.when(F.col("rel_type") == kind, value)
    number = lambda kind: F.max(of_type(kind, F.col("_v0"))).over(so_far) + F.sum(of_type(kind, (F.col("_v0") == 0).cast("long"))).over(so_far)
    return (
        rows.withColumn("version", F.coalesce(*[of_type(kind, number(kind)) for kind in CLOSING], F.lit(1)).cast("long"))
        .withColumn("valid_to", F.coalesce("_to", F.when(closing, end))).withColumn("recorded_to", F.coalesce("_known", F.when(closing, known)))
        .withColumn("conflicts", F.when(closing & F.lag("seq").over(by_class).isNotNull(), 1).otherwise(0).cast("long")).drop("_class", "_v0", "_to", "_known")
    )


def terminate(edges: DataFrame, match: Column, at: Column, exclude_target: str | None = None) -> tuple[DataFrame, Column]:
    """Edges with the active matches ended at ``at``, and the condition that chose them."""
    hit = match & is_active() & (F.col("target_id") != exclude_target if exclude_target else F.lit(True))
    ended = edges.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    return ended.withColumn("valid_to", F.when(F.col("_hit"), at).otherwise(F.col("valid_to"))).withColumn("recorded_to", F.when(F.col("_hit"), at).otherwise(F.col("recorded_to"))).drop("_hit"), hit


def is_active() -> Column:
    return F.col("valid_to").isNull() & F.col("recorded_to").isNull()


def active(edges: DataFrame, source_id: str | None = None, rel_type: str | None = None, tenant: str | None = None) -> DataFrame:
    for name, value in (("source_id", source_id), ("rel_type", rel_type), ("tenant_id", tenant)):
        edges = edges.where(F.col(name) == value) if value is not None else edges
    return edges.where(is_active())


def active_with_decay(edges: DataFrame, now: Column, preset: str = "normal") -> DataFrame:
    """Active edges with their confidence decayed to ``now``."""
    return edges.where(is_active()).withColumn("decayed", F.round(S.decayed_confidence(F.col("confidence"), F.col("rel_type"), F.col("valid_from"), now, preset), 9))


def current_state(edges: DataFrame, source_id: str, now: Column, preset: str = "normal", limit: int = 20) -> DataFrame:
    """A source's active edges, the surest after decay first."""
    return active_with_decay(active(edges, source_id), now, preset).orderBy(F.desc("decayed"), "seq").limit(limit)


def distinct_triples(edges: DataFrame, *by: str) -> DataFrame:
    """The first edge of each (source, type, target), within ``by``."""
    first = F.row_number().over(W.partitionBy(*by, "source_id", "rel_type", "target_id").orderBy("seq"))
    return edges.withColumn("_k", first).where(F.col("_k") == 1).drop("_k")


def redirected_count(moved: DataFrame) -> DataFrame:
    """How many edges a merge has redirected."""
    return moved.agg(F.coalesce(F.sum(F.col("redirected").cast("long")), F.lit(0)).alias("redirected"))


def endpoint_stubs(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Ids that edges name and entities lack."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return ends.join(entities.select("id"), "id", "left_anti")


def version_max(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source_id", "rel_type").agg(F.coalesce(F.max("version"), F.lit(0)).cast("long").alias("max_version"))


# Signs of a correction in a message in small letters.
CORRECTION_SIGNS = (r"^actually,?\s", r"\bi meant\b", r"^correction:", r"^no,?\s", r"sorry,?\s.*misspoke", r"let me clarify")
CORRECTED_CONFIDENCE = 0.95


def is_correction(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(f"(?:{p})" for p in CORRECTION_SIGNS)), F.lit(False))


def retract(edges: DataFrame, corrections: DataFrame, *, minutes: int = 10, latest: int = 5) -> DataFrame:
    """corrections: tenant_id, conversation_id, message_id, at.  Edges with what correcting messages say applied.

    For each correction the ``latest`` edges of its tenant and conversation that
    came before its own, were recorded within so many minutes up to it and are
    still believed are looked at.  Those with the source and type of one of its
    own edges, but another target, end: belief at the correction's time, truth at
    their start, confidence 0; its own such edges get 0.95.  An edge that several
    corrections end takes the first one's time.  All corrections see the same
    state, that of ``edges``.

    Edges and corrections meet in time units of ``minutes``: an edge is dealt to its
    own and the next one, a correction to its own.  A unit of a conversation is read
    in order of time as a stream, in which a correction looks back over the edges
    before it, so no pairs are made; what a task holds is two units of a conversation.
    """
    keys, window = ["tenant_id", "conversation_id"], minutes * 60_000_000
    time = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))
    unit = F.floor(F.col("_t") / F.lit(window)).cast("long")
    own = edges.join(corrections.select("message_id", "at"), "message_id").groupBy(*keys, "message_id", "at").agg(F.min("seq").alias("seq"), F.collect_list(F.struct("seq", "source_id", "rel_type", "target_id")).alias("own"))
    none, text = F.lit(None).cast(own.schema["own"].dataType), F.lit(None).cast("string")
    said = own.select(*keys, time("at").alias("_t"), F.lit(1).alias("_kind"), "seq", text.alias("source_id"), text.alias("rel_type"), text.alias("target_id"), "own").withColumn("_unit", unit)
    seen = edges.where(F.col("recorded_to").isNull()).select(*keys, time("recorded_from").alias("_t"), F.lit(0).alias("_kind"), "seq", "source_id", "rel_type", "target_id", none.alias("own"))
    seen = seen.withColumn("_unit", F.explode(F.array(unit, unit + 1)))
    named = F.col("tenant_id").isNotNull() & F.col("conversation_id").isNotNull() & F.col("_t").isNotNull()
    dealt = seen.unionByName(said).where(named).repartition(*keys, "_unit").sortWithinPartitions(*keys, "_unit", "_t", "_kind", "seq")
    changes = dealt.mapInArrow(_looked_back(window, latest), "seq long, ended long, sure boolean")
    change = changes.groupBy("seq").agg(F.min("ended").alias("_ended"), F.max("sure").alias("_sure"))
    out, hit = edges.join(change, "seq", "left"), F.col("_ended").isNotNull()
    at = F.timestamp_add("MICROSECOND", F.col("_ended"), F.lit("1970-01-01").cast("timestamp_ntz"))
    confidence = F.when(hit, F.lit(0.0)).when(F.col("_sure"), F.lit(CORRECTED_CONFIDENCE)).otherwise(F.col("confidence"))
    return out.withColumns({"recorded_to": F.when(hit, at).otherwise(F.col("recorded_to")), "valid_to": F.when(hit, F.col("valid_from")).otherwise(F.col("valid_to")), "confidence": confidence}).drop("_ended", "_sure")


#: Rows of a block whose least seq is kept; a block of blocks has as many blocks.
BLOCK = 64


def _looked_back(window: int, latest: int):
    """For mapInArrow over rows in order: (seq, time at which it was ended) and (seq, sure) of what corrections change; nothing changes what later ones see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, times, edges, first = None, [], [], 0
        least: list[list[int]] = [[], []]  # by block, and by block of blocks
        same: dict[str, str] = {}
        for b in batches:
            seqs, ended, sure = [], [], []
            columns = (b.column(c).to_pylist() for c in ("tenant_id", "conversation_id", "_unit", "_t", "_kind", "seq", "source_id", "rel_type", "target_id", "own"))
            for tenant, conversation, unit, t, kind, seq, source, rel, target, own in zip(*columns):
                if (tenant, conversation, unit) != group:
                    group, times, edges, first, least, same = (tenant, conversation, unit), [], [], 0, [[], []], {}
                if kind == 0:
                    for level, size in enumerate((BLOCK, BLOCK * BLOCK)):
                        if len(times) % size == 0:
                            least[level].append(seq)
                        elif seq < least[level][-1]:
                            least[level][-1] = seq
                    times.append(t)
                    edges.append((seq, same.setdefault(source, source), same.setdefault(rel, rel), same.setdefault(target, target)))
                    continue
                while first < len(times) and times[first] < t - window:
                    first += 1
                k, looked = len(times) - 1, 0
                while k >= first and looked < latest:
                    if least[1][k // (BLOCK * BLOCK)] >= seq:
                        k = k // (BLOCK * BLOCK) * BLOCK * BLOCK - 1
                    elif least[0][k // BLOCK] >= seq:
                        k = k // BLOCK * BLOCK - 1
                    else:
                        old, source, rel, target = edges[k]
                        if old < seq:
                            looked += 1
                            better = [o["seq"] for o in own if o["source_id"] == source and o["rel_type"] == rel and o["target_id"] is not None and target is not None and o["target_id"] != target]
                            if better and source is not None and rel is not None:
                                seqs += [old, *better]
                                ended += [t] + [None] * len(better)
                                sure += [None] + [True] * len(better)
                        k -= 1
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(ended, pa.int64()), pa.array(sure, pa.bool_())], names=["seq", "ended", "sure"])

    return run


def retract_in_order(edges: DataFrame, corrections: DataFrame, *, minutes: int = 10, latest: int = 5) -> DataFrame:
    """As ``retract``, but one correction after the other: what an earlier one ended is no longer believed when a later one looks.

    corrections: tenant_id, conversation_id, message_id, at.  Corrections of a
    conversation go by time, then by their first edge; edges of the same time
    come before them.  An edge that was ended gives its place among the ``latest`` to
    the next one, and keeps the time of the correction that ended it.

    A conversation is cut wherever nothing happened for ``minutes``, since nothing is
    remembered beyond that; a run of it is read in order as a stream of rows, and
    what is held of it is the edges of the last ``minutes``.
    """
    keys = ["tenant_id", "conversation_id"]
    time = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz")).alias("_t")
    own = edges.join(corrections.select("message_id", "at"), "message_id").groupBy(*keys, "message_id", "at").agg(F.min("seq").alias("seq"), F.collect_list(F.struct("seq", "source_id", "rel_type", "target_id")).alias("own"))
    none = F.lit(None).cast(own.schema["own"].dataType)
    seen = edges.where(F.col("recorded_to").isNull()).select(*keys, time("recorded_from"), F.lit(0).alias("_kind"), "seq", "source_id", "rel_type", "target_id", none.alias("own"))
    text = F.lit(None).cast("string")
    rows = seen.unionByName(own.select(*keys, time("at"), F.lit(1).alias("_kind"), "seq", text.alias("source_id"), text.alias("rel_type"), text.alias("target_id"), "own"))
    order = W.partitionBy(*keys).orderBy("_t", "_kind", "seq")
    gap = F.coalesce(F.col("_t") - F.lag("_t").over(order) > minutes * 60_000_000, F.lit(True))
    rows = rows.withColumn("_new", gap.cast("long")).withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    dealt = rows.drop("_new").repartition(*keys, "_run").sortWithinPartitions(*keys, "_run", "_t", "_kind", "seq")
    changes = checkpointed(dealt.mapInArrow(_folded(minutes * 60_000_000, latest), "seq long, ended long, sure boolean"))
    gone = changes.where(F.col("ended").isNotNull()).select("seq", F.timestamp_add("MICROSECOND", F.col("ended"), F.lit("1970-01-01").cast("timestamp_ntz")).alias("_at"))
    sure = changes.where(F.col("sure")).select("seq", F.lit(True).alias("_sure")).distinct()
    out, hit = edges.join(gone, "seq", "left").join(sure, "seq", "left"), F.col("_at").isNotNull()
    confidence = F.when(hit, F.lit(0.0)).when(F.col("_sure"), F.lit(CORRECTED_CONFIDENCE)).otherwise(F.col("confidence"))
    return out.withColumns({"recorded_to": F.when(hit, F.col("_at")).otherwise(F.col("recorded_to")), "valid_to": F.when(hit, F.col("valid_from")).otherwise(F.col("valid_to")), "confidence": confidence}).drop("_at", "_sure")


def _folded(window: int, latest: int):
    """For mapInArrow over rows in order: (seq, time at which it was ended) and (seq, sure) of what corrections change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, believed = None, deque()
        for b in batches:
            seqs, times, sure = [], [], []
            for r in b.to_pylist():
                key = (r["tenant_id"], r["conversation_id"], r["_run"])
                if key != at:
                    at, believed = key, deque()
                if r["_kind"] == 0:
                    believed.append((r["_t"], r["seq"], r["source_id"], r["rel_type"], r["target_id"]))
                    continue
                while believed and believed[0][0] < r["_t"] - window:
                    believed.popleft()
                looked, wrong = 0, []
                for k in range(len(believed) - 1, -1, -1):
                    _, seq, source, kind, target = believed[k]
                    if seq >= r["seq"]:
                        continue
                    better = [o["seq"] for o in r["own"] if o["source_id"] == source and o["rel_type"] == kind and o["target_id"] != target]
                    if better:
                        wrong.append((k, seq, better))
                    looked += 1
                    if looked == latest:
                        break
                for k, seq, better in wrong:  # from the last to the first, so places stay right
                    del believed[k]
                    seqs += [seq, *better]
                    times += [r["_t"]] + [None] * len(better)
                    sure += [False] + [True] * len(better)
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(times, pa.int64()), pa.array(sure, pa.bool_())], names=["seq", "ended", "sure"])

    return run
