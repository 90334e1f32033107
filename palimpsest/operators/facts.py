"""Facts and commitments: last write wins, first-in-first-out supersession."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def last_write(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(F.desc("seq")))).where(F.col("_k") == 1).drop("_k")


def supersede(facts: DataFrame, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """facts: keys, seq, fact_key, supersedes_key, valid_from.  Adds supersedes_seq, valid_to, status.

    A fact with a supersedes_key ends the first-inserted active fact of that key,
    if there is one.  As a queue: the j-th pop that finds the queue filled takes
    the j-th push; a running maximum of pops over pushes counts those that don't.
    A push and the pop that takes it have the same key and number, and both rows of
    a fact the same seq, so they see each other in windows: one shuffle by ``keys``
    and no join.
    """
    keys = list(keys)
    fact = F.struct(*[F.col(c) for c in facts.columns])
    push = F.struct(F.col("fact_key").alias("_key"), F.lit(1).alias("_push"), fact.alias("_fact"))
    pop = F.struct(F.col("supersedes_key").alias("_key"), F.lit(0).alias("_push"), F.lit(None).cast(T.StructType(facts.schema.fields)).alias("_fact"))
    ops = facts.select(*keys, "seq", "valid_from", F.inline(F.when(F.col("supersedes_key").isNotNull(), F.array(push, pop)).otherwise(F.array(push)))).repartition(*keys)
    order = W.partitionBy(*keys, "_key").orderBy("seq", "_push")
    w = order.rowsBetween(W.unboundedPreceding, 0)
    ops = ops.withColumn("_pu", F.sum("_push").over(w)).withColumn("_po", F.sum(1 - F.col("_push")).over(w))
    ops = ops.withColumn("_fail", F.greatest(F.lit(0), F.max(F.col("_po") - F.col("_pu")).over(w)))
    ok = F.col("_fail") == F.coalesce(F.lag("_fail").over(order), F.lit(0))
    whole = functools.reduce(lambda x, c: x & F.col(c).isNotNull(), keys, F.col("_key").isNotNull())
    number = F.when(F.col("_push") == 1, F.col("_pu")).when(ok, F.col("_po") - F.col("_fail"))
    ops = ops.withColumn("_j", F.when(whole, number))
    # Without a number a row has no partner; its own seq keeps such rows from being one group.
    pair = W.partitionBy(*keys, "_key", "_j", F.when(F.col("_j").isNull(), F.col("seq")))
    partner = lambda mark, c: F.when(F.col("_j").isNotNull(), F.max(F.when(F.col("_push") == mark, F.col(c))).over(pair))
    ops = ops.withColumn("_end", partner(0, "valid_from")).withColumn("_old", partner(1, "seq"))
    took = F.max(F.when(F.col("_push") == 0, F.col("_old"))).over(W.partitionBy(*keys, "seq"))
    out = ops.withColumn("_took", took).where(F.col("_push") == 1).select("_fact.*", F.col("_end").alias("valid_to"), F.col("_took").alias("supersedes_seq"))
    return out.withColumn("status", F.when(F.col("valid_to").isNull(), "active").otherwise("superseded"))


def facts_of(facts: DataFrame, entity: str | int | None = None, key: str | None = None, active_only: bool = True, tenant: str | None = None, newest_first: bool = False) -> DataFrame:
    for name, value in (("tenant_id", tenant), ("entity_id", entity), ("fact_key", key)):
        facts = facts.where(F.col(name) == value) if value is not None else facts
    facts = facts.where(F.col("status") == "active") if active_only else facts
    return facts.orderBy(F.desc("valid_from"), "seq") if newest_first else facts


def active_commitments(commitments: DataFrame, tenant: str | None = None, entity: str | int | None = None, newest_first: bool = False) -> DataFrame:
    for name, value in (("tenant_id", tenant), ("entity_id", entity)):
        commitments = commitments.where(F.col(name) == value) if value is not None else commitments
    commitments = commitments.where(F.col("status") == "active")
    return commitments.orderBy(F.desc("created_at"), "id") if newest_first else commitments
