"""Rows as the routes of a service give them: chosen columns, times as ISO strings in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of each view.
ENTITY_LIST = ("id", "tenant_id", "conversation_id", "entity_type", "canonical_name", "aliases", "created_at", "last_mentioned")
ENTITY_DETAIL = (*ENTITY_LIST, "source_messages", "metadata")
EDGE = ("source_id", "target_id", "rel_type", "confidence", "evidence", "valid_from", "valid_to", "recorded_from", "recorded_to", "version", "structured_evidence")
EVOLUTION = (*EDGE[:-1], "supersedes")
COMMITMENT = ("id", "entity_id", "text", "status", "created_at", "target_date", "confidence")


def iso(at: Column) -> Column:
    """Six digits of a second's fraction if there is one; null stays null."""
    whole, micros = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(at, ".SSSSSS")
    return F.concat(whole, F.when(micros == ".000000", "").otherwise(micros), F.lit("+00:00"))


def view(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns of a view; those that rows lack are null."""
    kinds = dict(rows.dtypes)
    pick = lambda c: F.lit(None).cast("string") if c not in kinds else iso(F.col(c)) if kinds[c].startswith("timestamp") else F.col(c)
    return rows.select(*[pick(c).alias(c) for c in columns])
