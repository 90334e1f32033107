"""A small facade over the tables of one graph."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import entities as E
from .operators import relationships as R
from .operators import temporal as T


#: Modes of a read at a point in time.
MODES = ("world_state", "knowledge", "bitemporal")


def instant(text: str) -> dt.datetime:
    """An ISO time, with Z or an offset, in UTC without a zone."""
    try:
        at = dt.datetime.fromisoformat(text)
    except (TypeError, ValueError):
        raise ValueError(f"no ISO time: {text!r}") from None
    return at if at.tzinfo is None else at.astimezone(dt.timezone.utc).replace(tzinfo=None)


def one_of(kind: str, value: str | None, known: tuple[str, ...]) -> None:
    if value is not None and value not in known:
        raise ValueError(f"no {kind}: {value}")


@dataclass
class Graph:
    entities: DataFrame
    edges: DataFrame
    facts: DataFrame | None = None

    def as_of(self, tenant: str, name: str | None, at: str, mode: str = "world_state", rel_type: str | None = None) -> DataFrame:
        one_of("relationship type", rel_type, S.RELATIONSHIP_TYPES)
        one_of("mode", mode, MODES)
        when = F.lit(instant(at)).cast("timestamp_ntz")
        return T.point_in_time(T.of_source(self.edges, self.entities, tenant, name), when, mode, rel_type).orderBy(F.desc("confidence"), "seq")

    def as_of_batch(self, probes: DataFrame, **options) -> DataFrame:
        return T.as_of_join(probes, self.edges, **options)

    def changes(self, before: str, after: str) -> DataFrame:
        """What changed between two times, each as it was known then."""
        a, b = (F.lit(instant(x)).cast("timestamp_ntz") for x in (before, after))
        return T.diff(self.edges, (a, a), (b, b))

    def evolution(self, tenant: str, name: str, rel_type: str | None = None, **options) -> DataFrame:
        one_of("relationship type", rel_type, S.RELATIONSHIP_TYPES)
        options |= {"rel_type": rel_type}
        return T.evolution(T.of_source(self.edges, self.entities, tenant, name), **options).orderBy("valid_from", "seq")

    def active(self, **options) -> DataFrame:
        return R.active(self.edges, **options)

    def search(self, tenant: str, query: str, limit: int = 20) -> DataFrame:
        return E.search(self.entities, tenant, query, limit)
