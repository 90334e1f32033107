"""As-of reads on half-open intervals, one probe or many at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from .stored import checkpointed


def holds_at(axis: str, at: Column) -> Column:
    start, end = F.col(f"{axis}_from"), F.col(f"{axis}_to")
    return (start <= at) & (end.isNull() | (end > at))


def of_source(edges: DataFrame, entities: DataFrame | None, tenant: str | None, name: str | None) -> DataFrame:
    """Edges whose source has the name (normalised), within the tenant."""
    if tenant is not None:
        edges = edges.where(F.col("tenant_id") == tenant)
    if name is None:
        return edges
    if entities is None:
        return edges.where(S.short_name(F.col("source_id")) == S.normalize_name(F.lit(name)))
    ids = entities.where(F.col("canonical_name") == S.normalize_name(F.lit(name)))
    if tenant is not None:
        ids = ids.where(F.col("tenant_id") == tenant)
    return edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")


def world_state(edges: DataFrame, at: Column, rel_type: str | None = None) -> DataFrame:
    out = edges.where(holds_at("valid", at))
    return out.where(F.col("rel_type") == rel_type) if rel_type else out


def knowledge(edges: DataFrame, at: Column, rel_type: str | None = None) -> DataFrame:
    out = edges.where(holds_at("recorded", at))
    return out.where(F.col("rel_type") == rel_type) if rel_type else out


def bitemporal(edges: DataFrame, at: Column, rel_type: str | None = None) -> DataFrame:
    """Both lists at one time, tagged by timeline, in one pass over the edges."""
    tag = lambda axis, name: F.when(holds_at(axis, at), F.lit(name))
    out = edges.where(holds_at("valid", at) | holds_at("recorded", at))
    out = out.where(F.col("rel_type") == rel_type) if rel_type else out
    return out.withColumn("timeline", F.explode(F.array_compact(F.array(tag("valid", "world_state"), tag("recorded", "knowledge")))))


def intersection(edges: DataFrame, valid_at: Column, known_at: Column) -> DataFrame:
    """What held at one time, as it was known at another."""
    return edges.where(holds_at("valid", valid_at) & holds_at("recorded", known_at))


def point_in_time(edges: DataFrame, at: Column, mode: str = "world_state", rel_type: str | None = None) -> DataFrame:
    return {"knowledge": knowledge, "bitemporal": bitemporal}.get(mode, world_state)(edges, at, rel_type)


def evolution(edges: DataFrame, rel_type: str | None = None, target_name: str | None = None) -> DataFrame:
    """All versions, with the predecessor's id and the status."""
    if rel_type:
        edges = edges.where(F.col("rel_type") == rel_type)
    if target_name:
        edges = edges.where(S.short_name(F.col("target_id")) == S.normalize_name(F.lit(target_name)))
    w = W.partitionBy("tenant_id", "group_id", "source_id", "rel_type").orderBy("valid_from", "seq")
    return edges.withColumn("status", F.when(F.col("valid_to").isNull(), "active").otherwise("superseded")).withColumn("predecessor", F.lag("seq").over(w))


def as_of_join(probes: DataFrame, edges: DataFrame, *, axis: str = "valid", at: str = "at", on: list[str] | None = None, how: str = "inner", unit: str = "MONTH") -> DataFrame:
    """Every probe with the edges that hold at its time.

    With keys, an equi-join with a residual range.  Without, time is cut into
    units and the units into a binary tree.  An interval is spread over the few
    tree nodes that make it up (no more than two a level, however long it is or
    if it is open), a probe over the nodes above its unit, and the two meet by
    equality in exactly one node.
    """
    start, end = F.col(f"{axis}_from"), F.col(f"{axis}_to")
    inside = (start <= F.col(at)) & (end.isNull() | (end > F.col(at)))
    if on:
        return probes.join(edges, [probes[c] == edges[c] for c in on] + [inside], how) if how in ("left_semi", "left_anti") else probes.join(edges, on, "inner").where(inside)
    if how != "inner":
        raise ValueError("without keys only inner joins are offered")
    last, first = probes.agg(F.max(at)).first()[0], edges.agg(F.min(start)).first()[0]
    if last is None or first is None or first > last:
        return probes.join(edges, F.lit(False))
    number = lambda c: F.timestamp_diff(unit, F.date_trunc(unit, F.lit(first)), F.date_trunc(unit, c))
    levels = max(1, probes.sparkSession.range(1).select(number(F.lit(last))).first()[0].bit_length())
    spread = edges.where((start <= F.lit(last)) & (end.isNull() | (start < end))).withColumn("_node", F.explode(_tree_nodes(number(start), number(F.least(F.coalesce(end, F.lit(last)), F.lit(last))), levels)))
    asked = probes.where(F.col(at) >= F.lit(first)).withColumn("_node", F.explode(_nodes_above(number(F.col(at)), levels)))
    return asked.join(spread, "_node").where(inside).drop("_node")


#: A time unit is 2 ** UNIT_BITS microseconds (67 s); units run from FIRST_INSTANT for 2 ** TREE_LEVELS units, some 9,000 years.
UNIT_BITS, TREE_LEVELS, FIRST_INSTANT = 26, 32, -(1 << 57)
#: Interval ends of a unit up to which probes are compared with them one by one.
UNIT_ROWS = 256


def as_of_aggregate(probes: DataFrame, edges: DataFrame, aggregates: dict[str, tuple[str, Column]], *, axis: str = "valid", at: str = "at", unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Per instant of the probes (``at``, each once): aggregates over the edges that hold then, without pairs.

    aggregates: name to (sum, min or max; a column of the edges); a count is the
    sum of 1.  Instants at which nothing holds have no row, null instants neither.

    An interval covers whole time units, which are the nodes of a binary tree,
    and parts of two units at its ends.  Aggregates are kept per node, so all
    probes of a unit share one sum over the nodes above it; only the parts are
    compared with the instants of their unit.  In a unit with more than ``unit_rows``
    parts these are cut into nodes of a tree of its microseconds instead, so
    rows grow with the edges and the instants, however close together they lie.
    """
    names = list(aggregates)
    kinds = {"sum": F.sum, "min": F.min, "max": F.max}
    merged = [kinds[kind](F.col(n)).alias(n) for n, (kind, _) in aggregates.items()]
    zero = F.lit("1970-01-01").cast(edges.schema[f"{axis}_from"].dataType)
    micros = lambda c: F.timestamp_diff("MICROSECOND", zero, c) - F.lit(FIRST_INSTANT)
    never, unit = 1 << (UNIT_BITS + TREE_LEVELS), lambda c: F.shiftright(c, UNIT_BITS)
    start, end = F.col(f"{axis}_from"), F.col(f"{axis}_to")
    spans = edges.where(start.isNotNull() & (end.isNull() | (start < end))).select(micros(start).alias("_s"), F.least(F.coalesce(micros(end), F.lit(never)), F.lit(never)).alias("_e"), *[c.alias(n) for n, (_, c) in aggregates.items()])
    spans = checkpointed(spans.withColumns({"_u": unit(F.col("_s")), "_v": unit(F.col("_e") - 1)}))  # read four times below
    open_, first, last = F.col("_e") == never, F.shiftleft(F.col("_u") + 1, UNIT_BITS), F.shiftleft("_v", UNIT_BITS)
    inner = F.explode(_tree_nodes(F.col("_u") + 1, F.when(open_, F.col("_v")).otherwise(F.col("_v") - 1), TREE_LEVELS))
    kept = spans.select(inner.alias("_node"), *names).groupBy("_node").agg(*merged)
    part = lambda u, lo, hi: F.struct(u.alias("_unit"), lo.alias("_lo"), hi.alias("_hi"))
    left, right = part(F.col("_u"), F.col("_s"), F.least(first, "_e")), part(F.col("_v"), last, F.col("_e"))
    parts = spans.select(F.inline(F.when(open_ | (F.col("_u") == F.col("_v")), F.array(left)).otherwise(F.array(left, right))), *names)

    instants = probes.where(F.col(at).isNotNull()).select(at).distinct().withColumn("_p", micros(F.col(at))).withColumn("_unit", unit(F.col("_p")))
    above = lambda c, levels: F.explode(_nodes_above(c, levels))
    by_unit = instants.select("_unit").distinct().select("_unit", above(F.col("_unit"), TREE_LEVELS).alias("_node")).join(kept, "_node").groupBy("_unit").agg(*merged)
    whole = instants.join(by_unit, "_unit").select(at, *names)

    crowded = parts.groupBy("_unit").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > unit_rows).select("_unit")
    few = parts.join(crowded, "_unit", "left_anti")
    near = instants.join(few, "_unit").where((F.col("_lo") <= F.col("_p")) & (F.col("_p") < F.col("_hi"))).select(at, *names)
    offset = lambda c: c - F.shiftleft("_unit", UNIT_BITS)
    fine = parts.join(crowded, "_unit", "left_semi").select("_unit", F.explode(_tree_nodes(offset(F.col("_lo")), offset(F.col("_hi")) - 1, UNIT_BITS)).alias("_node"), *names).groupBy("_unit", "_node").agg(*merged)
    dense = instants.join(crowded, "_unit", "left_semi").select(at, "_unit", above(offset(F.col("_p")), UNIT_BITS).alias("_node")).join(fine, ["_unit", "_node"]).select(at, *names)
    return whole.unionByName(near).unionByName(dense).groupBy(at).agg(*merged)


def diff(edges: DataFrame, before: tuple[Column, Column], after: tuple[Column, Column]) -> DataFrame:
    """What changed between two states, each (true at, known at): one row for each triple that was added, ended, changed or re-believed.

    was_seq and now_seq name the edge of each state (the highest version, then
    seq, if several hold).  Re-believed: the same version and start of truth, held
    by another edge.  Changed: any other exchange.  Triples with the same edge in
    both states have no row.  One pass over the edges of either state and one
    shuffle on the triple; rows that hold in neither are left out by the scan.
    """
    state = lambda when: holds_at("valid", when[0]) & holds_at("recorded", when[1])
    row = F.struct("version", "seq", "confidence", "valid_from")
    triple = ["tenant_id", "group_id", "source_id", "rel_type", "target_id"]
    rows = edges.where(state(before) | state(after)).groupBy(*triple).agg(F.max(F.when(state(before), row)).alias("was"), F.max(F.when(state(after), row)).alias("now"))
    again = (F.col("was.version") == F.col("now.version")) & (F.col("was.valid_from") == F.col("now.valid_from"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "ended").when(again, "re-believed").otherwise("changed")
    rows = rows.where(~F.col("was.seq").eqNullSafe(F.col("now.seq"))).withColumn("change", change)
    return rows.select(*triple, "change", F.col("was.seq").alias("was_seq"), F.col("now.seq").alias("now_seq"), F.col("was.confidence").alias("was_confidence"), F.col("now.confidence").alias("now_confidence"))


def _shifted(value: Column, by: Column | int) -> Column:
    return F.call_function("shiftright", value, by if isinstance(by, Column) else F.lit(by))


def _node(level: Column | int, place: Column) -> Column:
    return place * 64 + level


def _nodes_above(place: Column, levels: int) -> Column:
    """The nodes, one a level, that hold a unit."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: _node(k, _shifted(place, k)))


def _tree_nodes(low: Column, high: Column, levels: int) -> Column:
    """The nodes that make up the units from low to high (both inside): at most two a level, an odd left one and an even right one."""

    def of_level(k: Column) -> Column:
        left, right = _shifted(low + (F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1), k), _shifted(high + 1, k) - 1
        odd = F.when((left <= right) & (left % 2 == 1), _node(k, left))
        return F.array(odd, F.when((left <= right) & (right % 2 == 0), _node(k, right)))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of_level)))
