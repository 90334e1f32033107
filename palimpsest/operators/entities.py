"""Entities: upsert, lists, search, merge, mentions, similarity."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from .stored import checkpointed


def upsert(rows: DataFrame) -> DataFrame:
    """Arrivals (id, seq, ...) to one row per id: the first keeps its columns, aliases unite in order, the last arrival's mention counts."""
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda r: r[c]))
    keep = ["tenant_id", "group_id", "conversation_id", "entity_type", "canonical_name", "created_at"]
    return rows.groupBy("id").agg(
        *[F.min_by(c, "seq").alias(c) for c in keep if c in rows.columns], F.max_by("last_mentioned", "seq").alias("last_mentioned"),
        F.array_distinct(ordered("aliases")).alias("aliases"), ordered("source_messages").alias("source_messages"),
    )


def listing(entities: DataFrame, tenant: str, conversation: str | None = None, entity_type: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1..1000 and offset not negative")
    if entity_type is not None and entity_type not in S.ENTITY_TYPES:
        raise ValueError(f"no entity type: {entity_type}")
    out = entities.where(F.col("tenant_id") == tenant)
    out = out.where(F.col("conversation_id") == conversation) if conversation else out
    out = out.where(F.col("entity_type") == entity_type) if entity_type else out
    return out.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def by_id(entities: DataFrame, ident: str) -> DataFrame:
    return entities.where(F.col("id") == ident)


def by_name(entities: DataFrame, tenant: str, conversation: str, canonical: str) -> DataFrame:
    return entities.where((F.col("tenant_id") == tenant) & (F.col("conversation_id") == conversation) & (F.col("canonical_name") == canonical)).orderBy("created_at", "id").limit(1)


def recent(entities: DataFrame, tenant: str, since: Column, conversation: str | None = None, limit: int = 20) -> DataFrame:
    out = entities.where((F.col("tenant_id") == tenant) & (F.col("last_mentioned") >= since))
    out = out.where(F.col("conversation_id") == conversation) if conversation else out
    return out.orderBy(F.desc("last_mentioned"), "id").limit(limit)


def search(entities: DataFrame, tenant: str, query: str, limit: int = 20, pool: int = 1000) -> DataFrame:
    """Substring of the name or an alias, in the tenant's first ``pool`` entities (a feature of the search route)."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1..100")
    q = F.lit(query.lower())
    first = entities.where(F.col("tenant_id") == tenant).orderBy(F.desc("created_at"), "id").limit(pool)
    return first.where(F.contains(F.lower("canonical_name"), q) | F.exists("aliases", lambda a: F.contains(F.lower(a), q))).orderBy(F.desc("created_at"), "id").limit(limit)


def merge(entities: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (dup, primary), chains resolved before.  Entities with aliases and messages taken over and ``merged_into``; edges redirected."""
    known = pairs.join(entities.select(F.col("id").alias("dup")), "dup", "left_semi").join(entities.select(F.col("id").alias("primary")), "primary", "left_semi").where(F.col("dup") != F.col("primary"))
    given = known.join(entities, known["dup"] == entities["id"]).groupBy(F.col("primary").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("dup", F.concat("aliases", F.array("canonical_name")).alias("a"), F.col("source_messages").alias("m")))).alias("_g")
    )
    out = entities.join(given, "id", "left").join(known.select(F.col("dup").alias("id"), F.col("primary").alias("merged_into")), "id", "left")
    for c, got in (("aliases", F.flatten(F.transform("_g", lambda r: r["a"]))), ("source_messages", F.flatten(F.transform("_g", lambda r: r["m"])))):
        out = out.withColumn(c, F.when(F.col("_g").isNull(), F.col(c)).otherwise(F.concat(F.col(c), F.array_except(got, F.col(c)))))
    s, t = known.select(F.col("dup").alias("source_id"), F.col("primary").alias("_s")), known.select(F.col("dup").alias("target_id"), F.col("primary").alias("_t"))
    moved = edges.join(s, "source_id", "left").join(t, "target_id", "left")
    moved = moved.withColumn("redirected", F.col("_s").isNotNull() | F.col("_t").isNotNull()).withColumn("source_id", F.coalesce("_s", "source_id")).withColumn("target_id", F.coalesce("_t", "target_id")).drop("_s", "_t")
    return out.drop("_g"), moved


def resolve_chains(pairs: DataFrame, rounds: int = 20) -> DataFrame:
    """(dup, primary) with primaries that are duplicates themselves followed to their end."""
    now = pairs.select("dup", "primary")
    for _ in range(rounds):
        nxt = now.alias("a").join(now.alias("b"), F.col("a.primary") == F.col("b.dup"), "left").select(F.col("a.dup").alias("dup"), F.coalesce("b.primary", "a.primary").alias("primary"), F.col("b.dup").isNotNull().alias("_more"))
        nxt = checkpointed(nxt)
        now = nxt.select("dup", "primary")
        if nxt.where("_more").isEmpty():
            return now
    raise ValueError("merge pairs form a cycle")


def resolve_mentions(mentions: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """mentions (keys, mention_id, mention) to the id of the first entity of the pool whose name, else alias, normalises to the same.

    pool: keys, id, canonical_name, aliases, pos (pool order).  Unmatched mentions drop.
    """
    names = pool.select(*keys, "id", "pos", F.lit(1).alias("_pass"), F.lit(0).alias("_alias"), S.normalize_name(F.col("canonical_name")).alias("_norm"))
    aliases = pool.select(*keys, "id", "pos", F.posexplode("aliases").alias("_alias", "_a")).select(*keys, "id", "pos", F.lit(2).alias("_pass"), "_alias", S.normalize_name(F.col("_a")).alias("_norm"))
    # One answer for each normal form, so a name that very many entities share costs a mention one row.
    best = names.unionByName(aliases).groupBy(*keys, "_norm").agg(F.min(F.struct("_pass", "pos", "_alias", "id")).alias("_m"))
    found = mentions.withColumn("_norm", S.normalize_name(F.col("mention"))).join(best, [*keys, "_norm"])
    return found.select(*keys, "mention_id", "mention", F.col("_m.id").alias("entity_id")).distinct()


#: Vectors of a pack: two packs are compared by one matrix product.  Pivots are vectors that all packs are measured from, for each length of vectors: one for so many rows, within bounds.
PACK, PIVOTS, PIVOT_ROWS, MOST_PIVOTS = 512, 64, 1000, 1024
#: Added to a bound, for rounding of angles, and what scores lose by rounding.
ANGLE_ERROR, SCORE_ERROR = 1e-6, 1e-9


def similar(probes: DataFrame, pool: DataFrame, *, limit: int = 5, threshold: float = 0.85, exclude_self: bool = True, pivots: int | None = None, pack: int = PACK) -> DataFrame:
    """probes and pool: id, block, embedding.  Pool rows of the probe's block with a cosine above the threshold, best first.

    Exact.  Vectors are packed by block and nearest pivot, and each pack knows the
    least and greatest angle of its vectors to every pivot.  By the triangle inequality on the
    sphere two packs hold no pair above a score if for some pivot these ranges
    lie further apart than the score's angle.  Each pack first meets the one that lies
    nearest (itself, where the pool is the probes).  The least of the last places that its
    probes then have is what other packs must reach, so packs don't meet all
    that are above the threshold; of those that meet a task holds two, and a probe hands on
    no more than ``limit`` rows of each.  Empty and zero vectors, those with nulls,
    and those of another length than the probe's are like nothing.
    """
    mine, theirs, pairs = similar_packs(probes, pool, threshold=threshold, pivots=pivots, pack=pack)
    kinds = [frame.schema["id"].dataType.simpleString() for frame in (probes, pool)]
    own = ["block", "dim", "apivot", "apart"]
    pair = [*own, "bpivot", "bpart"]
    pairs = checkpointed(pairs)
    nearest = pairs.groupBy(*own).agg(F.min(F.struct("far", "bpivot", "bpart")).alias("m")).select(*own, "m.bpivot", "m.bpart")
    side = lambda packs, mark: packs.select("block", "dim", F.col("pivot").alias(f"{mark}pivot"), F.col("part").alias(f"{mark}part"), F.col("ids").alias(f"{mark}ids"), F.col("flat").alias(f"{mark}flat"))
    block = mine.schema["block"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids = [b.column(c)[k].values for c in ("aids", "bids")]
                dim = b.column("dim")[k].as_py()
                x, y = (_unit(b.column(c)[k].values, dim) for c in ("aflat", "bflat"))
                best, floor = _best_of_packs(*ids, x, y, limit, threshold, exclude_self)
                n = best.num_rows
                at = pa.array(np.full(n, k, np.int64))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in own), *best.columns, pa.array(np.full(n, floor))], names=[*own, *best.schema.names, "floor"])

    def scored(some: DataFrame) -> DataFrame:
        joined = some.select(*pair).join(side(mine, "a"), own).join(side(theirs, "b"), ["block", "dim", "bpivot", "bpart"])
        return joined.select(*own, "aids", "aflat", "bids", "bflat").mapInArrow(run, f"block {block}, dim int, apivot int, apart int, probe_id {kinds[0]}, match_id {kinds[1]}, score double, floor double")

    first = checkpointed(scored(nearest))
    floors = first.groupBy(*own).agg(F.min("floor").alias("floor"))
    reach = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("floor", F.lit(threshold)) - SCORE_ERROR))) + ANGLE_ERROR
    others = pairs.join(nearest, pair, "left_anti").join(floors, own, "left").where(F.col("gap") <= reach)
    found = first.unionByName(scored(others)).select("probe_id", "match_id", "score")
    rank = F.row_number().over(W.partitionBy("probe_id").orderBy(F.desc("score"), "match_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select("probe_id", "match_id", "score", F.col("rank").cast("long").alias("rank"))


def similar_packs(probes: DataFrame, pool: DataFrame, *, threshold: float, pivots: int | None = None, pack: int = PACK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The packs of the probes and of the pool, and the pairs of packs that may hold a pair above the threshold, with the least angle between them and how far they lie from each other on the whole."""
    chosen = _pivots(pool, pivots or min(MOST_PIVOTS, max(PIVOTS, _vectors(pool).count() // PIVOT_ROWS)))
    theirs = _packs(pool, chosen, pack)
    mine = theirs if probes is pool else _packs(probes, chosen, pack)
    angle = float(np.arccos(min(1.0, max(-1.0, threshold)))) + ANGLE_ERROR
    side = lambda packs, mark: packs.select("block", "dim", *[F.col(c).alias(f"{mark}{c}") for c in ("pivot", "part", "low", "high")])
    both = side(mine, "a").join(side(theirs, "b"), ["block", "dim"])
    ranges = F.arrays_zip("alow", "ahigh", "blow", "bhigh")
    reach = F.forall(ranges, lambda r: (r["alow"] - r["bhigh"] <= angle) & (r["blow"] - r["ahigh"] <= angle))
    gap = F.coalesce(F.array_max(F.transform(ranges, lambda r: F.greatest(r["alow"] - r["bhigh"], r["blow"] - r["ahigh"]))), F.lit(0.0))
    far = F.aggregate(ranges, F.lit(0.0), lambda acc, r: acc + F.abs(r["alow"] - r["blow"]) + F.abs(r["ahigh"] - r["bhigh"]))
    return mine, theirs, both.where(reach).select("block", "dim", "apivot", "apart", "bpivot", "bpart", gap.alias("gap"), far.alias("far"))


def _vectors(rows: DataFrame) -> DataFrame:
    v = rows.where((F.size("embedding") > 0) & F.col("block").isNotNull()).select("id", "block", F.col("embedding").cast("array<double>").alias("v"))
    return v.where(F.forall("v", lambda x: x.isNotNull()) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _pivots(pool: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Up to ``n`` vectors of each length, those of the least hashes; no more than n rows of a length come to the driver."""
    place = F.xxhash64(F.lit("pivot"), "id")
    best = _vectors(pool).groupBy("dim", F.pmod(place, F.lit(n)).alias("k")).agg(F.min_by("v", place).alias("v"))
    found: dict[int, list] = {}
    for r in best.orderBy("dim", "k").collect():
        found.setdefault(r["dim"], []).append(r["v"])
    units = {dim: _unit(pa.array(np.concatenate(vs)), dim) for dim, vs in found.items()}
    return {dim: x[_neighbours(x)] for dim, x in units.items()}


def _neighbours(x: np.ndarray) -> np.ndarray:
    """An order with near vectors near each other: halves along the line of two far ones, and so on in each half."""
    if len(x) <= 2:
        return np.arange(len(x))
    a = x[np.argmin(x @ x.mean(axis=0))]
    b = x[np.argmin(x @ a)]
    order = np.argsort(x @ (b - a), kind="stable")
    return np.concatenate([half[_neighbours(x[half])] for half in np.array_split(order, 2)])


def _unit(flat: pa.Array, dim: int) -> np.ndarray:
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packs(rows: DataFrame, pivots: dict[int, np.ndarray], pack: int) -> DataFrame:
    """A row per pack: block, dim, pivot, part, ids, their vectors one after the other, least and greatest angle to each pivot."""
    vectors = _vectors(rows)
    kind, block = vectors.schema["id"].dataType.simpleString(), vectors.schema["block"].dataType.simpleString()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, v = b.column("dim").to_numpy(), b.column("v")
            ends, flat, near = v.offsets.to_numpy(), v.values, np.zeros(b.num_rows, np.int32)
            for dim in set(dims.tolist()) & pivots.keys():
                own = np.flatnonzero(dims == dim)
                x = np.stack([flat[ends[i] : ends[i] + dim].to_numpy() for i in own])
                near[own] = np.argmax(_unit(pa.array(x.ravel()), dim) @ pivots[dim].T, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near)], names=[*b.schema.names, "pivot"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, high = [], []
            for dim, flat in zip(b.column("dim").to_pylist(), b.column("flat")):
                angles = np.arccos(np.clip(_unit(flat.values, dim) @ pivots[dim].T, -1, 1)) if dim in pivots else np.zeros((1, 0))
                low.append(angles.min(axis=0))
                high.append(angles.max(axis=0))
            lists = [pa.array([x.tolist() for x in side], pa.list_(pa.float64())) for side in (low, high)]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], names=[*b.schema.names, "low", "high"])

    placed = vectors.mapInArrow(nearest, f"id {kind}, block {block}, v array<double>, dim int, pivot int")  # twice: to count and to pack; cheap next to the products
    group = ["block", "dim", "pivot"]
    # Pivots with few vectors share a pack with those next in order; those with many are cut by hash.
    sizes = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("block", "dim").orderBy("pivot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*group, F.floor(before / pack).cast("int").alias("run"), F.ceil(F.col("n") / pack).alias("parts"))
    named = placed.join(sizes, group).withColumn("pivot", F.col("run"))
    packed = named.groupBy(*group, F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part")).agg(F.collect_list(F.struct("id", "v")).alias("m"))
    flat = packed.select(*group, "part", F.transform("m", lambda r: r["id"]).alias("ids"), F.flatten(F.transform("m", lambda r: r["v"])).alias("flat"))
    return checkpointed(flat.mapInArrow(measured, f"block {block}, dim int, pivot int, part int, ids array<{kind}>, flat array<double>, low array<double>, high array<double>"))


def _best_of_packs(left: pa.Array, right: pa.Array, x: np.ndarray, y: np.ndarray, limit: int, threshold: float, exclude_self: bool) -> tuple[pa.RecordBatch, float]:
    """The best ``limit`` rows of the right pack for each of the left one, and the score that all of the left one have at least in their last place (the threshold, if places are free)."""
    cosine, mine, theirs = x @ y.T, left.to_pylist(), right.to_pylist()
    if exclude_self:
        place: dict = {}
        for j, ident in enumerate(theirs):
            place.setdefault(ident, []).append(j)
        for i, ident in enumerate(mine):
            if ident in place:
                cosine[i, place[ident]] = -np.inf
    k = min(limit, len(theirs))
    last = np.partition(cosine, -k, axis=1)[:, -k]
    row, col = np.nonzero((cosine > threshold) & (cosine >= last[:, None] - 2 * SCORE_ERROR))  # the best, and what may round to as much
    got, full, lowest = [], 0, np.inf
    for js, i in zip(np.split(col, np.flatnonzero(np.diff(row)) + 1), np.unique(row)):
        near = sorted((-round(float(cosine[i, j]), 9), theirs[j]) for j in js)[:limit]
        got += [(mine[i], m, -s) for s, m in near]
        if len(near) == limit:
            full, lowest = full + 1, min(lowest, -near[-1][0])
    cols = list(zip(*got)) if got else [(), (), ()]
    best = pa.RecordBatch.from_arrays([pa.array(list(cols[0]), left.type), pa.array(list(cols[1]), right.type), pa.array(list(cols[2]), pa.float64())], names=["probe_id", "match_id", "score"])
    return best, float(lowest) if full == len(mine) else threshold


def duplicate_candidates(new: DataFrame, pool: DataFrame) -> DataFrame:
    """For review, not merged: up to three other entities of the same type above 0.85 for each new one.  Columns as in ``similar``, with block the entity type."""
    return similar(new, pool, limit=3, threshold=0.85)


def resolve_entity(entities: DataFrame, tenant: str, query: str, conversation: str | None = None) -> DataFrame:
    """The first entity that a search finds (within a conversation, if given); none is an error, several are worth a warning."""
    found = search(entities, tenant, query)
    found = found.where(F.col("conversation_id") == conversation) if conversation is not None else found
    ids = [r["id"] for r in found.orderBy(F.desc("created_at"), "id").select("id").limit(2).collect()]
    if not ids:
        raise LookupError(f"no entity matches {query!r} (tenant {tenant}, conversation {conversation})")
    if len(ids) > 1:
        logging.getLogger(__name__).warning("several entities match %r, the first is taken", query)
    return by_id(entities, ids[0])


def check_merge(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (dup, primary) that can't be merged, with the reason: the same entity, or one that isn't there."""
    ids = entities.select("id").distinct()
    known = pairs.join(ids.withColumnsRenamed({"id": "dup"}).withColumn("_d", F.lit(True)), "dup", "left").join(ids.withColumnsRenamed({"id": "primary"}).withColumn("_p", F.lit(True)), "primary", "left")
    why = F.when(F.col("dup") == F.col("primary"), "cannot merge an entity with itself").when(F.col("_p").isNull(), "primary entity not found").when(F.col("_d").isNull(), "duplicate entity not found")
    return known.withColumn("error", why).where(F.col("error").isNotNull()).select("dup", "primary", "error")
