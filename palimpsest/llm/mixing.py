"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is dealt into a fixed number of hash blocks.  From the words of
each block (one aggregate, sources x blocks rows) the driver settles exact block
quotas, and a binary tree over the output shards splits the quota vector with
multivariate hypergeometric draws, so each shard holds an exact part of every
source and the parts are disjoint.  Documents look their draws up in that
bounded table, fall into parts of their shard by a hash and are ordered by it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import WORD, fresh, local_rows, text_or_empty

#: Weights by rank of the source in code point order, repeating.
WEIGHTS = (5, 2, 1)
VOLUME = 1.5
MAX_REPEATS = 2
BLOCKS_PER_SOURCE = 512
SHARDS = 32
#: Words of a part: a shard has as many parts as its words need, each a task's file.
PART_WORDS = 20_000_000
#: Leading bits of the hash by which the words of a block that is taken in part are summed.
EDGE_BITS = 12
SEED = 20_261


def target_words(sizes: list[float], weights: list[float], volume: float = VOLUME, repeats: float = MAX_REPEATS) -> list[float]:
    """Share volume * sum(sizes) by weight; stop at repeats * size and reshare the excess until none is above."""
    left = volume * float(sum(sizes))
    targets, open_ = [0.0] * len(sizes), [i for i in range(len(sizes)) if sizes[i] > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > repeats * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = float(repeats * sizes[i])
        left -= sum(targets[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def split_tree(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """shards x sources block counts; columns sum to the quotas, rows differ by at most a block each split."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def node(lo: int, hi: int, pool: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = pool
            return
        mid = (lo + hi) // 2
        draw = int(pool.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(pool, draw, method="marginals") if draw else np.zeros_like(pool)
        node(lo, mid, left)
        node(mid, hi, pool - left)

    node(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


def _deal(stats: list, weights, volume, repeats, shards, seed):
    """From (source, block, words) to targets, draws by (source, block), and the block that each source takes in part."""
    names = sorted({s for s, _, _ in stats if s is not None}, key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * any(s is None for s, _, _ in stats)
    rank = {s: i for i, s in enumerate(names)}
    blocks: list[dict[int, int]] = [{} for _ in names]
    for s, b, words in stats:
        blocks[rank[s]][b] = int(words)
    sizes = [sum(x.values()) for x in blocks]
    targets = target_words(sizes, [weights[i % len(weights)] for i in range(len(names))], volume, repeats)
    orders, part = [], []
    for i in range(len(names)):
        rng = np.random.default_rng([seed, 7, i])
        ids = sorted(blocks[i])
        full, rest = (int(targets[i] // sizes[i]), targets[i] % sizes[i]) if sizes[i] else (0, 0.0)
        order = [(p, b) for p in range(full) for b in rng.permutation(ids).tolist()]
        cut = None
        for b in rng.permutation(ids).tolist():
            if rest <= 0:
                break
            order.append((full, b))
            if blocks[i][b] > rest:
                cut = (b, full, rest)
                break
            rest -= blocks[i][b]
        orders.append(order)
        part.append(cut)
    draws: dict[tuple, list] = {}
    parts = split_tree([len(x) for x in orders], shards, seed)
    for i, order in enumerate(orders):
        for shard, (a, b) in enumerate(zip(np.cumsum(parts[:, i]) - parts[:, i], np.cumsum(parts[:, i]))):
            for p, block in order[a:b]:
                draws.setdefault((i, block), []).append((p, shard))
    return names, sizes, targets, blocks, draws, part


def draw_plan(
    docs: DataFrame, *, weights=WEIGHTS, volume: float = VOLUME, repeats: int = MAX_REPEATS, blocks: int = BLOCKS_PER_SOURCE,
    shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Each row of docs with size, source_size, target and draws (array of pass, shard).

    A null source is a source of its own, last in order; a null text has size
    0; an empty table gives an empty result.  Rows are dealt by id and text, so
    rows that share an id, or have none, go apart, and rows equal in both alike.  New columns replace docs' columns of the same names.  The number of
    sources times ``blocks`` rows meet on the driver: sources are a catalogue,
    not data, and blocks is a parameter.
    """
    return _planned(docs, weights, volume, repeats, blocks, shards, seed, id_col, text_col, source_col)[0]


def _planned(docs: DataFrame, weights, volume, repeats, blocks, shards, seed, id_col, text_col, source_col) -> tuple[DataFrame, float]:
    """draw_plan's rows, and the words of the mixture."""
    spark = docs.sparkSession
    base = docs.drop("size", "source_size", "target", "draws")
    hash_, block, source, at, drawn = fresh(base.columns, "hash", "block", "source", "at", "drawn")
    base = base.withColumn("size", F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long"))
    base = base.withColumn(hash_, F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))).withColumn(block, F.pmod(hash_, F.lit(blocks)).cast("int"))
    stats = [tuple(r) for r in base.groupBy(source_col, block).agg(F.sum("size")).collect()]
    names, sizes, targets, _, draws, part = _deal(stats, weights, volume, repeats, shards, seed)
    key = F.struct(F.col(hash_).alias("h"), F.col(id_col).alias("id"), F.col("size").alias("size"))
    cuts = _boundary_cuts(base.select(F.col(source_col).alias("source"), F.col(block).alias("block"), key.alias("key")), names, part)
    rank, rows = {s: i for i, s in enumerate(names)}, []
    for s, b, _ in stats:
        i, own = rank[s], []
        for p, shard in draws.get((i, b), []):
            whole = not (part[i] and part[i][:2] == (b, p))
            own.append((p, shard, whole, None if whole else cuts.get(i)))
        rows.append((s, b, sizes[i], float(targets[i]), own))
    cut = T.StructType([T.StructField("h", T.LongType()), T.StructField("id", base.schema[id_col].dataType), T.StructField("size", T.LongType())])
    draw = T.StructType([T.StructField("pass", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("whole", T.BooleanType()), T.StructField("cut", cut)])
    schema = T.StructType([T.StructField(source, T.StringType()), T.StructField(at, T.IntegerType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField(drawn, T.ArrayType(draw))])
    dealt = local_rows(spark, rows, schema)
    taken = F.filter(drawn, lambda d: d["whole"] | (d["cut"].isNotNull() & (key <= d["cut"])))
    out = base.join(F.broadcast(dealt), F.col(source_col).eqNullSafe(F.col(source)) & (F.col(block) == F.col(at)), "left")
    return out.withColumn("draws", F.transform(taken, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard")))).drop(hash_, block, source, at, drawn), float(sum(targets))


def _boundary_cuts(rows: DataFrame, names, part) -> dict[int, tuple | None]:
    """For the one block that a source takes in part: the last key (hash, id, size) whose running sum comes nearest to the rest.

    The words are first summed by the leading bits of the hash; only the rows
    around the rest are put in order, so no task sorts a block.
    """
    spark = rows.sparkSession
    wanted = [(names[i], c[0], i) for i, c in enumerate(part) if c]
    if not wanted:
        return {}
    shift = 64 - EDGE_BITS
    edge = local_rows(spark, wanted, T.StructType.fromDDL("source string, block int, i int")).withColumnsRenamed({"source": "s", "block": "b"})
    rows = rows.join(F.broadcast(edge), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).select("i", "key", F.shiftright("key.h", shift).alias("top"))
    sums: dict[int, list] = {}
    for i, top, words in sorted(tuple(r) for r in rows.groupBy("i", "top").agg(F.sum("key.size")).collect()):  # sources times 2 ** EDGE_BITS at most
        sums.setdefault(i, []).append((top, words))
    around = []
    for i, parts in sums.items():
        before = 0
        for top, words in parts:
            if before + words >= part[i][2] or top == parts[-1][0]:
                around.append((i, top, before, float(part[i][2])))
                break
            before += words
    near = local_rows(spark, around, T.StructType.fromDDL("i int, top long, before long, rest double"))
    rows = rows.join(F.broadcast(near), ["i", "top"])
    run = F.col("before") + F.sum("key.size").over(W.partitionBy("i").orderBy("key"))
    best = rows.withColumn("gap", F.abs(run - F.col("rest"))).groupBy("i").agg(F.min(F.struct("gap", "key")).alias("m")).collect()
    found = {r["i"]: (r["m"]["gap"], tuple(r["m"]["key"])) for r in best}
    cuts = {}
    for i, top, before, rest in around:
        gap, key = found[i]
        # Right before the rows that were put in order lies a cut as well, and the block may be left out.
        cuts[i] = key if gap < rest - before else (top << shift, None, None) if before else None
    return cuts


def mix(docs: DataFrame, *, part_words: int = PART_WORDS, weights=WEIGHTS, volume: float = VOLUME, repeats: int = MAX_REPEATS, blocks: int = BLOCKS_PER_SOURCE,
        shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture: a row per document and pass, with copy, shard, part and position_key, shuffled inside each shard.

    Documents without words and null texts belong to no source's quota of words,
    but go with their block.  Rows equal in id and text go the same way; an empty
    table gives an empty mixture.  size, source_size, target, draws, copy, shard,
    part and position_key replace docs' columns of these names.  A shard's parts
    hold about part_words words, so tasks stay alike however large the input is.
    """
    planned, words = _planned(docs.drop("copy", "shard", "part", "position_key"), weights, volume, repeats, blocks, shards, seed, id_col, text_col, source_col)
    parts = max(1, round(words / shards / part_words))
    (d,) = fresh(planned.columns, "draw")
    rows = planned.withColumn(d, F.explode("draws")).withColumn("copy", F.col(d)["pass"]).withColumn("shard", F.col(d)["shard"]).drop(d, "draws")
    rows = rows.withColumn("position_key", F.xxhash64(F.lit(seed + 1), F.lit(seed), F.col(id_col), F.col(text_col), "copy")).withColumn("part", F.pmod("position_key", F.lit(parts)).cast("int"))
    return rows.repartition(shards * parts, "shard", "part").sortWithinPartitions("shard", "part", "position_key")


def taken_words(docs: DataFrame) -> DataFrame:
    """The contract's query: doc_id, size, source_size, target, taken, and the shards that drew the document (one for each copy).

    Null and empty texts have size and taken 0; a null source is a source of its
    own; rows equal in id and text are taken alike; an empty table gives no rows;
    docs' own columns of the result's names are replaced.
    """
    planned = draw_plan(docs)
    return planned.select("doc_id", "size", "source_size", "target", (F.size("draws") * F.col("size")).cast("long").alias("taken"), F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",").alias("shards"))
