"""Topics of entities by their vectors, with labels that stay from one period to the next, and topics that emerge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import checkpointed

#: Topics of the first period, rounds, vectors that seeds are chosen from, likeness under which a vector belongs to no topic, and how many such make a new one.
TOPICS, ROUNDS, SEED_ROWS, NEAR, LEAST = 8, 12, 512, 0.5, 5


def _matrix(v: pa.ListArray, dim: int) -> np.ndarray:
    x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(vectors: DataFrame, dim: int) -> DataFrame:
    v = vectors.select("id", "period", F.col("embedding").cast("array<double>").alias("v"))
    return v.where(F.col("period").isNotNull() & (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull()) & F.exists("v", lambda x: x != 0))


def _seeds(rows: DataFrame, n: int, dim: int) -> np.ndarray:
    """Up to ``n`` vectors far from each other, of the SEED_ROWS with the least hashes of their ids."""
    place = F.xxhash64(F.lit("topic"), "id")
    found = rows.select("v", place.alias("k")).orderBy("k").limit(SEED_ROWS).toArrow()
    if not found.num_rows:
        return np.zeros((0, dim))
    x = _matrix(found.column("v").combine_chunks(), dim)
    chosen = [0]
    best = x @ x[0]
    while len(chosen) < min(n, len(x)):
        k = int(np.argmin(best))
        if best[k] > 1 - 1e-9:
            break
        chosen.append(k)
        best = np.maximum(best, x @ x[k])
    return x[chosen]


def assign(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """rows (id, period, v) with the nearest topic and the likeness (cosine) to it; ties go to the lower label."""
    dim = centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            like = _matrix(b.column("v"), dim) @ centers.T
            near = like.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int64)), pa.array(like[np.arange(len(near)), near])], names=[*b.schema.names, "topic", "likeness"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, topic long, likeness double")


def refine(rows: DataFrame, centers: np.ndarray, rounds: int = ROUNDS, tolerance: float = 1e-9) -> np.ndarray:
    """Centers moved to the mean direction of their vectors until they rest.  A center without vectors stays.

    A task hands on one sum for each topic and place, so what is shuffled follows the tasks, not the vectors.
    """
    k, dim = centers.shape

    for _ in range(rounds if k else 0):
        at = centers

        def sums(batches: Iterator[pa.RecordBatch], at=at) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, dim))
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column("v"), dim)
                    np.add.at(total, (x @ at.T).argmax(axis=1), x)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * dim, dtype=np.int64)), pa.array(total.ravel())], names=["place", "total"])

        moved = np.zeros(k * dim)
        for r in rows.mapInArrow(sums, "place long, total double").groupBy("place").agg(F.sum("total").alias("total")).collect():  # topics x places
            moved[r["place"]] = r["total"]
        moved = moved.reshape(k, dim)
        length = np.sqrt((moved * moved).sum(axis=1, keepdims=True))
        centers = np.where(length > 0, moved / np.where(length > 0, length, 1.0), at)
        if np.abs(centers - at).max() < tolerance:
            break
    return centers


def topics(vectors: DataFrame, *, n: int = TOPICS, near: float = NEAR, least: int = LEAST, rounds: int = ROUNDS, dim: int | None = None) -> DataFrame:
    """vectors (id, period, embedding) to id, period, topic, likeness, emerged (the period in which the topic came up).

    Periods go in order.  The first one's vectors give up to ``n`` topics; each later one
    starts from the topics so far, so a label keeps its meaning.  Vectors whose
    likeness to every topic is below ``near`` seed new ones, which emerge in that
    period if at least ``least`` vectors are nearest to them and near.  A vector that is near
    to no topic has topic null.  Vectors of another length than ``dim`` (by default the commonest,
    then the least), with nulls, without a period, or of zeros are left out.
    Centers, topics x places, are all that the driver holds; periods are few.
    """
    if dim is None:
        sizes = vectors.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = sizes["n"] if sizes else 1
    rows = _usable(vectors, dim)
    out, centers, born = None, np.zeros((0, dim)), []
    for (period,) in rows.select("period").distinct().orderBy("period").collect():
        own = rows.where(F.col("period") == period)
        if not len(centers):
            centers = refine(own, _seeds(own, n, dim), rounds)
            born = [period] * len(centers)
        else:
            far = assign(own, centers).where(F.col("likeness") < near).select("id", "period", "v")
            fresh = refine(far, _seeds(far, n, dim), rounds)
            if len(fresh):
                held = {r["topic"] for r in assign(far, fresh).where(F.col("likeness") >= near).groupBy("topic").count().where(F.col("count") >= least).collect()}
                fresh = fresh[sorted(held)] if held else fresh[:0]
            centers, born = np.concatenate([centers, fresh]), born + [period] * len(fresh)
            centers = refine(own, centers, rounds)
        since = F.create_map(*[F.lit(x) for k, p in enumerate(born) for x in (k, p)])
        found = assign(own, centers).select("id", "period", F.when(F.col("likeness") >= near, F.col("topic")).alias("topic"), "likeness").withColumn("emerged", F.try_element_at(since, F.col("topic").cast("int")))
        out = found if out is None else out.unionByName(found)
    if out is None:
        kind = dict(vectors.dtypes)
        return vectors.sparkSession.createDataFrame([], f"id {kind['id']}, period {kind['period']}, topic long, likeness double, emerged {kind['period']}")
    return checkpointed(out)
