"""Pruned similarity against all pairs, on clustered, odd and equal vectors."""

import numpy as np
import pytest

from palimpsest.operators import entities as E


def brute(rows, limit, threshold):
    out = {}
    for i, b, x in rows:
        near = []
        for j, c, y in rows:
            if b is None or b != c or i == j or not x or not y or len(x) != len(y) or None in x or None in y or not any(x) or not any(y):
                continue
            x1, y1 = np.array(x), np.array(y)
            s = float(x1 @ y1 / np.sqrt((x1 @ x1) * (y1 @ y1)))
            if s > threshold:
                near.append((-round(s, 9), j))
        out[i] = [j for _, j in sorted(near)[:limit]]
    return {i: n for i, n in out.items() if n}


def clustered(n, clusters, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, dim))
    return [(k, "b", (centers[k % clusters] + rng.normal(size=dim) * 0.05).tolist()) for k in range(n)]


ODD = [(1000, "b", []), (1001, "b", [0.0] * 16), (1002, None, [1.0] * 16), (1003, "b", [1.0, 2.0]), (1004, "b", [1.0, 2.1]), (1005, "b", [1.0, None]), (1006, "c", [3.0] * 16), (1007, "c", [5.0] * 16), (1008, "b", None)]


@pytest.mark.parametrize("threshold", [0.85, 0.3, -0.5])
def test_similar_equals_all_pairs(spark, threshold):
    rows = clustered(300, 12) + ODD
    table = spark.createDataFrame(rows, "id long, block string, embedding array<double>")
    got = {}
    for r in E.similar(table, table, threshold=threshold, pivots=8, pack=16).orderBy("probe_id", "rank").collect():
        got.setdefault(r["probe_id"], []).append(r["match_id"])
    assert got == brute([(i, b, x or []) for i, b, x in rows], 5, threshold)


def test_few_packs_meet(spark):
    """On 2,000 vectors in 40 clusters fewer than a tenth of the pairs of packs are compared."""
    table = spark.createDataFrame(clustered(2000, 40), "id long, block string, embedding array<double>")
    mine, theirs, pairs = E.similar_packs(table, table, threshold=0.85, pack=20)
    every = mine.count() * theirs.count()
    assert every > 5_000 and pairs.count() < every / 10


def test_duplicate_candidates(spark):
    rows = clustered(60, 6)
    table = spark.createDataFrame(rows, "id long, block string, embedding array<double>")
    got = {}
    for r in E.duplicate_candidates(table.where("id < 10"), table).orderBy("probe_id", "rank").collect():
        got.setdefault(r["probe_id"], []).append(r["match_id"])
    assert got == {i: n for i, n in brute(rows, 3, 0.85).items() if i < 10}


def test_candidates_meet_near_packs_only(spark, monkeypatch):
    """In three dimensions many pairs of packs are above the threshold; fewer than half of them meet, and all places are right."""
    rng = np.random.default_rng(5)
    rows = [(k, "b", v) for k, v in enumerate(rng.normal(size=(3000, 3)).round(2).tolist())]
    table = spark.createDataFrame(rows, "id long, block string, embedding array<double>").repartition(4)
    met = spark.sparkContext.accumulator(0)
    best = E._best_of_packs

    def counted(*args):
        met.add(1)
        return best(*args)

    monkeypatch.setattr(E, "_best_of_packs", counted)
    run = E.similar(table, table, limit=3, threshold=0.85, pivots=300, pack=10)
    got = {}
    for r in sorted(run.collect(), key=lambda r: (r["probe_id"], r["rank"])):
        got.setdefault(r["probe_id"], []).append(r["match_id"])
    x = np.array([v for _, _, v in rows])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    for i in range(0, 3000, 10):
        near = sorted((-round(float(c), 9), j) for j, c in enumerate(x @ x[i]) if j != i and c > 0.85)[:3]
        assert got.get(i, []) == [j for _, j in near]
    above = E.similar_packs(table, table, threshold=0.85, pivots=300, pack=10)[2].count()  # all of these met before
    assert 300 <= met.value < above / 2, (met.value, above)
