"""Topics keep their labels, new ones emerge, strays have none."""

import numpy as np

from palimpsest.operators import topics as TP

SCHEMA = "id long, period long, embedding array<double>"


def cloud(center, n, first, period, rng, spread=0.05):
    return [(first + k, period, (center + rng.normal(size=len(center)) * spread).tolist()) for k in range(n)]


def test_topics_over_periods(spark):
    rng = np.random.default_rng(3)
    a, b, c, stray = np.eye(8)[:4] * 3
    rows = cloud(a, 60, 0, 1, rng) + cloud(b, 40, 100, 1, rng)
    rows += cloud(a, 20, 1000, 2, rng) + cloud(c, 200, 1100, 2, rng) + cloud(stray, 2, 1900, 2, rng)  # c emerges, b is silent
    rows += cloud(b, 30, 2000, 3, rng) + cloud(c, 30, 2100, 3, rng)
    rows += [(3000, 1, None), (3001, 1, [0.0] * 8), (3002, 1, [1.0]), (3003, None, [1.0] * 8), (3004, 2, [None] * 8)]
    got = {r["id"]: r for r in TP.topics(spark.createDataFrame(rows, SCHEMA).repartition(5), n=2).collect()}
    label = lambda lo, hi: {got[i]["topic"] for i in got if lo <= i < hi}
    assert len(got) == len(rows) - 5
    assert len(label(0, 100)) == 1 and label(0, 100) == label(1000, 1100) and label(100, 200) == label(2000, 2100) and label(1100, 1900) == label(2100, 2200)
    assert len({*label(0, 100), *label(100, 200), *label(1100, 1900)}) == 3 and label(1900, 2000) == {None}
    assert {got[i]["emerged"] for i in (0, 100, 2000)} == {1} and {got[i]["emerged"] for i in (1100, 2100)} == {2}
    centers = {t: np.mean([np.array(v) / np.linalg.norm(v) for i, p, v in rows if p == 3 and i in got and got[i]["topic"] == t], axis=0) for t in label(2000, 2200)}
    for i, p, v in rows:
        if p == 3:
            m = centers[got[i]["topic"]]
            assert abs(got[i]["likeness"] - np.dot(v, m) / np.linalg.norm(v) / np.linalg.norm(m)) < 1e-9


def test_topics_of_nothing(spark):
    assert TP.topics(spark.createDataFrame([], SCHEMA)).collect() == []
    same = spark.createDataFrame([(k, 1, [1.0, 2.0]) for k in range(9)], SCHEMA)
    assert {r["topic"] for r in TP.topics(same).collect()} == {0}
