"""As-of aggregates, graph diff, corrections in order, learned decay and importance, against brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import analytics as AN
from palimpsest.operators import relationships as R
from palimpsest.operators import temporal as T

DAY0 = dt.datetime(2024, 1, 1)
EDGE = "seq long, tenant_id string, group_id string, conversation_id string, message_id string, source_id string, target_id string, rel_type string, confidence double, version long, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_from timestamp_ntz, recorded_to timestamp_ntz"


def edge(seq, source="a", target="x", kind="prefers", confidence=0.5, version=1, start=DAY0, end=None, known=None, known_to=None, conversation="c", message=None, tenant="t"):
    return (seq, tenant, "g", conversation, message or f"m{seq}", source, target, kind, confidence, version, start, end, known or start, known_to)


def ntz(t):
    return F.lit(t).cast("timestamp_ntz")


@pytest.mark.parametrize("unit_rows", [256, 3, 0])
@pytest.mark.parametrize("spread", [20, 40_000, 3_000_000_000])
def test_as_of_aggregate(spark, unit_rows, spread):
    """Instants within microseconds, within a unit and over a century, with shared ends, empty and open intervals."""
    rng = random.Random(spread)
    moment = lambda: dt.datetime(1960, 1, 1) + dt.timedelta(seconds=rng.randint(0, spread)) if spread > 20 else DAY0 + dt.timedelta(microseconds=rng.randint(0, spread))
    spans = []
    for k in range(200):
        a, b = moment(), moment()
        spans.append((k, a if k % 50 else None, None if k % 7 == 0 else b, rng.randint(-5, 5)))
    asked = [(moment(),) for _ in range(60)] + [(a,) for _, a, _, _ in spans[1:20]] + [(b,) for _, _, b, _ in spans[1:20]] + [(None,), (DAY0,), (DAY0,)]
    edges = spark.createDataFrame(spans, "seq long, valid_from timestamp_ntz, valid_to timestamp_ntz, x long")
    wanted = {"n": ("sum", F.lit(1)), "low": ("min", F.col("seq")), "high": ("max", F.col("seq")), "total": ("sum", F.col("x"))}
    got = {r["at"]: (r["n"], r["low"], r["high"], r["total"]) for r in T.as_of_aggregate(spark.createDataFrame(asked, "at timestamp_ntz"), edges, wanted, unit_rows=unit_rows).collect()}
    want = {}
    for (t,) in asked:
        hits = [(s, x) for s, a, b, x in spans if t is not None and a is not None and a <= t and (b is None or b > t)]
        if hits:
            want[t] = (len(hits), min(s for s, _ in hits), max(s for s, _ in hits), sum(x for _, x in hits))
    assert got == want and want


def test_as_of_aggregate_of_nothing(spark):
    edges = spark.createDataFrame([], "seq long, valid_from timestamp_ntz, valid_to timestamp_ntz")
    probes = spark.createDataFrame([(DAY0,)], "at timestamp_ntz")
    assert T.as_of_aggregate(probes, edges, {"n": ("sum", F.lit(1))}).collect() == []
    assert T.as_of_aggregate(probes.limit(0), edges, {"n": ("sum", F.lit(1))}).collect() == []


def test_diff(spark):
    d = lambda n: DAY0 + dt.timedelta(days=n)
    rows = [
        edge(1, "same"), edge(2, "ended", end=d(5), known_to=d(5)), edge(3, "new", start=d(5)),
        edge(4, "other", start=d(0), end=d(5), known_to=d(5)), edge(5, "other", start=d(6), version=2, confidence=0.9),
        edge(6, "belief", known_to=d(5)), edge(7, "belief", known=d(5), confidence=0.7), edge(8, "late", known=d(9)), edge(9, "gone", end=d(1), known_to=d(1)),
        edge(10, "twice"), edge(11, "twice", start=d(5), version=2),
    ]
    got = {r["source_id"]: (r["change"], r["was_seq"], r["now_seq"], r["now_confidence"]) for r in T.diff(spark.createDataFrame(rows, EDGE), (ntz(d(2)), ntz(d(2))), (ntz(d(8)), ntz(d(8)))).collect()}
    assert got == {"ended": ("ended", 2, None, None), "new": ("added", None, 3, 0.5), "other": ("changed", 4, 5, 0.9), "belief": ("re-believed", 6, 7, 0.7), "twice": ("changed", 10, 11, 0.5)}


def corrected(edges, corrections, minutes=10, latest=5):
    """One message after the other, as written down for the reference: edges as a list of dicts."""
    names = [c.split()[0] for c in EDGE.split(", ")]
    rows = [dict(zip(names, e)) for e in edges]
    todo = []
    for message, at in corrections:
        own = [r for r in rows if r["message_id"] == message]
        if own:
            todo.append((at, min(r["seq"] for r in own), own))
    for at, before, own in sorted(todo, key=lambda x: x[:2]):
        place = (own[0]["tenant_id"], own[0]["conversation_id"])
        seen = [r for r in rows if (r["tenant_id"], r["conversation_id"]) == place and r["recorded_to"] is None and r["seq"] < before and at - dt.timedelta(minutes=minutes) <= r["recorded_from"] <= at]
        seen = sorted(seen, key=lambda r: (r["recorded_from"], r["seq"]), reverse=True)[:latest]
        for new in own:
            for old in seen:
                if new["source_id"] == old["source_id"] and new["target_id"] != old["target_id"] and new["rel_type"] == old["rel_type"]:
                    old.update(recorded_to=at, valid_to=old["valid_from"], confidence=0.0, _ended=True)
                    new["confidence"] = new["confidence"] if new.get("_ended") else 0.95
    return {r["seq"]: (r["confidence"], r["valid_to"], r["recorded_to"]) for r in rows}


@pytest.mark.parametrize("latest", [5, 2])
def test_corrections_in_order(spark, latest):
    rng = random.Random(latest)
    edges, said, seq = [], [], 0
    for m in range(400):
        conversation = "hot" if m % 2 else f"c{m % 6}"  # half of all messages in one conversation
        at = DAY0 + dt.timedelta(minutes=m * 2 + (60 if m > 200 else 0))
        for _ in range(rng.choice([0, 1, 1, 3])):
            seq += 1
            edges.append(edge(seq, rng.choice("ab"), rng.choice("xyz"), rng.choice(["prefers", "avoids"]), start=at, known_to=at if rng.random() < 0.1 else None, conversation=conversation, message=f"m{m}"))
        if rng.random() < 0.5:
            said.append((f"m{m}", at))
    table = spark.createDataFrame(edges, EDGE).repartition(5)
    told = spark.createDataFrame([("t", "hot", m, t) for m, t in said], "tenant_id string, conversation_id string, message_id string, at timestamp_ntz")
    got = {r["seq"]: (r["confidence"], r["valid_to"], r["recorded_to"]) for r in R.retract_in_order(table, told, latest=latest).collect()}
    want = corrected(edges, said, latest=latest)
    assert got == want
    all_at_once = {r["seq"]: (r["confidence"], r["valid_to"], r["recorded_to"]) for r in R.retract(table, told, latest=latest).collect()}
    assert sum(c == 0.0 for c, _, _ in got.values()) > latest and (latest < 5 or got != all_at_once)


def test_corrections_at_once(spark):
    """Against a plain scan, with arrival out of step with time and blocks that are passed over; and edges aren't joined with corrections by time."""
    rng, edges, said = random.Random(7), [], []
    order = rng.sample(range(1, 701), 350) + list(range(9000, 700, -1))[:350]
    for m, seq in enumerate(order):
        at = DAY0 + dt.timedelta(seconds=m * rng.choice([1, 7]))
        edges.append(edge(seq, rng.choice("ab"), rng.choice("xyz"), rng.choice(["prefers", "avoids"]), start=at, known_to=at if rng.random() < 0.1 else None, conversation="hot", message=f"m{m}"))
        if rng.random() < 0.5:
            said.append((f"m{m}", at))
    names = [c.split()[0] for c in EDGE.split(", ")]
    rows = [dict(zip(names, e)) for e in edges]
    ended, sure = {}, set()
    for message, at in said:
        new = next(r for r in rows if r["message_id"] == message)
        seen = [r for r in rows if r["recorded_to"] is None and r["seq"] < new["seq"] and at - dt.timedelta(minutes=10) <= r["recorded_from"] <= at]
        for old in sorted(seen, key=lambda r: (r["recorded_from"], r["seq"]), reverse=True)[:5]:
            if (old["source_id"], old["rel_type"]) == (new["source_id"], new["rel_type"]) and old["target_id"] != new["target_id"]:
                ended[old["seq"]] = min(at, ended.get(old["seq"], at))
                sure.add(new["seq"])
    out = R.retract(spark.createDataFrame(edges, EDGE).repartition(5), spark.createDataFrame([("t", "hot", m, t) for m, t in said], "tenant_id string, conversation_id string, message_id string, at timestamp_ntz"))
    got = {r["seq"]: (r["confidence"], r["recorded_to"]) for r in out.collect()}
    want = {r["seq"]: (0.0 if r["seq"] in ended else 0.95 if r["seq"] in sure else r["confidence"], ended.get(r["seq"], r["recorded_to"])) for r in rows}
    assert got == want and len(ended) > 20
    assert "_unit" not in "".join(line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)


def test_learned_decay(spark):
    d = lambda n: DAY0 + dt.timedelta(days=n)
    rows = [edge(1, end=d(10)), edge(2, end=d(40)), edge(3), edge(4, start=d(25), end=d(30)), edge(5, kind="knows"), edge(6, kind="knows", start=d(99)), edge(7, kind="likes", start=d(30))]
    got = {r["rel_type"]: r for r in AN.learn_decay(spark.createDataFrame(rows, EDGE), ntz(d(30))).collect()}
    p = got["prefers"]
    assert (p["ended"], p["open"], p["exposure_days"]) == (2, 2, 75.0)  # 10 + 30 + 30 + 5
    assert p["rate"] == round(2 / 75, 9) and p["low"] == round(2 / 75 / math.exp(1.96 / math.sqrt(2)), 9) and p["high"] == round(2 / 75 * math.exp(1.96 / math.sqrt(2)), 9)
    assert (got["knows"]["rate"], got["knows"]["low"], got["knows"]["high"]) == (0.0, 0.0, round(-math.log(0.05) / 30, 9))
    assert got["likes"]["rate"] is None and got["likes"]["exposure_days"] == 0.0


def test_importance(spark):
    rng = random.Random(7)
    rows = [edge(k, f"n{rng.randint(0, 14)}", rng.choice(["hub", f"n{rng.randint(0, 19)}"]), confidence=rng.choice([0.4, 0.8, 1.0]), end=DAY0 if k % 9 == 0 else None, known_to=DAY0 if k % 9 == 0 else None) for k in range(120)]
    live = [r for r in rows if r[11] is None]
    ids = sorted({x for r in live for x in (r[5], r[6])})
    place = {x: k for k, x in enumerate(ids)}
    weights = np.zeros((len(ids), len(ids)))
    for r in live:
        weights[place[r[5]], place[r[6]]] += max(r[8] * math.exp(-0.05 * 3), 0.1)
    total = weights.sum(axis=1, keepdims=True)
    share = np.divide(weights, total, out=np.zeros_like(weights), where=total > 0)
    value = np.full(len(ids), 1 / len(ids))
    for _ in range(200):
        value = 0.15 / len(ids) + 0.85 * (value @ share + value[total[:, 0] == 0].sum() / len(ids))
    got = {r["id"]: r["importance"] for r in AN.importance(spark.createDataFrame(rows, EDGE), ntz(DAY0 + dt.timedelta(days=3)), tolerance=1e-7).collect()}
    assert got.keys() == place.keys() and all(abs(got[x] - value[place[x]]) < 1e-6 for x in ids)
    assert max(got, key=got.get) == "hub" and abs(sum(got.values()) - 1) < 1e-9
    assert AN.importance(spark.createDataFrame([], EDGE), ntz(DAY0)).collect() == []
