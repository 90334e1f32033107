"""Closed forms against sequential folds, batches and streams against one batch, sources and sinks."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import facts as FA
from palimpsest.operators import messages as M
from palimpsest.operators import relationships as R
from palimpsest.operators import temporal as T
from palimpsest.sources import files as SRC
from palimpsest.streaming.ingest import EdgeTable, dedup_stream

DAY = dt.datetime(2024, 1, 1)


def random_edges(n=400, seed=2):
    rng = random.Random(seed)
    return [(i, "t", "g", f"s{rng.randint(0, 5)}", f"x{rng.randint(0, 3)}", rng.choice(["prefers", "avoids", "knows"]), DAY + dt.timedelta(days=rng.randint(0, 90)), DAY + dt.timedelta(days=i)) for i in range(n)]


NAMES = "seq long, tenant_id string, group_id string, source_id string, target_id string, rel_type string, valid_from timestamp_ntz, recorded_from timestamp_ntz"


def fold(rows):
    out = {}
    for seq, t, g, s, x, kind, at, _ in rows:
        version = 1
        if kind in R.CLOSING:
            version = 1 + max([e["version"] for e in out.values() if e["s"] == s and e["kind"] == kind], default=0)
            for e in out.values():
                if e["s"] == s and e["kind"] in R.CLOSING and e["to"] is None:
                    e["to"] = at
        out[seq] = {"s": s, "kind": kind, "version": version, "to": None}
    return {k: (e["version"], e["to"]) for k, e in out.items()}


def test_resolve_equals_fold(spark):
    rows = random_edges()
    got = {r["seq"]: (r["version"], r["valid_to"]) for r in R.resolve(spark.createDataFrame(rows, NAMES)).collect()}
    assert got == fold(rows)


def test_batches_equal_one_batch(spark, tmp_path):
    rows = random_edges(150, 3)
    table = EdgeTable(str(tmp_path / "edges"), [c.split()[0] for c in NAMES.split(", ")])
    for k in range(3):
        table.upsert(spark.createDataFrame(rows[k * 50 : k * 50 + 50], NAMES), k)
    table.upsert(spark.createDataFrame(rows[100:], NAMES), 2)  # a batch that runs again
    assert {r["seq"]: (r["version"], r["valid_to"]) for r in table.read(spark).collect()} == fold(rows)


def test_supersession_equals_queue(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 3), rng.choice("ab"), rng.choice(["a", "b", None]), DAY + dt.timedelta(days=i)) for i in range(300)]
    want, status = {}, {}
    queues: dict = {}
    for seq, e, key, pop, _ in rows:
        q = queues.get((e, pop), [])
        want[seq] = q.pop(0) if pop and q else None
        if want[seq] is not None:
            status[want[seq]] = "superseded"
        queues.setdefault((e, key), []).append(seq)
    got = FA.supersede(spark.createDataFrame(rows, "seq long, entity_id long, fact_key string, supersedes_key string, valid_from timestamp_ntz")).collect()
    assert {r["seq"]: r["supersedes_seq"] for r in got} == want and all(r["status"] == status.get(r["seq"], "active") for r in got)


def demo(s, _=None):
    """Six messages of one conversation with the extraction output that a model would give."""
    person = {"name": "Lena", "canonical": "lena", "type": "PERSON", "confidence": 0.95}
    rows, shoes = [], ["asics", "asics", "trail", "saucony", "saucony", "marathon"]
    for i, brand in enumerate(shoes):
        kind = "GOAL" if brand == "marathon" else "PREFERENCE"
        rel = {"source_mention": "Lena", "target_mention": brand.title(), "type": "has_goal" if kind == "GOAL" else "prefers" if i in (0, 3) else "discussed" if i != 2 else "runs_on", "evidence": "said so", "confidence": 0.95, "temporal_marker": "now"}
        facts = [{"entity_mention": "Lena", "fact_key": "shoe", "fact_text": brand, "supersedes_key": "shoe" if i else None, "confidence": 0.9}] if i in (0, 3) else []
        com = [{"entity_mention": "Lena", "text": "run a marathon", "target_date": "2024-10-01", "confidence": 0.9}] if i == 5 else []
        rows.append((f"m{i}", i, "default", None, "coach", f"2024-0{1 + i // 2}-{'15' if i % 2 == 0 else '28'}T10:00:00", json.dumps({"entities": [person, {"name": brand.title(), "canonical": brand, "type": kind, "confidence": 0.9}]}), json.dumps({"relationships": [rel]}), json.dumps({"facts": facts}), json.dumps({"commitments": com}), json.dumps({"opening_state": "ok", "breakthrough": i == 5})))
    names = "message_id string, seq long, tenant_id string, group_id string, conversation_id string, t string, entities_json string, relationships_json string, facts_json string, commitments_json string, summary_json string"
    m = s.createDataFrame(rows + [("m0", 99, *rows[0][2:])], names).withColumn("timestamp", F.col("t").cast("timestamp_ntz")).drop("t")
    return M.first_arrivals(m)


def test_demo_conversation(spark):
    said = demo(spark)
    parts = M.extract(said)
    edges = {r["message_id"]: r for r in parts["edges"].collect()}
    assert edges["m0"]["valid_to"] == edges["m3"]["valid_from"] and edges["m3"]["version"] == 2 and edges["m2"]["original_type"] == "runs_on"
    assert {r["message_id"]: r["entities"] for r in M.ingest_response(said, parts).collect()} == {f"m{i}": 2 for i in range(6)}


def test_messages_resolve_own_entities_in_their_row(spark):
    """Only what the conversation knew before is joined, once a side; facts need no join at all."""
    parts = M.extract(demo(spark))
    joins = lambda df: [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins(parts["edges"])) == 2 and not joins(parts["facts"])


def test_edges_are_sorted_once(spark):
    rows = spark.createDataFrame([], "seq long, tenant_id string, group_id string, source_id string, target_id string, rel_type string, confidence double, valid_from timestamp_ntz, recorded_from timestamp_ntz")
    plan = T.bitemporal(R.resolve(rows), F.lit(DAY).cast("timestamp_ntz"))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("+- Window") == 1 and "Union" not in plan


def test_stream_dedup(spark, tmp_path):
    rows = spark.createDataFrame([("a", DAY), ("a", DAY), ("b", DAY)], "message_id string, timestamp timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    q = dedup_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("dedup").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["message_id"] for r in spark.sql("SELECT * FROM dedup").collect()) == ["a", "b"]


def test_message_file_and_sidecars(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"messages": [{"text": "hi", "speaker": "K", "timestamp": "2024-01-15T10:00:00Z"}, {"text": "no speaker"}]}))
    good, bad = SRC.read_messages(spark, str(tmp_path / "m.json"), "2024-01-01T00:00:00Z")
    r = good.collect()
    assert len(r) == 1 and bad.count() == 1 and r[0]["timestamp"] == dt.datetime(2024, 1, 15, 10) and r[0]["group_id"] == "default"
    d = tmp_path / "e"
    d.mkdir()
    (d / "a.meta.json").write_text('{"cik": "1", "accession": "x", "filing_date": "2024-02-03"}')
    (d / "b.meta.json").write_text("{broken")
    (d / "c.meta.json").write_text('{"cik": "1", "accession": 5, "filing_date": "2024-02-03"}')
    assert [(x["record_id"], x["event_date"]) for x in SRC.sidecars(spark, str(d)).collect()] == [("x", "2024-02-03")]


@pytest.mark.parametrize("limit,want", [(4, [["a b", "c d"], ["e"]]), (2, [["a b"], ["c d"], ["e"]])])
def test_chunks(spark, limit, want):
    docs = spark.createDataFrame([(1, "a b\n\nc d\n\n\n\ne")] if limit == 2 else [(1, "a b\n\nc d\n\ne")], "doc_id long, text string")
    got = [r["text"].split("\n\n") for r in SRC.chunk_text(docs, limit).orderBy("chunk").collect()]
    assert got == want


def test_latest_periods(spark):
    files = spark.createDataFrame([(f"x_2024{m:02d}.zip",) for m in range(1, 6)] + [("bad.zip",)], "name string")
    assert sorted(r["period"] for r in SRC.latest_periods(files, 2).collect()) == ["202404", "202405"]
    assert spark.range(1).select(SRC.recent_periods(F.lit("2024-03-01").cast("date"), 3)).first()[0] == ["202401", "202403"]
