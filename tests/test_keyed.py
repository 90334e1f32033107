"""Edges and facts with state for each key: batches equal one batch, restarts go on, a batch that comes again changes nothing."""

import datetime as dt
import random

from palimpsest.operators import facts as FA
from palimpsest.operators import relationships as R
from palimpsest.streaming import keyed

DAY = dt.datetime(2024, 1, 1)
ROW = "seq long, tenant_id string, group_id string, source_id string, target_id string, rel_type string, confidence double, valid_from timestamp_ntz, recorded_from timestamp_ntz"
FACT = "seq long, entity_id long, fact_key string, supersedes_key string, valid_from timestamp_ntz"


def run(stream, events, path, check):
    for q in keyed.write_log(stream, events, path, check):
        q.awaitTermination()


def deliver(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def source(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_edges_by_key(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, "t", "g", f"s{rng.choice([0, 0, 0, 1, 2])}", f"x{rng.randint(0, 3)}", rng.choice(["prefers", "avoids", "discussed"]), k / 100, DAY + dt.timedelta(hours=k), DAY + dt.timedelta(hours=k + 1)) for k in range(60)]
    folder, path, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    for k in range(3):  # two batches, and after a restart two more
        deliver(spark, rows[k * 12 : k * 12 + 12], ROW, folder, f"b{k}")
        if k:
            s = source(spark, ROW, folder)
            run(s, keyed.edge_events(s), path, check)
    deliver(spark, rows[36:], ROW, folder, "b9")
    s = source(spark, ROW, folder)
    run(s, keyed.edge_events(s), path, check)
    cols = ["seq", "source_id", "target_id", "rel_type", "version", "valid_from", "valid_to", "recorded_to", "conflicts"]
    want = sorted(map(tuple, R.resolve(spark.createDataFrame(rows, ROW)).select(cols).collect()))
    assert sorted(map(tuple, keyed.LogTable(path).edges(spark).select(cols).collect())) == want
    again = keyed.LogTable(path)
    again.rows_batch(spark.createDataFrame(rows[:12], ROW), 0)  # the first batch comes again
    assert sorted(map(tuple, again.edges(spark).select(cols).collect())) == want


def test_facts_by_key(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, rng.choice([1, 1, 1, 2]), rng.choice(["a", "b", None]), rng.choice(["a", "b", "c", None, None]), DAY + dt.timedelta(hours=k)) for k in range(60)]
    folder, path, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    for k in range(3):
        deliver(spark, rows[k * 20 : k * 20 + 20], FACT, folder, f"b{k}")
        s = source(spark, FACT, folder)
        run(s, keyed.fact_events(s), path, check)
    cols = ["seq", "entity_id", "fact_key", "supersedes_key", "valid_to", "supersedes_seq", "status"]
    want = sorted(map(tuple, FA.supersede(spark.createDataFrame([r for r in rows], FACT)).select(cols).collect()))
    assert sorted(map(tuple, keyed.LogTable(path).facts(spark).select(cols).collect())) == want
