"""Stored graphs: types, files chosen by the manifest; decoders of a store's rows."""

import datetime as dt

from pyspark.sql import functions as F

from palimpsest.sources import files as SRC

DAY0 = dt.datetime(2024, 1, 1)
ROW = "seq long, tenant_id string, source_id string, target_id string, rel_type string, version long, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_from timestamp_ntz, recorded_to timestamp_ntz"


def day(n):
    return F.lit(DAY0 + dt.timedelta(days=n)).cast("timestamp_ntz")


def rows():
    for k in range(400):
        start = DAY0 + dt.timedelta(days=k // 4)
        end = None if k % 40 == 0 else start + dt.timedelta(days=2)
        yield (k, "007" if k % 2 else "true", f"s{k % 9}", "x", "prefers", 1, start, end, start, end)


def test_graph_round_trip_and_pruning(spark, tmp_path):
    path, data = f"{tmp_path}/g", list(rows())
    SRC.write_graph(spark.createDataFrame(data, ROW), path, file_rows=20)
    back = SRC.read_graph(spark, path)
    assert [f.dataType for f in back.schema.fields if f.name != "current"] == [f.dataType for f in spark.createDataFrame([], ROW).schema.fields]
    assert sorted(map(tuple, back.select(*[c.split()[0] for c in ROW.split(", ")]).collect())) == sorted(data)
    every = SRC.graph_files(spark, path).count()
    asked = {"valid_at": day(50), "tenant": "007"}
    assert 0 < SRC.graph_files(spark, path, **asked).count() <= every // 5
    at = DAY0 + dt.timedelta(days=50)
    assert sorted(r["seq"] for r in SRC.read_graph(spark, path, **asked).collect()) == [r[0] for r in data if r[1] == "007" and r[6] <= at and (r[7] is None or r[7] > at)]
    assert sorted(r["seq"] for r in SRC.read_graph(spark, path, known_at=day(3), source="s4").collect()) == [r[0] for r in data if r[2] == "s4" and r[8] <= DAY0 + dt.timedelta(days=3) and (r[9] is None or r[9] > DAY0 + dt.timedelta(days=3))]
    assert {r["seq"] for r in SRC.read_graph(spark, path, current=True).collect()} == {r[0] for r in data if r[7] is None}
    assert SRC.read_graph(spark, path, tenant="nobody").collect() == [] and SRC.read_graph(spark, path, tenant="nobody").columns == back.columns


def test_empty_graph(spark, tmp_path):
    SRC.write_graph(spark.createDataFrame([], ROW), f"{tmp_path}/g")
    assert SRC.read_graph(spark, f"{tmp_path}/g").collect() == []


def test_decoders(spark):
    edges = spark.createDataFrame([("2024-01-01T00:00:00Z", None, "0.5", None, '[{"message_id": "m", "text": "t"}]'), ("bad", "2024-01-02T01:00:00+01:00", "x", "3", "{broken")], "valid_from string, valid_to string, c string, version string, structured_evidence string")
    got = SRC.decode_edges(edges.withColumn("confidence", F.col("c").try_cast("double"))).collect()
    assert got[0]["valid_from"] == DAY0 and got[0]["version"] == 1 and got[0]["structured_evidence"][0]["text"] == "t" and got[0]["confidence"] == 0.5
    assert got[1]["valid_from"] is None and got[1]["valid_to"] == DAY0 + dt.timedelta(days=1) and got[1]["version"] == 3 and got[1]["structured_evidence"] == []
    entities = spark.createDataFrame([("e", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00", None, ["m"], '{"a": "b"}'), ("f", None, None, ["x"], None, None)], "id string, created_at string, last_mentioned string, aliases array<string>, source_messages array<string>, metadata string")
    got = SRC.decode_entities(entities).collect()
    assert got[0]["created_at"] == DAY0 and got[0]["aliases"] == [] and got[0]["metadata"] == {"a": "b"} and got[1]["source_messages"] == [] and got[1]["metadata"] == {}
    facts = spark.createDataFrame([("2024-01-01T00:00:00Z", None, 0.5), ("2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z", 1.0)], "valid_from string, valid_to string, confidence double")
    assert [r["status"] for r in SRC.decode_facts(facts).collect()] == ["active", "superseded"]
