"""Rules and small functions: listings, names, reports, exports, merge chains, the facade's checks."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest.graph import Graph, instant
from palimpsest.operators import entities as E
from palimpsest.operators import relationships as R
from palimpsest.sources import files as SRC

DAY0 = dt.datetime(2024, 1, 1)


def test_archives_and_links(spark, tmp_path):
    for name in ("enterprise_2019.zip", "deep/loans_202305.zip", "202401/pool.zip", "notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("a", "b")
    by_year = SRC.archives(spark, str(tmp_path), "fannie", False).collect()
    assert [(r["source"], r["record_id"], r["event_date"]) for r in by_year] == [("fannie", "enterprise_2019", "2019-01-01")] and by_year[0]["bytes"] > 20
    by_month = {r["record_id"]: r["event_date"] for r in SRC.archives(spark, str(tmp_path), "ginnie", True).collect()}
    assert by_month["loans_202305"] == "2023-05-01" and by_month["pool"] == "2024-01-01"
    found = spark.createDataFrame([("a/PUDB_2019.zip", 1), ("a/pudb_2009.zip", 1), ("enterprise.ZIP", 1), ("other_2020.zip", 1), ("pudb_2020.pdf", 1)], "link string, pages long")
    assert sorted(r["link"] for r in SRC.zip_links(found, 2015).collect()) == ["a/PUDB_2019.zip", "enterprise.ZIP"]
    files = spark.createDataFrame([("monthly_1",), ("daily_1",), ("yearly",)], "name string")
    assert sorted(r["name"] for r in SRC.with_prefix(files, ["monthly", "year"]).collect()) == ["monthly_1", "yearly"]


def test_filings_and_names(spark, tmp_path):
    hits = spark.createDataFrame([(1, ["1", "2"], ["Old", "Two"]), (2, ["1"], ["New"])], "seq long, ciks array<string>, names array<string>")
    assert {r["cik"]: r["name"] for r in SRC.cik_names(hits).collect()} == {"1": "New", "2": "Two"}
    (tmp_path / "a.meta.json").write_text('{"filing_date": "2024-02-03"}')
    (tmp_path / "b.meta.json").write_text("{broken")
    (tmp_path / "c.meta.json").write_text('{"filing_date": 5}')
    got = {r["file_path"][-11:]: r["filing_date"] for r in SRC.meta_dates(spark, str(tmp_path)).collect()}
    assert got == {"a.meta.json": "2024-02-03", "b.meta.json": None, "c.meta.json": None}
    titles = spark.createDataFrame([("Q1 report: a/b",), ("x" * 300,)], "t string").select(SRC.safe_file_name(F.col("t")).alias("n")).collect()
    assert titles[0]["n"] == "Q1_report_a_b" and len(titles[1]["n"]) == 100


def test_reports_exports_and_corpus(spark, tmp_path):
    one = spark.createDataFrame([(3, "x")], "n long, s string")
    SRC.write_report(one, f"{tmp_path}/one")
    SRC.write_report({"a": one, "none": one.limit(0)}, f"{tmp_path}/two")
    read = lambda name: json.loads(spark.read.text(f"{tmp_path}/{name}", wholetext=True).first()[0])
    assert read("one") == {"n": 3, "s": "x"} and read("two") == {"a": [{"n": 3, "s": "x"}], "none": []}
    rows = spark.createDataFrame([("007", 1), ("b", 2)], "tenant_id string, n long")
    SRC.export({"rows": rows, "shared": one}, "007", f"{tmp_path}/e")
    assert [r["n"] for r in spark.read.json(f"{tmp_path}/e/rows").collect()] == [1] and spark.read.json(f"{tmp_path}/e/shared").count() == 1
    records = spark.createDataFrame([("edgar", "d", "r", "2024-01-01", "p", {"k": "v"})], SRC.RECORD)
    SRC.write_ndjson(records, f"{tmp_path}/records")
    assert SRC.read_ndjson(spark, f"{tmp_path}/records").collect() == records.collect()
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# one\n\ntwo")
    (tmp_path / "docs" / "b.txt").write_text("no")
    got = SRC.corpus(spark, f"{tmp_path}/docs").collect()
    assert [r["text"] for r in got] == ["# one\n\ntwo"] and len(got[0]["message_id"]) == 16


def test_merge_chains(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("c", "d")], "dup string, primary string")
    assert {r["dup"]: r["primary"] for r in E.resolve_chains(pairs).collect()} == {"a": "d", "b": "d", "c": "d", "x": "y"}
    with pytest.raises(ValueError, match="cycle"):
        E.resolve_chains(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "dup string, primary string"), rounds=4)


def test_the_facade_checks_what_it_is_asked(spark):
    rows = [(1, "t", "g", "t:g:PERSON:ann", "x", "prefers", 0.5, DAY0), (2, "t", "g", "t:g:PERSON:ann", "y", "prefers", 0.5, DAY0 + dt.timedelta(days=2))]
    said = spark.createDataFrame(rows, "seq long, tenant_id string, group_id string, source_id string, target_id string, rel_type string, confidence double, valid_from timestamp_ntz").withColumn("recorded_from", F.col("valid_from"))
    people = spark.createDataFrame([("t:g:PERSON:ann", "t", "ann")], "id string, tenant_id string, canonical_name string")
    graph = Graph(people, R.resolve(said))
    assert [r["seq"] for r in graph.as_of("t", "Ann", "2024-01-02T00:00:00Z").collect()] == [1] and [r["seq"] for r in graph.as_of("t", "Ann", "2024-01-03T01:00:00+01:00", "knowledge").collect()] == [2]
    assert {r["target_id"]: r["change"] for r in graph.changes("2024-01-02", "2024-01-05").collect()} == {"x": "ended", "y": "added"}
    assert [r["predecessor"] for r in graph.evolution("t", "Ann", "prefers").collect()] == [None, 1]
    for bad in ({"mode": "someday"}, {"rel_type": "likes"}):
        with pytest.raises(ValueError):
            graph.as_of("t", "Ann", "2024-01-02", **bad)
    for bad in ("tomorrow", "", None):
        with pytest.raises(ValueError):
            instant(bad)
    with pytest.raises(ValueError):
        graph.evolution("t", "Ann", "likes")
