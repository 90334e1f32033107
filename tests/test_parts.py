"""Research scores by hand, context, corrections, decoders, filings and other small parts."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import messages as M
from palimpsest.operators import relationships as R
from palimpsest.operators import research as X
from palimpsest.sources import files as SRC

DAY = dt.datetime(2024, 1, 10)


def test_scores_by_hand(spark):
    bias = {"fannie": (0.42, 0.23, 0.35), "edgar": (0.36, 0.34, 0.30), "other": (0.33, 0.33, 0.33)}
    factor = {"baseline": 1.0, "reduced_context": 0.96, "distractor": 0.9}
    h = lambda x: int(hashlib.sha256(x.encode()).hexdigest()[:12], 16) / 16.0**12
    names = ("stability", "distress", "refi")
    rows = spark.createDataFrame([(f"r{i}", s) for i in range(20) for s in bias], "record_id string, source string")
    for r in X.score(X.expand_profiles(rows)).collect():
        raw = [(0.65 * h(f"{r['record_id']}::{b}") + 0.35 * bias[r["source"]][i]) * factor[r["profile"]] + (0.02 * h(f"{r['record_id']}::noise::{b}") if r["profile"] == "distractor" else 0) for i, b in enumerate(names)]
        scores = [x / sum(raw) for x in raw]
        assert [r[f"score_{b}"] for b in names] == pytest.approx(scores, abs=1e-8) and r["top"] == names[scores.index(max(scores))]
        assert r["truth"] == names[min(int(h(r["record_id"] + "::truth") * 3), 2)]


def test_corrections(spark):
    said = ["Actually, no", "I meant him", "well, actually", "Correction: x", "No, he", "nobody", "Sorry, I misspoke", "let me clarify", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").orderBy("i").select(R.is_correction(F.col("t"))).collect()]
    assert got == [True, True, False, True, True, False, True, True, False]
    names = "seq long, tenant_id string, conversation_id string, message_id string, source_id string, target_id string, rel_type string, confidence double, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_from timestamp_ntz, recorded_to timestamp_ntz"
    at = lambda m: DAY + dt.timedelta(minutes=m)
    row = lambda i, m, target, kind="knows", to=None: (i, "t", "c", f"m{i}", "s", target, kind, 0.6, at(m), to, at(m), to)
    rows = [row(0, -30, "old"), row(1, 1, "a"), row(2, 2, "b"), row(3, 3, "x"), row(4, 4, "a", "likes"), row(5, 5, "gone", to=at(6)), row(6, 8, "x")]
    out = {r["seq"]: (r["confidence"], r["recorded_to"], r["valid_to"]) for r in R.retract(spark.createDataFrame(rows, names), spark.createDataFrame([("t", "c", "m6", at(8))], "tenant_id string, conversation_id string, message_id string, at timestamp_ntz")).collect()}
    assert out == {0: (0.6, None, None), 1: (0.0, at(8), at(1)), 2: (0.0, at(8), at(2)), 3: (0.6, None, None), 4: (0.6, None, None), 5: (0.6, at(6), at(6)), 6: (0.95, None, None)}


def test_context(spark):
    people = [(f"t:g:PERSON:p{i}", "t", "c", f"p{i}", "PERSON", DAY - dt.timedelta(hours=i * 8)) for i in range(30)]
    entities = spark.createDataFrame(people, "id string, tenant_id string, conversation_id string, canonical_name string, entity_type string, last_mentioned timestamp_ntz")
    edges = spark.createDataFrame([(k, f"t:g:PERSON:p{k % 3}", f"t:g:X:y{k // 2}", "knows", "e" * 150, None, None) for k in range(60)], "seq long, source_id string, target_id string, rel_type string, evidence string, valid_to timestamp_ntz, recorded_to timestamp_ntz")
    facts = spark.createDataFrame([(k, "t:g:PERSON:p0", f"k{k}", "v", 0.8, "active" if k else "superseded") for k in range(9)], "seq long, entity_id string, fact_key string, fact_text string, confidence double, status string")
    asked = spark.createDataFrame([("m1", "t", "c", DAY), ("m2", "t", "other", DAY)], "message_id string, tenant_id string, conversation_id string, timestamp timestamp_ntz")
    got = {r["message_id"]: r for r in M.context(asked, entities, edges, facts).collect()}
    assert [e["name"] for e in got["m1"]["entities"]] == [f"p{i}" for i in range(20)] and got["m2"]["entities"] == [] == got["m2"]["relationships"]
    assert [f["key"] for f in got["m1"]["entities"][0]["known_facts"]] == ["k1", "k2", "k3", "k4", "k5"]
    links = got["m1"]["relationships"]
    assert len(links) == 20 and {x["source"] for x in links} == {"p0"} and all(len(x["evidence"]) == 100 for x in links)


def test_filings_and_small_rules(spark, tmp_path):
    subs = spark.createDataFrame([("1", ["ABS-EE", "10-K", "ABS-EE/A"], ["a", "b", "c"], ["2024-01-01", "2024-02-01", "2024-03-01"])], "cik string, forms array<string>, accessions array<string>, dates array<string>")
    assert [r["accession"] for r in SRC.filings(subs).orderBy("position").collect()] == ["a", "c"] and [r["accession"] for r in SRC.filings(subs, "2024-02-01").collect()] == ["c"]
    assert spark.range(1).select(SRC.exhibit_name(F.array(F.lit("x.xml"), F.lit("EX102_a.XML"), F.lit("102.xml")))).first()[0] == "EX102_a.XML"
    assert [SRC.retry_delay(2), SRC.retry_delay(0, "7"), SRC.retry_delay(1, "x"), SRC.retry_delay(1, "-1")] == [2.0, 7.0, 1.0, 1.0]
    assert SRC.template_sha256(str(tmp_path / "none")) == ""
