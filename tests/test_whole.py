"""Queries over all rows and whole texts, against brute force on small fixtures."""

import datetime as dt
import random
import re
import unicodedata

from palimpsest.plans import catalog


def norm(text):
    kept = "".join(c for c in text.lower() if c == "_" or c.isspace() or unicodedata.category(c)[0] in "LN")
    return re.sub(r"\s+", "-", kept.strip())


def test_normalize_texts_takes_whole_texts(spark, tmp_path):
    head = "the first forty code points are all alike "
    texts = [head + "Ünïcode,   ÉTÉ\n\n- (Tail!) ", head + "x" * 30000 + " \t END.", "\n a-b c ", "", None, head + "Ж; 数_1　ß"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Customer#000000001")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["id"]: r["norm"] for r in catalog.QUERIES["normalize_texts"](spark, str(tmp_path)).collect()}
    assert got == {1: "customer000000001"} | {-1 - i: t and norm(t) for i, t in enumerate(texts)}


def test_as_of_join_keyless_probes_every_event(spark, tmp_path):
    rng = random.Random(3)
    kinds = ["purchase", "error", "click", "view", "signup"]
    start = dt.datetime(2024, 1, 1)
    data = [(i, rng.randint(0, 5), rng.choice(kinds), start + dt.timedelta(hours=rng.randint(0, 900)), '{"k": "v"}') for i in range(1, 150)]
    spark.createDataFrame(data, "event_id long, user_id long, event_type string, ts timestamp_ntz, props string").write.parquet(f"{tmp_path}/events.parquet")
    live = []
    for user in range(6):
        mine = sorted((i, at) for i, u, kind, at, _ in data if u == user and kind in ("purchase", "error"))
        live += [(i, at, mine[k + 1][1] if k + 1 < len(mine) else dt.datetime.max) for k, (i, at) in enumerate(mine)]
    want = {}
    for i, _, _, now, _ in data:
        if hits := [seq for seq, a, b in live if a <= now < b]:
            want[i] = (len(hits), min(hits))
    got = {r["probe"]: (r["n"], r["first_seq"]) for r in catalog.QUERIES["as_of_join_keyless"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 100
