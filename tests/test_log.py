"""The message log as a stream: whole segments only, exactly once over restarts and replays, late messages in order of arrival."""

import datetime as dt
import os

from palimpsest.streaming import log


def said(n, **more):
    return [{"text": f"t{n}-{k}", "speaker": "K", "timestamp": "2024-01-15T10:00:00Z", **more} for k in range(3)]


def run(spark, folder, out, check):
    stream = log.messages(spark.readStream.format("message_log").load(folder), "2024-01-01T00:00:00Z")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()


def test_exactly_once_over_restarts(spark, tmp_path):
    log.register(spark)
    folder, out, check = f"file://{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/check"
    log.append(folder, said(0))
    log.append(folder, said(1), writer="other")
    run(spark, folder, out, check)
    log.append(folder, said(2, timestamp="2020-01-01T00:00:00Z") + [{"text": "no speaker"}, {"speaker": "K"}])  # late, and two that lack something
    with open(f"{tmp_path}/log/push/half.part", "w") as f:
        f.write('{"text": "not wh')
    run(spark, folder, out, check)
    want = {f"t{n}-{k}" for n in range(3) for k in range(3)}
    got = spark.read.parquet(out).collect()
    assert sorted(r["text"] for r in got) == sorted(want)
    late = {r["seq"] for r in got if r["timestamp"].year == 2020}
    assert min(late) > max(r["seq"] for r in got if r["writer"] == "push" and r["timestamp"].year == 2024) and {r["conversation_id"] for r in got} == {"default"}
    last = max(int(n) for n in os.listdir(f"{check}/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):  # the last batch was not committed: it is read again
        os.path.exists(f"{check}/commits/{name}") and os.remove(f"{check}/commits/{name}")
    log.append(folder, said(3))
    run(spark, folder, out, check)
    assert sorted(r["text"] for r in spark.read.parquet(out).collect() if not r["text"].startswith("t3")) == sorted(want)
    run(spark, folder, out, check)  # one run is one batch
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == sorted(want | {f"t3-{k}" for k in range(3)})


def test_batch_read_and_defaults(spark, tmp_path):
    log.register(spark)
    folder = f"file://{tmp_path}/log"
    assert spark.read.format("message_log").load(folder).collect() == []
    log.append(folder, [{"text": "a", "speaker": "K"}, {"text": "b", "speaker": "K", "group_id": "g", "message_id": "m", "tenant_id": "007"}])
    a, b = log.messages(spark.read.format("message_log").load(folder), "2024-01-01T00:00:00Z").orderBy("seq").collect()
    assert (a["message_id"], a["tenant_id"], a["group_id"], a["timestamp"]) == ("push:0", "default", "default", dt.datetime(2024, 1, 1))
    assert (b["message_id"], b["tenant_id"], b["group_id"]) == ("m", "007", "g")
