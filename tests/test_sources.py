"""Feeds, dimension tables and sinks."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from routewatch import fixtures as X
from routewatch.plans import alerts as AL
from routewatch.plans import summary as SU
from routewatch.sources import dims, feeds, sinks

MESSAGES = [
    {"type": "ris_message", "data": {"timestamp": 1700000000.25, "peer": "192.0.2.7", "peer_asn": "1", "id": "a", "type": "UPDATE",
     "path": [3356, 174, [64500, 64501]], "community": [[65535, 666], [1, 2]],
     "announcements": [{"next_hop": "x", "prefixes": ["1.0.0.0/24", "2.0.0.0/24"]}, {"next_hop": "y", "prefixes": ["2400::/32"]}],
     "withdrawals": ["9.0.0.0/8"]}},
    {"type": "ris_message", "data": {"timestamp": 1700000001, "peer": "2001:db8::1", "id": "b", "type": "KEEPALIVE"}},
    {"type": "ris_error", "data": {"message": "no"}},
]


def write_feed():
    folder = tempfile.mkdtemp(prefix="routewatch-feed-")
    with open(os.path.join(folder, "a.json"), "w") as f:
        f.write("\n".join(json.dumps(m) for m in MESSAGES) + "\nnot json\n")
    return folder


def test_ris_json(spark):
    rows = {r.prefix: r for r in feeds.read_ris_json(spark, write_feed()).collect()}
    assert sorted(rows) == ["1.0.0.0/24", "2.0.0.0/24", "2400::/32", "9.0.0.0/8"]
    a, w = rows["1.0.0.0/24"], rows["9.0.0.0/8"]
    assert (a.ts, a.host, a.peer, a.path_str, a.path_len, a.comm_str) == (
        1700000000, "192.0.2.7", "192.0.2.7", "3356 174 {64500,64501}", 4, "65535:666 1:2")
    assert a.origin_asn == 0 and not a.is_withdrawal
    assert w.is_withdrawal and (w.path_str, w.path_len, w.origin_asn, w.comm_str) == ("", 0, 0, "")
    assert len({r.update_id for r in rows.values()}) == 4 and all(r.update_id >= 0 for r in rows.values())


def test_ris_json_stream(spark):
    folder = write_feed()
    q = feeds.read_ris_json(spark, folder, streaming=True).writeStream.format("memory").queryName("ris").trigger(
        availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("ris").count() == 4


def test_load_dims(spark, sf):
    root = tempfile.mkdtemp(prefix="routewatch-dims-")
    for n in ("seen", "roas", "bogons", "as_info"):
        X.load(spark, sf, n).write.parquet(f"{root}/{n}.parquet")
    d = dims.load_dims(spark, root)
    assert d["geo"] is None and d["seen"].count() == X.load(spark, sf, "seen").count()


def test_state_and_alert_tables(spark, sf):
    root = tempfile.mkdtemp(prefix="routewatch-sink-")
    e = X.load(spark, sf, "classified")
    mid = 1704071000
    for part in (e.filter(F.col("ts") < mid), e.filter(F.col("ts") >= mid)):
        sinks.upsert_prefix_state(part, f"{root}/state")
        sinks.append_flap_events(part, f"{root}/flaps")
    key = lambda df: sorted(map(str, df.collect()))
    cols = ["prefix", "last_update_ts", "classified_type", "origin_asn"]
    assert key(sinks.read_table(spark, f"{root}/state").select(*cols)) == key(SU.prefix_state(e).select(*cols))
    assert spark.read.parquet(f"{root}/flaps").count() == SU.flap_events(e).count()
    a = AL.alerts(AL.critical_events(e, X.load(spark, sf, "as_info")))
    sinks.upsert_alerts(a, f"{root}/alerts")
    sinks.upsert_alerts(a, f"{root}/alerts", now=1704076399)
    assert sinks.read_table(spark, f"{root}/alerts").count() == AL.merge_alerts(None, a).count()


def test_table_versions(spark):
    """A write that never finished is not the table, and old versions go."""
    root = tempfile.mkdtemp(prefix="routewatch-versions-")
    assert sinks.read_table(spark, f"{root}/t") is None
    for i in range(5):
        sinks.replace_table(spark.range(i + 1), f"{root}/t")
    os.makedirs(f"{root}/t/v-000000000006")
    assert sinks.read_table(spark, f"{root}/t").count() == 5
    sinks.replace_table(sinks.read_table(spark, f"{root}/t").limit(2), f"{root}/t")
    assert sinks.read_table(spark, f"{root}/t").count() == 2
    assert sorted(os.listdir(f"{root}/t")) == [f"v-{n:012d}" for n in (4, 5, 6)]


def test_order_inside_a_second(spark):
    """Withdrawn and announced again within a second: the last message is the last row."""
    def line(at, n, **what):
        return json.dumps({"type": "ris_message", "data": {"timestamp": at, "peer": "192.0.2.7", "id": f"192.0.2.7-018c7a1ab0a4{n:04x}",
                                                           "type": "UPDATE", "path": [1, 2], **what}})
    lines = []
    for i in range(100):
        net = f"20.{i}.0.0/16"
        up = {"announcements": [{"next_hop": "x", "prefixes": [net]}]}
        lines += [line(1700000000.9, 2, **up), line(1700000000.1, 1, withdrawals=[net])] if i % 2 else [
            line(1700000000.5, 7, withdrawals=[net]), line(1700000000.5, 6, **up)]
    rows = feeds.ris_rows(spark.createDataFrame([(x,) for x in lines], "value string"))
    last = {r.prefix: r.w for r in rows.groupBy("prefix").agg(F.max_by("is_withdrawal", F.struct("ts", "update_id")).alias("w")).collect()}
    assert all(last[f"20.{i}.0.0/16"] == (i % 2 == 0) for i in range(100))
    assert {r[0].microsecond for r in rows.select("event_time").collect()} == {100000, 500000, 900000}


def test_kafka_values(spark):
    texts = ['{"ts": 5, "prefix": "1.0.0.0/8", "host": "h"}', '{"ts": 5}', "binary", None]
    rows, rejected = feeds.kafka_rows(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert [(r.ts, r.prefix) for r in rows.collect()] == [(5, "1.0.0.0/8")]
    assert rejected.count() == 3


def test_day_summary_and_rpki_cache(spark, sf):
    root = tempfile.mkdtemp(prefix="routewatch-day-")
    e, d = X.load(spark, sf, "classified"), X.dims(spark, sf)
    st = SU.prefix_state(e)
    row = SU.summary(st, SU.flap_events(e), e, d, 1704076399, 1704067200)
    table = AL.merge_alerts(None, AL.alerts(AL.critical_events(e, d["as_info"])))
    sinks.write_day_summary(SU.day_summary(row, AL.recent_alerts(table, 1704076399)), f"{root}/day")
    day = spark.read.json(f"{root}/day").collect()
    assert len(day) == 1 and day[0].unique_prefixes == st.count() and len(day[0].classification_counts) == 8
    fresh = SU.rpki_counts(st, d["roas"])
    kept = sinks.cache_rpki_stats(fresh, f"{root}/rpki", spark).collect()
    assert sinks.cache_rpki_stats(None, f"{root}/rpki", spark).collect() == kept == fresh.collect()
