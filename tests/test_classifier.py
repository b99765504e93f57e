"""Golden sequences of the class life cycle, and batch = sliced batch = replay = stream."""

import random
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F
from replay import COLS, batch_rows, replay

from routewatch import fixtures as X
from routewatch.operators.leaks import provider_edges
from routewatch.operators.networks import as_flags
from routewatch.plans.classify import classify, remembered_origins, with_historical
from routewatch.session import cut
from routewatch.streaming.classifier import classify_stream
from routewatch.streaming.enrich import enrich, start_enrich
from routewatch.streaming.prefix_state import PrefixState

SCHEMA = ("update_id long, ts long, prefix string, host string, peer string, is_withdrawal boolean, origin_asn long, "
          "path_str string, path_len int, comm_str string, source string, lat double, lon double, city string, country string")


def make(spark, prefix, rows):
    data = [(i, ts, prefix, h, p, w, 0 if w else o, "" if w else f"1 2 {o}", 0 if w else 3, comm, "test", 0.0, 0.0, None, None)
            for i, (ts, h, p, w, o, comm) in enumerate((*r, "")[:6] for r in rows)]
    return spark.createDataFrame(data, SCHEMA)


def seen(spark, prefix, asn):
    return {"seen": spark.createDataFrame([(prefix, asn)], "prefix string, origin_asn long")}


FLAP_ROWS = [(1000, "h1", "p1", False), (1000, "h2", "p2", False), (1001, "h1", "p1", True), (1001, "h2", "p2", True),
             (1002, "h1", "p1", False), (1002, "h2", "p2", False), (1003, "h1", "p1", True), (1004, "h1", "p1", False)]


def events(spark, prefix, rows, dims):
    out = classify(make(spark, prefix, rows), dims).filter("update_id is not null").collect()
    return {r.update_id: r for r in out}


def test_hijack_needs_five_hosts(spark):
    rows = [(1001 + i, f"host{i + 2}", f"{i + 2}.{i + 2}.{i + 2}.{i + 2}", False, 200) for i in range(5)]
    e = events(spark, "1.1.1.0/24", rows, seen(spark, "1.1.1.0/24", 100))
    assert [e[i].classification for i in range(4)] == [0, 0, 0, 0]
    assert e[4].classification == 2 and e[4].incident_id and tuple(e[4].leak_detail) == (0, 200, 100)


def test_hijack_below_a_remembered_prefix(spark):
    """A first origin answers for the prefixes inside it, as a base entry would."""
    outer = make(spark, "20.0.0.0/16", [(1000, "h0", "p0", False, 100)])
    inner = make(spark, "20.0.1.0/24", [(1001 + i, f"h{i}", f"p{i}", False, 200) for i in range(6)])
    rows = outer.unionByName(inner.withColumn("update_id", inner.update_id + 10))
    e = {r.update_id: r for r in classify(rows, seen(spark, "99.0.0.0/8", 7)).collect() if r.update_id is not None}
    assert e[0].classification == 9
    assert [e[i].classification for i in range(10, 16)] == [0, 0, 0, 0, 2, 9]
    assert (e[14].historical_asn, tuple(e[14].leak_detail)) == (100, (0, 200, 100))


def test_remembering_is_in_time_order(spark):
    """The inner prefix is announced first, so the outer one finds it at its own address."""
    def row(i, prefix, asn):
        return make(spark, prefix, [(1000 + i, "h", "p", False, asn)]).withColumn("update_id", F.lit(i).cast("long"))
    u = row(0, "20.0.0.0/24", 1).unionByName(row(1, "20.0.0.0/16", 2)).unionByName(row(2, "20.0.9.0/24", 3)).unionByName(
        row(3, "20.0.9.0/24", 4))
    got = {r.update_id: r.historical_asn for r in with_historical(u, seen(spark, "99.0.0.0/8", 7)["seen"]).collect()}
    # the outer one is known by the inner one and not remembered, so it answers for nobody
    assert got == {0: 0, 1: 1, 2: 0, 3: 3}
    new = remembered_origins(u, seen(spark, "99.0.0.0/8", 7)["seen"]).collect()
    assert sorted(map(tuple, new)) == [("20.0.0.0/24", 1), ("20.0.9.0/24", 3)]


def test_flap_cycles(spark):
    e = events(spark, "2.2.2.0/24", [(*r, 100) for r in FLAP_ROWS], {})
    assert not e[3].is_classified
    assert e[4].num_flaps == 1
    assert e[5].is_classified and e[5].num_flaps == 0 and e[5].classification != 6
    assert e[7].classification == 6 and e[7].num_flaps == 0
    assert e[7].anomaly_details.flap_count == 3


def test_priority(spark):
    rows = [(*r, 300) for r in FLAP_ROWS]
    rows += [(1010, f"h{i + 3}", f"p{i + 3}", False, 400) for i in range(5)]
    rows += [(1020, "h2", "p2", False, 400), (1020, "h3", "p3", False, 400), (1020, "h1", "p1", False, 400, "65535:666")]
    e = events(spark, "3.3.3.0/24", rows, seen(spark, "3.3.3.0/24", 300))
    assert e[7].classification == 6
    assert e[12].classification == 2 and e[12].old_classification == 6
    assert e[15].classification == 9 and e[15].incident_id == e[12].incident_id


def test_outage_check_and_recovery(spark):
    rows = [(1000 + i, f"h{i}", f"p{i}", False, 100) for i in range(3)]
    rows += [(1100 + i, f"h{i}", f"p{i}", True, 0) for i in range(3)] + [(1200, "h0", "p0", False, 100)]
    out = classify(make(spark, "4.4.4.0/24", rows), seen(spark, "4.4.4.0/24", 100)).collect()
    check = [r for r in out if r.source == "timer"]
    assert [(r.ts, r.classification, r.anomaly_details.num_peers, r.state_ts) for r in check] == [(1112, 4, 3, 1102)]
    back = next(r for r in out if r.update_id == 6)
    assert (back.classification, back.old_classification, back.incident_id) == (0, 4, check[0].incident_id)
    # a replay that ends before the check is due does not run it
    assert not classify(make(spark, "4.4.4.0/24", rows[:6]), seen(spark, "4.4.4.0/24", 100), now=1105).filter(
        "source = 'timer'").count()


@pytest.fixture(scope="module")
def case(spark, sf):
    u, dims = X.load(spark, sf, "updates").drop("pid"), X.dims(spark, sf)
    flags = cut(as_flags(dims["as_info"]))
    rich = cut(enrich(u, dims, cut(provider_edges(u, flags)), flags))
    expected = replay([r.asDict(recursive=True) for r in rich.collect()])
    return u, dims, rich, expected


def test_batch_equals_replay(case):
    u, dims, _, expected = case
    assert batch_rows(classify(u, dims)) == expected


def test_sliced_prefixes_equal_replay(case):
    """A prefix with a third of all rows, cut into slices of at most 100 rows."""
    u, dims, _, expected = case
    assert batch_rows(classify(u, dims, target_rows=100)) == expected


def test_enriched_stream_equals_replay(spark, case):
    """Micro-batches enriched one by one, stopped after the first file and started again."""
    u, dims, _, expected = case
    folder = tempfile.mkdtemp(prefix="routewatch-enrich-")
    parts = ((0, 1704069000), (1704069000, 1704072500), (1704072500, 1 << 40))
    for i, (low, high) in enumerate(parts):
        u.filter((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.parquet(f"{folder}/in/p{i}")
        if i == 1:
            continue
        s = spark.readStream.schema(u.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        q = start_enrich(s, dims, f"{folder}/out", f"{folder}/c", availableNow=True)
        q.awaitTermination(300)
        assert q.exception() is None
    rich = spark.read.parquet(f"{folder}/out/enriched").drop("batch")
    assert replay([r.asDict(recursive=True) for r in rich.collect()]) == expected


def arrivals(rich, folder, files, rng):
    """Files of rows that arrive up to 590 seconds late, some twice; and one of a prefix an hour after all others."""
    rows = [(r.ts + rng.randrange(591), rng.random(), r) for r in rich.collect()]
    rows += [(at + 1 + rng.randrange(5), x, r) for at, x, r in rows if x < 0.1 and at < r.ts + 580]
    rows.sort(key=lambda r: r[:2])
    size = -(-len(rows) // files)
    spark, schema = rich.sparkSession, rich.schema
    for i in range(files):
        spark.createDataFrame([r[2] for r in rows[i * size:(i + 1) * size]], schema).coalesce(1).write.parquet(f"{folder}/in/p{i}")
    end = max(r[2].ts for r in rows)
    return rich.limit(1).withColumns({"prefix": F.lit("199.0.0.0/24"), "ts": F.lit(end + 9000), "event_time": F.timestamp_seconds(F.lit(end + 9000)),
                                      "update_id": F.lit(-1).cast("long")})


def tails(last, folder):
    """Three more micro-batches: one moves the watermark, one runs the timers, and one those that were set meanwhile."""
    for i in range(3):
        last.withColumn("update_id", F.lit(-1 - i).cast("long")).coalesce(1).write.parquet(f"{folder}/in/q{i}")


def run_stream(spark, schema, folder, **options):
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    q = (classify_stream(s, **options).writeStream.format("parquet").option("path", f"{folder}/out")
         .option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination(600)
    assert q.exception() is None and not q.isActive
    return spark.read.parquet(f"{folder}/out").filter("prefix <> '199.0.0.0/24'")


def test_stream_of_late_rows_equals_replay(spark, case, few_partitions):
    """Rows out of order and twice over several micro-batches, with a restart in between; sessions leave the state."""
    _, _, rich, expected = case
    folder = tempfile.mkdtemp(prefix="routewatch-stream-")
    last = arrivals(rich, folder, 4, random.Random(7))
    run_stream(spark, rich.schema, folder)
    tails(last, folder)
    events = run_stream(spark, rich.schema, folder)
    assert batch_rows(events) == expected
    assert {"event_time", "leak_detail", "anomaly_details"} <= set(events.columns)
    known = {(r.key.prefix, r.user_map_key.host, r.user_map_key.peer): r.user_map_value for r in state_of(spark, folder, "sessions", flat=True)}
    end, sessions = rich.agg(F.max("ts")).first()[0], {}
    for r in sorted(rich.collect(), key=lambda r: (r.ts, r.update_id)):
        sessions[r.prefix, r.host, r.peer] = r.is_withdrawal
    # more than an hour has passed since the last withdrawal: only active sessions are left
    assert end and set(known) == {k for k, down in sessions.items() if not down}


def state_of(spark, folder, name, flat=False):
    reader = spark.read.format("statestore").option("path", f"{folder}/ckpt").option("stateVarName", name)
    return (reader.option("flattenCollectionTypes", "true") if flat else reader).load().collect()


def test_idle_prefixes_are_forgotten(spark, few_partitions):
    rows = [(1000, "h1", "p1", False, 100), (1005, "h2", "p2", False, 100), (1400, "h1", "p1", True, 0), (1410, "h2", "p2", True, 0)]
    u = make(spark, "6.6.6.0/24", rows).unionByName(make(spark, "7.7.7.0/24", rows[:3]).withColumn("update_id", F.col("update_id") + 100))
    flags = cut(as_flags(spark.createDataFrame([], "asn long, heg_v4 double, heg_v6 double, pop_pct double, pop_users long")))
    rich = cut(enrich(u, {}, cut(provider_edges(u, flags)), flags))
    folder = tempfile.mkdtemp(prefix="routewatch-idle-")
    last = arrivals(rich, folder, 1, random.Random(1))
    tails(last, folder)
    got = run_stream(spark, rich.schema, folder, idle=3600)
    assert batch_rows(got) == batch_rows(classify(u, {}))
    assert {r.key.prefix for r in state_of(spark, folder, "counts")} == {"7.7.7.0/24"}  # its session h2 is still active
    for name in ("sessions", "hosts", "behind", "origins", "leaving", "life"):
        assert "6.6.6.0/24" not in {r.key.prefix for r in state_of(spark, folder, name)}


class Kept(dict):
    """A state variable in memory."""

    def getValue(self, key):
        return super().get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    containsKey = dict.__contains__

    def get(self):
        return super().get("value")

    def update(self, value):
        self["value"] = value


class Handle:
    def getMapState(self, name, key, value):
        return Kept()

    getValueState = getMapState

    def __getattr__(self, name):
        raise AttributeError(name)


def test_running_session_counts():
    """Counts kept from update to update are those of the sessions there are, also after they were stored and read back."""
    handle = Handle()
    handle.getValueState = lambda name, ddl: Kept()
    r, state, sessions = random.Random(3), PrefixState(handle), {}
    state.load()
    for ts in range(0, 30_000, 10):
        host, peer, origin, down = f"h{r.randrange(4)}", f"p{r.randrange(3)}", r.randrange(3), r.random() < 0.4
        state.forget(ts)
        sessions = {k: s for k, s in sessions.items() if not (s[1] and s[2] < ts - 3600)}
        state.take(ts, host, peer, down, "p", 1, origin)
        before = sessions.get((host, peer), (0,))
        sessions[host, peer] = (before[0] if down else origin, down, ts)
        if r.random() < 0.2:
            state.store()
            state.load()
        up = {k: s for k, s in sessions.items() if not s[1]}
        assert (state.active, state.n_sessions) == (len(up), len(sessions)) and set(state.sessions) == set(sessions)
        assert (state.n_hosts, state.n_all_hosts) == (len({h for h, _ in up}), len({h for h, _ in sessions}))
        for o in range(3):
            assert state.hosts_behind(o) == len({h for (h, _), s in up.items() if s[0] == o})
    state.forget(100_000)
    assert {h for (h, _) in state.sessions} == {h for (h, _), s in sessions.items() if not s[1]}
