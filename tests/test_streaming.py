"""Streams give the batch results on the same rows."""

import tempfile

import pytest
from pyspark.sql import functions as F

from routewatch import fixtures as X
from routewatch.operators import tiles
from routewatch.plans import alerts as AL
from routewatch.plans import incidents as IN
from routewatch.plans import summary as SU
from routewatch.sources import sinks
from routewatch.streaming import live


@pytest.fixture(scope="module")
def folder(spark, sf):
    """Classified events in three files by time, and a last row that moves the watermark."""
    root = tempfile.mkdtemp(prefix="routewatch-live-")
    e = X.load(spark, sf, "classified")
    for i, (low, high) in enumerate(((0, 1704069000), (1704069000, 1704073000), (1704073000, 1 << 40))):
        e.filter((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.parquet(f"{root}/in/{i}")
    end = e.limit(1).withColumns({"ts": F.lit(1704076399 + 7200).cast("long"), "classification": F.lit(99),
                                  "old_classification": F.lit(99), "prefix": F.lit("end"), "num_flaps": F.lit(0).cast("long"),
                                  "is_withdrawal": F.lit(False), "lat": F.lit(1.0), "lon": F.lit(1.0),
                                  "country": F.lit("Z")})
    end.write.parquet(f"{root}/in/9")
    return root, e


def stream(spark, folder):
    root, e = folder
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(f"{root}/in")


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def same(a, b):
    cols = sorted(a.columns)
    key = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert key(a) == key(b)


def test_tiles(spark, folder):
    got = run(live.tiles_stream(stream(spark, folder)), "tiles").filter("classification <> 99")
    same(got, tiles.tiles(folder[1]))


def test_fine_tiles(spark, folder):
    got = run(live.fine_tiles_stream(stream(spark, folder)), "fine").filter("classification <> 99")
    same(got, tiles.fine_tiles(folder[1]))


def test_totals(spark, folder):
    got = run(live.totals_stream(stream(spark, folder)), "totals", "complete").filter("classification <> 99")
    same(got, folder[1].groupBy("source", "classification").agg(F.count("*").alias("msg_count")))


def test_rates(spark, folder):
    got = run(live.rates_stream(stream(spark, folder), 10), "rates").filter("classification <> 99")
    want = folder[1].withColumn("second", F.explode(F.sequence(F.col("ts") + 1, F.col("ts") + 10))).groupBy(
        "second", "classification").agg((F.count("*") / 10.0).alias("rate"))
    same(got, want)


def test_alert_windows(spark, folder):
    crit = stream(spark, folder).filter(F.col("classification").isin(2, 3, 4, 10, 99))
    got = run(live.alert_windows_stream(crit), "windows").filter("classification <> 99")
    e = folder[1].filter(F.col("classification").isin(2, 3, 4, 10) & F.col("country").isNotNull())
    t = e.withColumn("window_end", F.explode(F.sequence(
        F.floor(F.col("ts") / 60) * 60 + 60, F.floor(F.col("ts") / 60) * 60 + 300, F.lit(60).cast("long"))))
    want = t.groupBy("window_end", "country", "classification").agg(
        F.count("*").alias("events_count"), F.count(F.when(F.col("ts") >= F.col("window_end") - 60, 1)).alias("recent"))
    same(got.select(*want.columns), want)


def test_transitions(spark, folder):
    got = run(live.transitions_stream(stream(spark, folder)), "trans")
    want = IN.transitions(folder[1])
    ids = sorted(r.update_id for r in want.collect())
    assert sorted(r.update_id for r in got.collect()) == ids
    root = tempfile.mkdtemp(prefix="routewatch-transitions-")
    q = live.start_transitions(stream(spark, folder), root, f"{root}/c", availableNow=True)
    q.awaitTermination(180)
    assert q.exception() is None
    kept = spark.read.parquet(f"{root}/transitions").filter("prefix <> 'end'")
    assert sorted(r.update_id for r in kept.collect()) == ids


def test_tables_and_alerts(spark, folder):
    root = tempfile.mkdtemp(prefix="routewatch-tables-")
    q = live.start_tables(stream(spark, folder).filter("prefix <> 'end'"), root, f"{root}/c1", availableNow=True)
    q.awaitTermination(180)
    assert q.exception() is None
    cols = ["prefix", "last_update_ts", "classified_type", "origin_asn"]
    same(sinks.read_table(spark, f"{root}/prefix_state").select(*cols), SU.prefix_state(folder[1]).select(*cols))
    assert spark.read.parquet(f"{root}/flap_events").count() == SU.flap_events(folder[1]).count()


def test_alert_table(spark, folder):
    root = tempfile.mkdtemp(prefix="routewatch-alerts-")
    rows = [(i, 60 * m + i % 50, f"20.{i % 40}.0.0/16", "C", "N", 7, "net", "Org", 10.04, -20.06, 2)
            for m, n in ((100, 4), (101, 4), (102, 4), (103, 40), (104, 60)) for i in range(n)]
    crit = spark.createDataFrame(rows, "update_id long, ts long, prefix string, city string, country string, asn long, "
                                 "as_name string, org_name string, lat double, lon double, classification int")
    for i, (low, high) in enumerate(((0, 6200), (6200, 7000))):
        crit.filter((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.parquet(f"{root}/in/{i}")
    end = spark.createDataFrame([(10 ** 6, 50_000, "1.0.0.0/8", None, None, 1, "", None, 0.0, 0.0, 2)], crit.schema)
    for i in (2, 3):  # a tick is closed once the watermark has passed it
        end.coalesce(1).write.parquet(f"{root}/in/{i}")
    s = spark.readStream.schema(crit.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{root}/in")
    q = live.start_alerts(s, f"{root}/out", f"{root}/c", availableNow=True)
    q.awaitTermination(180)
    assert q.exception() is None
    got = sinks.read_table(spark, f"{root}/out/alerts")
    same(got.select("alert_key", "timestamp", "events_count"), AL.merge_alerts(None, AL.alerts(crit)).select(
        "alert_key", "timestamp", "events_count"))
