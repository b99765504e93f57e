"""Streams of tiles, rates, totals and transitions, the tables fed from them, and the whole chain from feed to tables."""

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor

from .. import constants as K
from ..functions.ipaddr import ipv4_size, is_ipv4
from ..operators.tiles import fine_tiles, tiles
from ..plans.alerts import named_events
from ..plans.incidents import changes_class, transition_rows
from ..plans.summary import flap_events
from ..session import cut
from ..sources import sinks
from .alert_stream import start_alerts
from .classifier import classify_stream
from .enrich import enriched_schema, start_enrich


def _timed(events: DataFrame, delay="10 minutes") -> DataFrame:
    """With a watermark on the event's own time, to the microsecond where it is known."""
    events = events if "event_time" in events.columns else events.withColumn("event_time", F.timestamp_seconds("ts"))
    return events.withWatermark("event_time", delay)


def _timed_only(events: DataFrame, condition) -> DataFrame:
    """Events for which ``condition`` holds, with the watermark of all events: a quiet class does not hold up its own timers.

    The condition names the event time, so Spark does not move it below the watermark.
    """
    return _timed(events).filter(F.when(F.col("event_time").isNotNull(), condition).otherwise(False))


def tiles_stream(events: DataFrame) -> DataFrame:
    """Event subscription: counts per half second, tile and class."""
    return tiles(_timed(events))


def fine_tiles_stream(events: DataFrame) -> DataFrame:
    return fine_tiles(_timed(events))


TOTAL_KEYS = ["source", "classification"]


def totals_stream(events: DataFrame) -> DataFrame:
    """Totals per source and class since the stream began (update mode); they survive restarts
    with the query's checkpoint."""
    return events.groupBy(*TOTAL_KEYS).agg(F.count("*").alias("msg_count"))


def start_totals(events: DataFrame, root: str, checkpoint: str, **trigger):
    """Keep ``root``/totals: each micro-batch replaces the totals it changed."""
    def write(batch, batch_id):
        sinks.upsert_totals(cut(batch), f"{root}/totals", TOTAL_KEYS)

    return totals_stream(events).writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(**trigger).start()


def rates_stream(events: DataFrame, w=60, by=("classification",)) -> DataFrame:
    """Messages per second over the last ``w`` seconds, at each second, per ``by`` (class, source, or nothing for the total).

    Rows are counted per second first; only these counts are copied into the ``w`` windows that hold them.
    """
    second = F.window("event_time", "1 second").alias("s")
    counts = _timed(events).groupBy(second, *by).agg(F.count("*").alias("n"))
    win = F.window(F.window_time("s"), f"{w} seconds", "1 second").alias("w")
    return counts.groupBy(win, *by).agg(F.sum("n").alias("n")).select(
        F.unix_timestamp("w.end").alias("second"), *by, (F.col("n") / F.lit(float(w))).alias("rate"))


def alert_windows_stream(critical: DataFrame, group="country") -> DataFrame:
    """Five-minute windows, every minute: events and address space of distinct prefixes per group."""
    win = F.window("event_time", "5 minutes", "1 minute")
    recent = F.col("ts") >= F.unix_timestamp("w.end") - K.ALERT_RECENT
    per = _timed(critical).filter(F.col(group).isNotNull()).withColumn("w", win).groupBy(
        "w", group, "classification", "prefix").agg(F.count("*").alias("n"), F.count(F.when(recent, 1)).alias("r"))
    per = per.withColumn("win", F.window(F.window_time("w"), "1 minute"))
    return per.groupBy("win", group, "classification").agg(
        F.sum("n").alias("events_count"), F.sum("r").alias("recent"),
        F.sum(F.when(is_ipv4("prefix"), ipv4_size(F.col("prefix"))).otherwise(0)).alias("impacted_ipv4_ips"),
        F.count(F.when(~is_ipv4("prefix"), 1)).alias("impacted_ipv6_prefixes")).select(
        F.unix_timestamp("win.end").alias("window_end"), group, "classification", "events_count", "recent",
        "impacted_ipv4_ips", "impacted_ipv6_prefixes")


def _plain(value):
    """Rows within a value as tuples, as state variables take them."""
    return tuple(map(_plain, value)) if isinstance(value, tuple) else [*map(_plain, value)] if isinstance(value, list) else value


class ChangeProcessor(StatefulProcessor):
    """Lets a key's rows through in event-time order, at most one in ``seconds``; the last time is forgotten after an hour."""

    def __init__(self, schema, seconds):
        self.kind, self.names, self.seconds = schema.simpleString(), schema.names, seconds

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "second long", f"rows array<{self.kind}>")
        self.last = handle.getValueState("last", "second long")

    def handleInputRows(self, key, rows, timerValues):
        seconds = {}
        for row in rows:
            seconds.setdefault(row.ts, []).append(tuple(_plain(row[c]) for c in self.names))
        for second, new in seconds.items():
            there = self.waiting.getValue((second,))
            self.waiting.updateValue((second,), ([*map(_plain, there[0] if there else []), *new],))
            self.handle.registerTimer((second + 1) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000 - 1
        held, last = self.waiting.getValue((now,)), self.last.get()
        if last is not None and now - last[0] >= 3600:
            self.last.clear()
            last = None
        if not held:
            return iter(())
        self.waiting.removeKey((now,))
        if last is not None and now - last[0] < self.seconds:
            return iter(())
        self.last.update((now,))
        self.handle.registerTimer((now + 3601) * 1000)
        at = self.names.index("update_id")
        first = min(map(_plain, held[0]), key=lambda r: (r[at] is None, r[at] or 0))
        return iter([Row(*self.names)(*first)])  # later ones of the second come too soon


def changes_stream(events: DataFrame, seconds=300) -> DataFrame:
    """Class changes within an incident, at most one per (prefix, ASN) in 300 s, in event-time order; the columns of ``events``."""
    rows = _timed_only(events, changes_class())
    columns = [c for c in rows.columns if c != "event_time"]
    schema = rows.select(*columns).schema
    return rows.groupBy("prefix", "asn").transformWithState(ChangeProcessor(schema, seconds), schema, "Append", "EventTime")


def transitions_stream(events: DataFrame, target_states=None, seconds=300) -> DataFrame:
    """``changes_stream``, those that enter or leave one of ``target_states`` if any are named."""
    rows = changes_stream(events, seconds)
    want = list(target_states or [])
    return rows.filter(F.col("classification").isin(want) | F.col("old_classification").isin(want)) if want else rows


def start_tables(events: DataFrame, root: str, checkpoint: str, **trigger):
    """Keep prefix state, flap events and critical rows as tables fed from a stream of events.

    A repeated micro-batch writes the same rows again: state is replaced, and appended rows are
    written to a folder per batch.
    """
    def write(batch, batch_id):
        batch = cut(batch)
        sinks.upsert_prefix_state(batch, f"{root}/prefix_state")
        flap_events(batch).write.mode("overwrite").parquet(f"{root}/flap_events/batch={batch_id}")
        batch.filter(F.col("classification").isin(K.CRITICAL)).write.mode("overwrite").parquet(
            f"{root}/critical/batch={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def start_transitions(events: DataFrame, root: str, checkpoint: str, dims: dict | None = None, **trigger):
    """Keep the transitions as a table, a folder per micro-batch; with AS data in ``dims`` they carry names and RPKI."""
    def write(batch, batch_id):
        transition_rows(cut(batch), dims).write.mode("overwrite").parquet(f"{root}/transitions/batch={batch_id}")

    return changes_stream(events).writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(**trigger).start()


def start_pipeline(updates: DataFrame, dims: dict, root: str, checkpoint: str, **trigger):
    """From a stream of updates to all tables: enriched updates, events, state, flaps, transitions, alerts, totals.

    ``root`` gets a folder per table and ``checkpoint`` one per query. The enriched updates and the events are tables
    that the next queries stream from. Returns the running queries; with ``availableNow`` each one has ended before
    the next begins, so a call takes in all that is there.
    """
    spark, queries = updates.sparkSession, []

    def run(query):
        queries.append(query)
        if trigger.get("availableNow") or trigger.get("once"):
            query.awaitTermination()
        return query

    def streamed(name, schema):
        files, at = sinks._files(f"{root}/{name}")
        files.create_dir(at)
        return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/{name}")

    run(start_enrich(updates, dims, root, f"{checkpoint}/enrich", **trigger))
    rich = enriched_schema(updates, dims)
    events = classify_stream(streamed("enriched", rich))
    run(events.writeStream.format("parquet").option("path", f"{root}/events").option("checkpointLocation", f"{checkpoint}/events").trigger(**trigger).start())
    made = lambda: streamed("events", events.schema)
    run(start_tables(made(), root, f"{checkpoint}/tables", **trigger))
    run(start_transitions(made(), root, f"{checkpoint}/transitions", dims, **trigger))
    critical = named_events(_timed_only(made(), F.col("classification").isin(K.CRITICAL)), dims.get("as_info"))
    run(start_alerts(critical, root, f"{checkpoint}/alerts", watermark=None, **trigger))
    run(start_totals(made(), root, f"{checkpoint}/totals", **trigger))
    return queries
