"""Alerts from a stream: scores per prefix in state, ticks closed by timers, cooldowns carried from batch to batch.

Chained steps, none of which looks at history: each prefix keeps the counts of the last six minutes
and its running mean and variance, and gives its share of a tick once the watermark has passed it. All prefixes
give theirs in the same micro-batch, so there a tick's groupings are complete; thresholds,
cooldown and the best of each type follow from its rows and a small table of the last alerts.
"""

import math

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor

from .. import constants as K
from ..operators.tiles import quantise
from ..plans import alerts as AL
from ..session import cut
from ..sources import sinks

NEWEST = 5
EVENT = "struct<ts:bigint,update_id:bigint,lat:double,lon:double>"
PLACE = ["asn", "as_name", "city", "country", "org_name", "lat_q", "lon_q", "classification"]
SHARE = Row("tick", "prefix", *PLACE, "n", "n_recent", "slat", "slon", "z", "newest")
SHARE_DDL = ("tick long, prefix string, asn long, as_name string, city string, country string, org_name string, lat_q int, lon_q int, classification int, "
             f"n long, n_recent long, slat double, slon double, z double, newest array<{EVENT}>")
HELD = ("asn:bigint,as_name:string,city:string,country:string,org_name:string,lat_q:int,lon_q:int,classification:int,last:boolean,"
        f"n:bigint,slat:double,slon:double,newest:array<{EVENT}>")
MINUTE = 60


def _newest(events):
    return sorted(events, key=lambda e: (e[0], e[1] is not None, e[1] or 0), reverse=True)[:NEWEST]


def folded(mean, var, counts):
    """Mean and variance after some finished minutes."""
    for count in counts:
        d = count - mean
        inc = round(1 - K.EWMA_ALPHA, 12) * d
        mean, var = mean + inc, K.EWMA_ALPHA * (var + d * inc)
    return mean, var


def score(count, mean, var):
    sd = math.sqrt(var)
    return max(count - mean, 0.0) if sd < K.EWMA_MIN_SD else (count - mean) / sd


class ShareProcessor(StatefulProcessor):
    """A prefix's share of each minute tick.

    Counts lie by minute, place and whether they are of the tick's own second, which two windows hold
    as their first or last one. A minute is dropped when no window can hold it any more, the running mean and variance
    an hour after the last event.
    """

    def init(self, handle):
        self.handle = handle
        self.minutes = handle.getMapState("minutes", "minute long", f"counts array<struct<{HELD}>>")
        self.running = handle.getValueState("running", "minute long, n long, mean double, var double")

    def handleInputRows(self, key, rows, timerValues):
        new = {}
        for row in rows:
            minute = row.ts // MINUTE * MINUTE
            place = (*(row[c] for c in PLACE), row.ts - minute == AL.TICK_SECOND)
            new.setdefault(minute, {}).setdefault(place, []).append((row.ts, row.update_id, row.lat, row.lon))
        for minute, places in new.items():
            there = self.minutes.getValue((minute,))
            counts = {tuple(c[:9]): (c[9], c[10], c[11], [tuple(e) for e in c[12]]) for c in there[0]} if there else {}
            for place, events in places.items():
                n, slat, slon, newest = counts.get(place, (0, 0.0, 0.0, []))
                counts[place] = (n + len(events), slat + sum(e[2] or 0.0 for e in events), slon + sum(e[3] or 0.0 for e in events), _newest(newest + events))
            self.minutes.updateValue((minute,), ([(*place, *count) for place, count in counts.items()],))
            for ahead in range(K.ALERT_WINDOW // MINUTE + 1):
                self._wake(minute + ahead * MINUTE)
            self._wake(minute + K.EWMA_RETENTION + 2 * MINUTE)
        return iter(())

    def _wake(self, minute):
        """Come back when the watermark has passed the tick of a minute."""
        self.handle.registerTimer((minute + AL.TICK_SECOND + 1) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        tick = expiredTimerInfo.getExpiryTimeInMs() // 1000 - 1
        minute = tick - AL.TICK_SECOND
        held = {m: self.minutes.getValue((m,)) for m in range(minute - K.ALERT_WINDOW, minute + 1, MINUTE)}
        held = {m: there[0] for m, there in held.items() if there}
        z = self._score(minute, sum(c[9] for c in held.get(minute, ())))
        total = {}
        for m, counts in held.items():
            for count in map(tuple, counts):
                place, last, (n, slat, slon, newest) = count[:8], count[8], count[9:]
                if m == minute - K.ALERT_WINDOW and not last:
                    continue
                recent = n if m == minute or (m == minute - K.ALERT_RECENT and last) else 0
                before = total.get(place, (0, 0, 0.0, 0.0, []))
                total[place] = (before[0] + n, before[1] + recent, before[2] + slat, before[3] + slon, _newest(before[4] + [tuple(e) for e in newest]))
        if minute - K.ALERT_WINDOW in held:
            self.minutes.removeKey((minute - K.ALERT_WINDOW,))
        return iter([SHARE(tick, key[0], *place, n, recent, slat, slon, z, newest) for place, (n, recent, slat, slon, newest) in total.items()])

    def _score(self, minute, n):
        """The score at the end of a minute with n events; None if neither it nor the one before has any."""
        last = self.running.get()
        if n:
            mean = var = 0.0
            if last is not None and minute - last[0] <= K.EWMA_RETENTION:
                mean, var = folded(last[2], last[3], [float(last[1])] + [0.0] * ((minute - last[0]) // MINUTE - 1))
            self.running.update((minute, n, mean, var))
            return score(n, mean, var)
        if last is None or last[0] > minute:
            return None
        if minute - last[0] > K.EWMA_RETENTION:
            self.running.clear()
        return score(0, last[2], last[3]) if last[0] == minute - MINUTE else None

    def close(self):
        pass


def alert_shares(critical: DataFrame, watermark="10 minutes") -> DataFrame:
    """What each prefix has in the window of each minute tick, from a stream of ``critical_events``.

    Without ``watermark`` the stream has one already.
    """
    rows = critical if "event_time" in critical.columns else critical.withColumn("event_time", F.timestamp_seconds("ts"))
    rows = rows if watermark is None else rows.withWatermark("event_time", watermark)
    rows = rows.withColumns({"lat_q": quantise("lat"), "lon_q": quantise("lon")})
    rows = rows.select("prefix", "ts", "update_id", "event_time", "lat", "lon", *PLACE)
    return rows.groupBy("prefix").transformWithState(ShareProcessor(), SHARE_DDL, "Append", "EventTime")


def alerts_of(shares: DataFrame, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Alerts of complete ticks, and the cooldown keys (cooldown_key, tick) that hold back later ones.

    ``before`` are the cooldown keys of earlier ticks.
    """
    rows = AL.grouped(shares)
    scores = shares.select("prefix", "tick", "z").distinct()
    candidates = cut(AL.passing(AL.measures(rows, scores)))
    held = candidates.withColumn("_held", F.lit(False))
    if before is not None:
        held = held.unionByName(before.withColumn("_held", F.lit(True)), allowMissingColumns=True)
    kept = cut(AL.cooled(held))
    last = kept.groupBy("cooldown_key").agg(F.max("tick").alias("tick"))
    found = cut(AL.shown(kept.filter(~F.col("_held")).drop("_held")))
    events = rows.withColumn("e", F.explode("newest")).drop("lat", "lon").withColumnRenamed("tick", "timestamp").select(
        *AL.GROUP, "timestamp", "prefix", *AL.FACTS, "org_name", "e.*")
    samples = AL.newest_events(events.join(found.select(*AL.GROUP, "timestamp"), [*AL.GROUP, "timestamp"], "left_semi"))
    return found.join(samples, [*AL.GROUP, "timestamp"], "left"), last


def start_alerts(critical: DataFrame, root: str, checkpoint: str, watermark="10 minutes", **trigger):
    """Keep the alert table ``root``/alerts from a stream of ``critical_events``: those of the last day, once each.

    The alerts are those of the batch plan over all rows within the watermark's delay. Each micro-batch
    looks at the ticks that it closes and at the last alert of each cooldown key.
    """
    def write(batch, batch_id):
        spark = batch.sparkSession
        shares = cut(batch)
        now = shares.agg(F.max("tick")).first()[0]
        if now is None:
            return
        found, last = alerts_of(shares, sinks.of_batch(spark, f"{root}/cooldown", batch_id))
        sinks.upsert_alerts(found, f"{root}/alerts", now)
        last.filter(F.col("tick") > now - K.ALERT_COOLDOWN).write.mode("overwrite").parquet(f"{root}/cooldown/batch={batch_id}")

    return alert_shares(critical, watermark).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
