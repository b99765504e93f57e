"""Streaming classification in event-time order, over typed state.

Updates wait in a map by second until the watermark has passed their second; an event-time timer
releases them, in the order of their ids. So a prefix's updates are judged in the order of the batch
plan, however they arrive within the watermark's delay, and an update that is delivered twice counts once.
"""

import hashlib

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor

from .. import constants as K
from ..plans.lifecycle import CONTINUED, ENDED, ENTERED, QUIET
from ..plans.rules import rules
from .prefix_state import Party, PrefixState

#: Columns of an update as it waits. Of kin and leaks only what the rules ask for.
WAITING = ("update_id long, event_us long, host string, peer string, is_withdrawal boolean, origin_asn long, path_str string, path_len int, source string, "
           "lat double, lon double, city string, country string, historical_asn long, remember boolean, rpki_status int, is_bogon boolean, blackhole boolean, "
           "leak_type int, leaker_asn long, victim_asn long, o_org string, o_brand int, o_kin array<long>, h_org string, h_brand int, h_kin array<long>")
NAMES = [c.split()[0] for c in WAITING.split(", ")]
DETAILS = ["num_collectors", "num_peers", "num_withdrawals", "num_announcements", "flap_count"]
MADE = ("update_id long, ts long, event_us long, prefix string, asn long, peer_ip string, historical_asn long, classification int, "
        "old_classification int, incident_id string, incident_start_time long, leak_type int, leaker_asn long, victim_asn long, "
        + "".join(f"{c} long, " for c in DETAILS) +
        "source string, lat double, lon double, city string, country string, num_flaps long, is_classified boolean, is_withdrawal boolean, "
        "state_class int, state_asn long, state_ts long")
EVENT = Row(*[c.split()[0] for c in MADE.split(", ")])
WATERMARK = "10 minutes"


def _event(prefix, *, incident, leak, details, **values):
    values["incident_id"] = None if incident is None else hashlib.md5(f"{prefix}|{incident[0]}|{incident[1]}".encode()).hexdigest()
    values.update(zip(("leak_type", "leaker_asn", "victim_asn"), leak or (None,) * 3))
    values.update(zip(DETAILS, details or (None,) * 5))
    return EVENT(*[prefix if c == "prefix" else values[c] for c in EVENT])


def _related(row, known):
    """Whether the announced origin and the known one belong together."""
    listed = lambda group, asn: group is not None and asn in group
    return (listed(row.o_kin, known.asn) or listed(known.kin, row.origin_asn) or (known.org is not None and known.org == row.o_org)
            or bool((known.brand or 0) & (row.o_brand or 0)))


class PrefixProcessor(StatefulProcessor):
    """Keeps a prefix's updates until their time has come, judges them in order and moves its class on.

    Timers: the end of each second with waiting updates, with an outage check, or with sessions to be
    forgotten, and with ``idle`` the moment a prefix without sessions is forgotten.
    """

    def __init__(self, idle=None):
        self.idle = idle

    def init(self, handle):
        self.handle, self.state = handle, PrefixState(handle)
        self.waiting = handle.getMapState("waiting", "second long", f"updates array<struct<{WAITING.replace(' ', ':').replace(',:', ',')}>>")

    def _wake(self, second):
        """Come back once the watermark has passed a second."""
        self.handle.registerTimer((second + 1) * 1000)

    def handleInputRows(self, key, rows, timerValues):
        seconds = {}
        for row in rows:
            seconds.setdefault(row.ts, {})[row.update_id] = tuple(row[c] for c in NAMES)
        for second, new in seconds.items():
            there = self.waiting.getValue((second,))
            held = {u[0]: tuple(u) for u in there[0]} if there else {}
            self.waiting.updateValue((second,), (list({**new, **held}.values()),))
            self._wake(second)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, state = expiredTimerInfo.getExpiryTimeInMs() // 1000 - 1, self.state
        state.load()
        held, out = self.waiting.getValue((now,)), list(self._checks(key[0], now))
        if held:
            self.waiting.removeKey((now,))
            for update in sorted(map(tuple, held[0]), key=lambda u: u[0]):
                out += self._judge(key[0], now, WAITING_ROW(*update))
            for due in state.life.due:
                self._wake(due)
            if state.seconds and state.seconds[-1] == now:
                self._wake(now + K.SESSION_RETENTION + 1)
            state.latest = now
        state.forget(now)
        if self.idle is not None and not state.n_sessions and not state.life.due:
            if now >= state.latest + self.idle and not self.waiting.exists():
                state.clear()
                return iter(out)
            self._wake(state.latest + self.idle)
        state.store()
        return iter(out)

    def _checks(self, prefix, until):
        """Events of the outage checks due up to ``until``."""
        state = self.state
        for at, incident in state.life.checks(until):
            _, asn, down, hist, lat, lon, city, country, update_ts = state.life.last
            withdrawn = sum(b[0] for m, b in state.buckets.items() if m >= at - K.BUCKET_SECONDS)
            yield _event(prefix, update_id=None, ts=at, event_us=at * 1_000_000, asn=asn, peer_ip="synthetic", historical_asn=hist, classification=K.OUTAGE,
                         old_classification=K.NONE, incident=incident, incident_start_time=at, leak=None, details=(0, down, withdrawn, 0, 0), source="timer",
                         lat=lat, lon=lon, city=city, country=country, num_flaps=0, is_classified=True, is_withdrawal=False,
                         state_class=K.OUTAGE, state_asn=asn, state_ts=update_ts)

    def _judge(self, prefix, ts, row):
        """One update, after the checks due before it."""
        state, origin, down = self.state, row.origin_asn, row.is_withdrawal
        if state.known is None:  # the first origin found stays
            state.known = Party(row.historical_asn, row.h_org, row.h_brand, row.h_kin) if row.historical_asn else state.own
        known = state.known
        hist = known.asn if known else 0
        state.forget(ts)
        state.take(ts, row.host, row.peer, down, row.path_str, row.path_len, origin)
        if origin and not down:
            state.last_origin = origin
            if row.remember and not hist:
                state.own = Party(origin, row.o_org, row.o_brand, row.o_kin)
        cycle = int(state.active > 0 and state.gone is not None)
        state.gone = None if state.active else ts if state.gone is None else state.gone

        asn, withdrawn_sessions = origin or state.last_origin or hist, state.n_sessions - state.active
        withdrawn, announced, changed, longer, flaps = map(sum, zip(*state.buckets.values()))
        facts = {
            "foreign": bool(hist and origin and origin != hist and row.rpki_status != 1 and not _related(row, known)),
            "foreign_hosts": state.hosts_behind(origin) + (not state.is_active(row.host)),
            "dark": bool(not state.active and state.n_sessions >= 3 and ts - min(state.buckets) > 30 and asn),
            "waited": state.gone is not None and ts - state.gone >= K.OUTAGE_DELAY,
            "leak": row.leak_type is not None, "bogon": bool(row.is_bogon), "blackhole": bool(row.blackhole),
            "hosts": state.n_hosts, "all_hosts": state.n_all_hosts, "flaps": flaps, "longer": longer, "path_changes": changed,
        }
        best = next((code for code, holds in rules(facts) if holds), 0)
        leak = (0, origin, hist) if best == K.HIJACK else (row.leak_type, row.leaker_asn, row.victim_asn) if best in (K.ROUTE_LEAK, K.MINOR_LEAK) else None
        life = state.life
        kind, cls, old, incident, start, shown = life.step(ts, down, best, leak, hist, cycle)
        details = None
        if kind == ENTERED:
            details = {K.OUTAGE: (facts["hosts"], withdrawn_sessions, withdrawn, 0, 0),
                       K.FLAP: (facts["all_hosts"], state.n_sessions, withdrawn, announced, flaps)}.get(cls)
        if kind in (ENDED, CONTINUED) and shown is not None and shown[0] == 0:
            shown = None  # a hijack leaves no leak type behind
        last_asn, quiet = state.last_origin or hist, kind == QUIET
        life.last = (state.gone, last_asn, withdrawn_sessions, hist, row.lat, row.lon, row.city, row.country, ts)
        if facts["dark"] and not facts["waited"]:
            life.ask(ts)
        yield _event(prefix, update_id=row.update_id, ts=ts, event_us=row.event_us, asn=origin if quiet else asn,
                     peer_ip="routeviews" if quiet and row.source == "routeviews" else row.peer, historical_asn=0 if quiet else hist,
                     classification=cls, old_classification=old, incident=incident, incident_start_time=start, leak=shown, details=details,
                     source=row.source, lat=row.lat, lon=row.lon, city=row.city, country=row.country, num_flaps=cycle, is_classified=not quiet,
                     is_withdrawal=down, state_class=life.cls, state_asn=asn, state_ts=ts)

    def close(self):
        pass


WAITING_ROW = Row(*NAMES)


def classify_stream(enriched: DataFrame, watermark=WATERMARK, idle=None) -> DataFrame:
    """Events of a stream of enriched updates (``enrich``), in the columns of the batch plan and ``event_time``.

    They are those of the batch plan over all rows that arrive within the watermark's delay; later ones drop. An
    update's event comes out once the watermark has passed its second. A session withdrawn for an hour leaves the
    state. What remains of a prefix without sessions is one row of scalars, as an update after any pause still
    shows its class, its flap cycle and its last origin; with ``idle`` (seconds) that row leaves too, and a prefix that comes back
    later than that begins anew.
    """
    event_time = F.col("event_time") if "event_time" in enriched.columns else F.timestamp_seconds("ts")
    rows = enriched.withColumn("event_time", event_time).withWatermark("event_time", watermark)
    leak = lambda name: F.col(f"leak.{name}").alias(name)
    whole = rows.select(
        "prefix", "ts", "event_time", F.unix_micros("event_time").alias("event_us"), leak("leak_type"), leak("leaker_asn"), leak("victim_asn"),
        *[c for c in NAMES if c not in ("event_us", "leak_type", "leaker_asn", "victim_asn")])
    made = whole.groupBy("prefix").transformWithState(PrefixProcessor(idle), MADE, "Append", "EventTime")
    columns = []
    for name in EVENT:
        if name == "leak_type":
            columns.append(F.when(F.col("leak_type").isNotNull(), F.struct("leak_type", "leaker_asn", "victim_asn")).alias("leak_detail"))
        elif name == DETAILS[0]:
            columns.append(F.when(F.col("num_peers").isNotNull(), F.struct(*DETAILS)).alias("anomaly_details"))
        elif name not in ("event_us", "leaker_asn", "victim_asn", *DETAILS):
            columns.append(F.col(name))
    return made.select(*columns, F.timestamp_micros("event_us").alias("event_time"))
