"""Update-by-update replay in plain Python: a second implementation, which takes nothing from the plans or the stream.

It keeps every prefix's past as a list and counts anew from it at each update, so it is slow and plain.
"""

import hashlib
from collections import defaultdict

COLS = ["update_id", "ts", "prefix", "asn", "peer_ip", "historical_asn", "classification", "old_classification", "incident_id",
        "incident_start_time", "leak_type", "leaker_asn", "victim_asn", "source", "lat", "lon", "city", "country", "num_flaps",
        "is_classified", "is_withdrawal", "state_class", "state_asn", "state_ts"]
BOGON, HIJACK, ROUTE_LEAK, OUTAGE, DDOS, FLAP, HUNTING, DISCOVERY, MINOR_LEAK = 1, 2, 3, 4, 5, 6, 8, 9, 10
RANK = {HIJACK: 100, OUTAGE: 90, ROUTE_LEAK: 80, BOGON: 70, MINOR_LEAK: 60, DDOS: 50, FLAP: 40, HUNTING: 30}
CRITICAL = {HIJACK, OUTAGE, ROUTE_LEAK, MINOR_LEAK}
LIFETIME = {OUTAGE: 1800, FLAP: 60}


def kin(row, known):
    same_org = known["org"] is not None and known["org"] == row["o_org"]
    same_brand = (known["brand"] or 0) & (row["o_brand"] or 0)
    return same_org or same_brand or known["asn"] in (row["o_kin"] or []) or row["origin_asn"] in (known["kin"] or [])


class Prefix:
    def __init__(self, name):
        self.name, self.past, self.events = name, [], []
        self.known = self.first = self.gone = self.incident = self.leak = self.behind_last = None
        self.cls, self.since, self.origin, self.checks = 0, 0, 0, []

    def put(self, **event):
        incident, leak = event.pop("incident"), event.pop("leak") or (None, None, None)
        event["incident_id"] = incident and hashlib.md5(f"{self.name}|{incident[0]}|{incident[1]}".encode()).hexdigest()
        event["leak_type"], event["leaker_asn"], event["victim_asn"] = leak
        self.events.append(str(tuple({**event, "prefix": self.name}[c] for c in COLS)))

    def check(self, until):
        while self.checks and (until is None or self.checks[0] <= until):
            at = self.checks.pop(0)
            asn, hist, place, ts = self.behind_last
            if self.gone is not None and at - self.gone >= 10 and self.cls != OUTAGE and asn:
                self.incident = self.incident or (OUTAGE, at)
                self.cls, self.since = OUTAGE, at
                self.put(**place, update_id=None, ts=at, asn=asn, peer_ip="synthetic", historical_asn=hist, classification=OUTAGE,
                         old_classification=0, incident=self.incident, incident_start_time=at, leak=None, source="timer", num_flaps=0,
                         is_classified=True, is_withdrawal=False, state_class=OUTAGE, state_asn=asn, state_ts=ts)

    def replayed(self, now):
        """Sessions and counts from the whole past; a session withdrawn for over an hour starts anew."""
        sessions, counts = {}, defaultdict(lambda: [0, 0, 0])
        for row in self.past:
            ts, key, count = row["ts"], (row["host"], row["peer"]), counts[row["ts"] // 60 * 60]
            old = sessions.get(key)
            if old and old["down"] and old["ts"] < ts - 3600:
                old = None
            if row["is_withdrawal"]:
                sessions[key] = {**(old or {"path": "", "len": 0, "origin": 0}), "ts": ts, "down": True}
                continue
            count[0] += old is not None and old["down"]
            if old is None or old["path"] != row["path_str"]:
                count[1] += 1
                count[2] += old is not None and row["path_len"] > old["len"]
            sessions[key] = {"path": row["path_str"], "len": row["path_len"], "origin": row["origin_asn"], "ts": ts, "down": False}
        sessions = {k: s for k, s in sessions.items() if not (s["down"] and s["ts"] < now - 3600)}
        return sessions, {m: c for m, c in counts.items() if m >= now - 600}

    def update(self, row):
        ts, origin, down = row["ts"], row["origin_asn"], row["is_withdrawal"]
        self.check(ts)
        if self.known is None:
            self.known = {"asn": row["historical_asn"], "org": row["h_org"], "brand": row["h_brand"], "kin": row["h_kin"]} if row["historical_asn"] else self.first
        hist = self.known["asn"] if self.known else 0
        self.past.append(row)
        sessions, counts = self.replayed(ts)
        if origin and not down:
            self.origin = origin
            if not hist and row["remember"]:
                self.first = {"asn": origin, "org": row["o_org"], "brand": row["o_brand"], "kin": row["o_kin"]}
        active = {k: s for k, s in sessions.items() if not s["down"]}
        hosts, everywhere = {h for h, _ in active}, {h for h, _ in sessions}
        cycle = int(bool(active) and self.gone is not None)
        self.gone = None if active else (ts if self.gone is None else self.gone)
        asn = origin or self.origin or hist
        flaps, changed, longer = (sum(c[i] for c in counts.values()) for i in range(3))
        dark = not active and len(sessions) >= 3 and ts - min(counts) > 30 and asn
        waited = dark and ts - self.gone >= 10
        found = set()
        if row["is_bogon"]:
            found.add(BOGON)
        if row["blackhole"] and len(hosts) >= 3:
            found.add(DDOS)
        if flaps >= 3 and len(everywhere) >= 2:
            found.add(FLAP)
        if longer >= 2 and changed >= 3 and len(hosts) >= 2:
            found.add(HUNTING)
        if waited:
            found.add(OUTAGE)
        if row["leak"] and len(hosts) >= 7:
            found.add(ROUTE_LEAK if len(hosts) >= 15 else MINOR_LEAK)
        if hist and origin not in (0, hist) and row["rpki_status"] != 1 and not kin(row, self.known):
            if len({h for (h, _), s in active.items() if s["origin"] == origin} | ({row["host"]} - hosts)) >= 5:
                found.add(HIJACK)
        best = max(found, key=RANK.get, default=0)
        own = (0, origin, hist) if best == HIJACK else tuple(row["leak"][c] for c in (
            "leak_type", "leaker_asn", "victim_asn")) if best in (ROUTE_LEAK, MINOR_LEAK) else None
        quiet, cls, old, incident, start, leak = self.live(ts, down, best, own, hist, cycle)
        place = {c: row[c] for c in ("lat", "lon", "city", "country")}
        last = self.origin or hist
        self.behind_last = (last, hist, place, ts)
        if dark and not waited and (not self.checks or self.checks[-1] != ts + 10):
            self.checks.append(ts + 10)
        shown = origin if quiet else asn
        self.put(**place, update_id=row["update_id"], ts=ts, asn=shown, historical_asn=0 if quiet else hist, classification=cls,
                 peer_ip="routeviews" if quiet and row["source"] == "routeviews" else row["peer"], old_classification=old,
                 incident=incident, incident_start_time=start, leak=leak, source=row["source"], num_flaps=cycle, is_classified=not quiet,
                 is_withdrawal=down, state_class=self.cls, state_asn=shown or last, state_ts=ts)

    def live(self, ts, down, best, own, hist, cycle):
        """(quiet, class, old class, incident, its start, leak) of an update, after the class has lived on."""
        before = self.cls
        if before == OUTAGE and down:
            self.since = ts
        if before and (ts - self.since > LIFETIME.get(before, 600) or (before == OUTAGE and not down)):
            self.cls = 0
        if best and best == before:
            self.since = ts
        elif best and (not before or RANK[best] > RANK[before]):
            shown, start = self.incident, self.since if before in CRITICAL or self.since else ts
            if best in CRITICAL:
                shown, start = (best, ts), ts
                self.incident = shown
            elif before in CRITICAL:
                self.incident = None
            self.cls, self.since, self.leak = best, ts, own or self.leak
            return False, best, before, shown, start, own
        leak = self.leak if self.leak and self.leak[0] else None
        if self.cls != before:
            shown, self.incident = self.incident, None
            return False, 0, before, shown, self.since, leak
        if before:
            shown = DISCOVERY if before in (HIJACK, ROUTE_LEAK, MINOR_LEAK) else before
            return False, shown, shown, self.incident, self.since, leak
        if not down and not hist:
            return False, DISCOVERY, 0, self.incident, self.since, None
        if cycle:
            return False, 0, 0, self.incident, self.since, None
        return True, 0, 0, None, 0, None


def replay(rows):
    prefixes = {}
    for row in sorted(rows, key=lambda r: (r["ts"], r["update_id"])):
        prefixes.setdefault(row["prefix"], Prefix(row["prefix"])).update(row)
    for p in prefixes.values():
        p.check(None)
    return sorted(e for p in prefixes.values() for e in p.events)


def batch_rows(events):
    out = []
    for r in events.collect():
        d = r.asDict(recursive=True)
        leak = d["leak_detail"] or {}
        d.update({c: leak.get(c) for c in ("leak_type", "leaker_asn", "victim_asn")})
        out.append(str(tuple(d[c] for c in COLS)))
    return sorted(out)
