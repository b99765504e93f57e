"""State of one prefix in the classifier stream: typed state variables and the counts kept in them.

Sessions are a map by (host, peer); how many of them a host has, and which hosts stand behind an
announced origin, are maps as well, so an update reads and writes the few entries it touches, however many
sessions there are. Scalars and the eleven minute buckets are one typed value.
"""

from typing import NamedTuple

from .. import constants as K
from ..plans.lifecycle import Life

PARTY = "struct<asn:bigint,org:string,brand:int,kin:array<bigint>>"
BUCKET = "struct<minute:bigint,withdrawn:bigint,announced:bigint,changed:bigint,longer:bigint,flaps:bigint>"
SESSION_DDL = "path string, length int, origin long, seen long, down boolean"
COUNTS_DDL = (f"active long, sessions long, hosts long, all_hosts long, last_origin long, gone long, known {PARTY}, own {PARTY}, "
              f"buckets array<{BUCKET}>, leaving array<bigint>, latest long")
LIFE_DDL = ("class_id int, since long, incident_class int, incident_ts long, leak_type int, leaker long, victim long, due array<bigint>, "
            "gone long, asn long, down long, historical long, lat double, lon double, city string, country string, update_ts long")


class Party(NamedTuple):
    """An ASN with what tells its kin."""

    asn: int
    org: str | None
    brand: int | None
    kin: list | None


class PrefixState:
    """The state variables of the prefix that is being worked on."""

    def __init__(self, handle):
        self.sessions = handle.getMapState("sessions", "host string, peer string", SESSION_DDL)
        self.host_counts = handle.getMapState("hosts", "host string", "active long, known long")
        self.behind = handle.getMapState("behind", "origin long, host string", "n long")
        self.origins = handle.getMapState("origins", "origin long", "hosts long")
        self.leaving = handle.getMapState("leaving", "second long", "sessions array<struct<host:string,peer:string>>")
        self.counts = handle.getValueState("counts", COUNTS_DDL)
        self.lives = handle.getValueState("life", LIFE_DDL)

    def load(self):
        kept = self.counts.get()
        (self.active, self.n_sessions, self.n_hosts, self.n_all_hosts, self.last_origin, self.gone, known, own, buckets, seconds, self.latest) = kept or (
            0, 0, 0, 0, 0, None, None, None, [], [], 0)
        self.known, self.own = (p and Party(*p) for p in (known, own))
        self.buckets = {b[0]: tuple(b[1:]) for b in buckets}
        self.seconds = list(seconds)
        life = self.lives.get()
        if life is None:
            self.life = Life()
        else:
            cls, since, i_class, i_ts, leak, leaker, victim, due, *last = life
            self.life = Life(cls, since, None if i_class is None else (i_class, i_ts), None if leak is None else (leak, leaker, victim), due,
                             None if last[-1] is None else tuple(last))

    def store(self):
        life = self.life
        self.counts.update((
            self.active, self.n_sessions, self.n_hosts, self.n_all_hosts, self.last_origin, self.gone, self.known and tuple(self.known), self.own and tuple(self.own),
            [(m, *b) for m, b in sorted(self.buckets.items())], self.seconds, self.latest))
        self.lives.update((life.cls, life.since, *(life.incident or (None, None)), *(life.leak or (None,) * 3), list(life.due), *(life.last or (None,) * 9)))

    def clear(self):
        """Forget the prefix."""
        for state in (self.counts, self.lives):
            state.clear()

    # -- sessions and their counts

    def _count(self, host, origin, down, by):
        active, known = self.host_counts.getValue((host,)) or (0, 0)
        self.n_sessions += by
        self.n_all_hosts += (known + by > 0) - (known > 0)
        if not down:
            self.active += by
            self.n_hosts += (active + by > 0) - (active > 0)
            n = (self.behind.getValue((origin, host)) or (0,))[0]
            hosts = (self.origins.getValue((origin,)) or (0,))[0] + (n + by > 0) - (n > 0)
            _put(self.behind, (origin, host), (n + by,))
            _put(self.origins, (origin,), (hosts,))
            active += by
        _put(self.host_counts, (host,), (active, known + by))

    def hosts_behind(self, origin):
        return (self.origins.getValue((origin,)) or (0,))[0]

    def is_active(self, host):
        return (self.host_counts.getValue((host,)) or (0, 0))[0] > 0

    def take(self, ts, host, peer, down, path, length, origin):
        """Move a session and count it: withdrawals, announcements, path changes, longer paths, flaps."""
        before = self.sessions.getValue((host, peer))
        if before is not None:
            self._count(host, before[2], before[4], -1)
        if down:
            now = ("", 0, 0, ts, True) if before is None else (*before[:3], ts, True)
            step = (1, 0, 0, 0, 0)
            self._leaves(ts, host, peer)
        else:
            now = (path, length, origin, ts, False)
            changed = before is None or before[0] != path
            step = (0, 1, int(changed), int(changed and before is not None and length > before[1]), int(before is not None and before[4]))
        self.sessions.updateValue((host, peer), now)
        self._count(host, now[2], down, 1)
        minute = ts // 60 * 60
        self.buckets[minute] = tuple(a + b for a, b in zip(self.buckets.get(minute, (0,) * 5), step))

    def _leaves(self, ts, host, peer):
        there = (self.leaving.getValue((ts,)) or ([],))[0]
        self.leaving.updateValue((ts,), ([*map(tuple, there), (host, peer)],))
        if not self.seconds or self.seconds[-1] < ts:
            self.seconds.append(ts)

    def forget(self, now):
        """Drop old buckets, and sessions withdrawn for over an hour."""
        self.buckets = {m: b for m, b in self.buckets.items() if m >= now - K.BUCKET_SECONDS}
        while self.seconds and self.seconds[0] < now - K.SESSION_RETENTION:
            second = self.seconds.pop(0)
            for host, peer in map(tuple, self.leaving.getValue((second,))[0]):
                session = self.sessions.getValue((host, peer))
                if session is not None and session[4] and session[3] == second:
                    self._count(host, session[2], True, -1)
                    self.sessions.removeKey((host, peer))
            self.leaving.removeKey((second,))


def _put(state, key, counts):
    """Store counts; none at all are not kept."""
    if any(counts):
        state.updateValue(key, counts)
    elif state.containsKey(key):
        state.removeKey(key)
