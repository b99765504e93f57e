"""The class life cycle of one prefix: the only part that must run update by update.

Everything an update is judged by (its best candidate class, session counts, leak detail) is
already a column. What is left is a few scalars per prefix, moved from one row to the next. The
batch plan and the stream share ``Life``.
"""

from .. import constants as K

BAD = set(K.CRITICAL)
QUIET, ENTERED, ENDED, CONTINUED, DISCOVERED, CYCLED = range(6)


class Life:
    """Class, its time, open incident and last leak of one prefix, with pending outage checks.

    ``touched`` names what the rows seen so far have set by themselves, so that a slice of a hot
    prefix knows what it passes on unchanged.
    """

    __slots__ = ("cls", "since", "incident", "leak", "due", "last", "touched")

    def __init__(self, cls=0, since=0, incident=None, leak=None, due=(), last=None):
        self.cls, self.since, self.incident, self.leak = cls, since, incident, leak
        self.due, self.last, self.touched = list(due), last, set()

    def step(self, ts, withdrawn, cand, cand_leak, historical, cycle):
        """Take one update; returns (kind, class, old class, incident, start, leak)."""
        old = self.cls
        if withdrawn and old == K.OUTAGE:
            self._set(old, ts)
        if self.cls and (ts - self.since > K.EXPIRY.get(self.cls, K.EXPIRY_DEFAULT)
                         or (self.cls == K.OUTAGE and not withdrawn)):
            self._set(0, self.since)
        if cand:
            if old and K.PRIORITY[cand] < K.PRIORITY[old]:
                pass
            elif cand == old:
                self._set(self.cls, ts)
            else:
                return self._enter(ts, old, cand, cand_leak)
        if self.cls != old:
            out = (ENDED, self.cls, old, self.incident, self.since, self.leak)
            self._open(None)
            return out
        if self.cls:
            shown = K.DISCOVERY if self.cls in (K.ROUTE_LEAK, K.MINOR_LEAK, K.HIJACK) else self.cls
            return (CONTINUED, shown, shown, self.incident, self.since, self.leak)
        if not withdrawn and not historical:
            return (DISCOVERED, K.DISCOVERY, K.NONE, self.incident, self.since, None)
        if cycle:
            return (CYCLED, K.NONE, K.NONE, self.incident, self.since, None)
        return (QUIET, K.NONE, K.NONE, None, 0, None)

    def _set(self, cls, since):
        self.cls, self.since = cls, since
        self.touched.add("state")

    def _open(self, incident):
        self.incident = incident
        self.touched.add("incident")

    def _enter(self, ts, old, cand, cand_leak):
        # An incident opens on every entry into a bad class, and its id goes out once more with
        # the row that leaves for a harmless class.
        if cand in BAD:
            self._open((cand, ts))
            shown, start = self.incident, ts
        else:
            shown = self.incident
            start = self.since if (old in BAD or self.since) else ts
            if old in BAD:
                self._open(None)
        self._set(cand, ts)
        if cand_leak is not None:
            self.leak = cand_leak
            self.touched.add("leak")
        # The row itself carries only the leak found on it.
        return (ENTERED, cand, old, shown, start, cand_leak)

    def ask(self, ts):
        """Ask for an outage check ten seconds from now."""
        if not self.due or self.due[-1] != ts + K.OUTAGE_DELAY:
            self.due.append(ts + K.OUTAGE_DELAY)

    def checks(self, until):
        """Run the checks due up to ``until``; yields (ts, incident) of each outage found.

        ``last`` is what the latest update left behind: (fw_ts, asn, ...).
        """
        while self.due and (until is None or self.due[0] <= until):
            at = self.due.pop(0)
            gone, asn = self.last[0], self.last[1]
            if gone is None or at - gone < K.OUTAGE_DELAY or self.cls == K.OUTAGE or not asn:
                continue
            if self.incident is None:
                self._open((K.OUTAGE, at))
            self._set(K.OUTAGE, at)
            yield at, self.incident
