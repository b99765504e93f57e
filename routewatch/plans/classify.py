"""Classification of updates.

``prepare`` judges every update with joins and running counts (detectors D1-D9 of the survey);
``classify_batch`` then runs the class life cycle over the judged rows and returns one event per
update, plus the outages found by the ten-second check.
"""

import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .. import constants as K
from ..functions.paths import is_blackhole
from ..operators.bogons import bogon_flag
from ..operators.leaks import leak_patterns
from ..operators.networks import as_flags, siblings
from ..operators.prefix_join import covering_pairs, lpm_join
from ..operators.rpki import rpki_status
from ..operators.scan import CHUNK, SLICE, Running, find_hot, place, running, split_hot
from ..operators.sessions import prefix_counts, session_changes
from ..session import cut, small
from .lifecycle import CONTINUED, ENDED, ENTERED, QUIET, Life
from .rules import rules

UPDATE_COLS = ["update_id", "ts", "prefix", "host", "peer", "is_withdrawal", "origin_asn", "path_str",
               "path_len", "comm_str", "source", "lat", "lon", "city", "country"]
DETAILS = ["num_collectors", "num_peers", "num_withdrawals", "num_announcements", "flap_count"]


def _announced(updates: DataFrame, seen: DataFrame) -> DataFrame:
    """Per prefix: base origin by longest match (0: none), place and origin of its first announcement."""
    first = F.when(~F.col("is_withdrawal") & (F.col("origin_asn") != 0), F.struct("ts", "update_id"))
    facts = updates.groupBy("prefix").agg(
        F.min(first).alias("first_at"), F.min_by("origin_asn", first).alias("first_origin"))
    base = seen.select("prefix", F.col("origin_asn").alias("base_origin")).withColumnRenamed("prefix", "_sp")
    facts = lpm_join(facts, "prefix", base, ["base_origin"], prefix_col="_sp").drop("match_len")
    return facts.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("base_origin", "first_origin")})


def _pairs(facts: DataFrame) -> DataFrame:
    """(prefix, cover, cover_len, at, asn, own_at) among prefixes without a base origin: every cover
    that was announced and whose range holds the prefix's address, itself included."""
    unknown = facts.filter("base_origin = 0").select("prefix", F.col("first_at").alias("own_at"), F.col("first_origin").alias("asn"))
    covers = unknown.filter("asn <> 0").withColumnRenamed("own_at", "at")
    return cut(covering_pairs(unknown, covers, ["at", "asn"], within=False).join(unknown.drop("asn"), "prefix"))


def _answering(pairs: DataFrame) -> DataFrame:
    """The pairs whose cover is remembered: no remembered prefix answered for it before it was announced.

    A cover waits for those that hold its address and were announced before; covers that wait for
    none are remembered and rule out the ones that wait for them. Every round settles the front of
    all chains, which are no longer than prefixes nest.
    """
    edges = pairs.filter("own_at is not null and at < own_at").select("prefix", "cover")
    edges = cut(edges)
    gone = None
    while not edges.isEmpty():
        free = edges.select("cover").join(edges.select(F.col("prefix").alias("cover")), "cover", "left_anti").distinct()
        out = cut(edges.join(free, "cover", "left_semi").select(F.col("prefix").alias("cover")).distinct())
        gone = out if gone is None else gone.unionByName(out)
        ruled = out.withColumnRenamed("cover", "prefix")
        edges = cut(edges.join(free, "cover", "left_anti").join(out, "cover", "left_anti").join(ruled, "prefix", "left_anti"))
    return pairs if gone is None else pairs.join(gone, "cover", "left_anti")


def remembered_origins(updates: DataFrame, seen: DataFrame) -> DataFrame:
    """(prefix, origin_asn) that these updates add to the table of known origins."""
    return _answering(_pairs(cut(_announced(updates, seen)))).filter("cover = prefix").select(
        "prefix", F.col("asn").alias("origin_asn"))


def historical_origin(updates: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Per prefix: base origin by longest match, else the remembered origin and after which update it holds.

    The first origin announced for a prefix nobody knows is remembered like a base entry, so it also
    answers for prefixes below it. A prefix keeps the first origin found for it: the longest match at
    its first update for which there is one. Without a seen table nothing is remembered.
    """
    zero = F.lit(0).cast("long")
    if seen is None:
        return updates.groupBy("prefix").agg(F.min(F.struct("ts", "update_id")).alias("first_at")).select(
            "prefix", zero.alias("base_origin"), zero.alias("first_origin"), "first_at")
    facts = cut(_announced(updates, seen))
    found = _answering(_pairs(facts))
    known = found.groupBy("prefix").agg(F.min("at").alias("known_at"), F.count("*").alias("n"))
    # Only where several entries answer does it matter which were there at the first update after.
    several = cut(known.filter("n > 1").select("prefix", "known_at"))
    start = updates.join(small(several), "prefix").filter(F.struct("ts", "update_id") > F.col("known_at")).groupBy(
        "prefix").agg(F.min(F.struct("ts", "update_id")).alias("start"))
    found = found.join(start, "prefix", "left").filter("start is null or at < start")
    answer = found.groupBy("prefix").agg(
        F.min("at").alias("first_at"), F.max_by("asn", "cover_len").alias("first_origin"))
    return facts.select("prefix", "base_origin").join(answer, "prefix", "left").withColumn(
        "first_origin", F.coalesce("first_origin", zero))


def _as_of_update(updates: DataFrame, facts: DataFrame) -> DataFrame:
    df = updates.join(facts, "prefix", "left")
    own = F.when(F.col("first_at") < F.struct("ts", "update_id"), F.col("first_origin"))
    return df.withColumn("historical_asn", F.when(F.col("base_origin") != 0, F.col("base_origin")).otherwise(
        F.coalesce(own, F.lit(0).cast("long")))).drop("first_at", "base_origin", "first_origin")


def with_historical(updates: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Add historical_asn as of each update: the base entry, else the origin remembered earlier."""
    return _as_of_update(updates, historical_origin(updates, seen))


def suspects(updates: DataFrame, facts: DataFrame, dims: dict) -> DataFrame:
    """(prefix, origin) pairs that may be a hijack: foreign, no sibling, not RPKI-valid."""
    known = facts.select("prefix", F.when(F.col("base_origin") != 0, F.col("base_origin")).otherwise(
        F.col("first_origin")).alias("known_origin")).filter("known_origin <> 0")
    pairs = updates.filter("origin_asn <> 0").select("prefix", "origin_asn").distinct().join(known, "prefix")
    pairs = cut(pairs.filter("origin_asn <> known_origin"))
    if dims.get("as_info") is not None:
        pairs = siblings(pairs, dims["as_info"], dims["as_siblings"], "origin_asn", "known_origin").filter(
            "not is_sibling").drop("is_sibling")
    pairs = rpki_status(cut(pairs), dims.get("roas"), "origin_asn")
    return cut(pairs.filter("rpki_status <> 1").select("prefix", "origin_asn"))


def foreign_hosts(changes: DataFrame, pairs: DataFrame, hot=None) -> DataFrame:
    """For updates with a suspect origin: hosts with an active session that announces it."""
    leave = F.struct(F.lit(0).alias("o"), F.col("active_origin").alias("asn"), F.lit(-1).cast("long").alias("d"))
    enter = F.struct(F.lit(1).alias("o"), F.col("origin_asn").alias("asn"),
                     (~F.col("is_withdrawal")).cast("long").alias("d"))
    rows = changes.select("prefix", "host", "ts", "update_id", SLICE, CHUNK,
                          F.explode(F.array(leave, enter)).alias("e"))
    rows = rows.select("prefix", "host", "ts", "update_id", SLICE, CHUNK, "e.o", "e.d",
                       F.col("e.asn").alias("origin_asn")).filter("origin_asn <> 0")
    rows = rows.join(small(pairs), ["prefix", "origin_asn"], "left_semi")
    order = ["ts", "update_id", "o"]
    rows = running(rows, ["prefix", "origin_asn", "host"], order, {"n": Running("sum", F.col("d"))}, hot)
    flip = (F.col("n") > 0).cast("long") - (F.col("n") - F.col("d") > 0).cast("long")
    rows = running(rows.withColumn("f", flip), ["prefix", "origin_asn"], order,
                   {"foreign_hosts": Running("sum", F.col("f"))}, hot)
    return rows.filter("o = 1").select("prefix", "ts", "host", "update_id", "foreign_hosts")


def _counted(rows: DataFrame, pairs: DataFrame, hot=None) -> DataFrame:
    """Session, host and prefix counts after each update, and the hosts behind a suspect origin."""
    changes = session_changes(rows, hot)
    if hot is not None:
        changes = cut(changes)
    return prefix_counts(changes, hot).join(
        foreign_hosts(changes, pairs, hot), ["prefix", "ts", "host", "update_id"], "left")


def prepare(updates: DataFrame, dims: dict, target_rows=2_000_000):
    """Judge every update: its best candidate class and all the life cycle needs.

    ``dims`` may hold seen, roas, bogons, as_info and as_siblings; what is missing is not used.
    Prefixes with more than ``target_rows`` updates are worked on in time slices.
    """
    hot = find_hot(updates, target_rows=target_rows)
    if hot is not None:
        hot = cut(hot)
    timed = [c for c in ("event_time",) if c in updates.columns]
    updates = updates.select(*UPDATE_COLS, *timed)
    # Prefix-, pair- and path-sized tables are reduced from the updates once and written out, so
    # that they are computed once and the long plan below starts from plain tables.
    facts = cut(bogon_flag(cut(historical_origin(updates, dims.get("seen"))), dims.get("bogons")))
    pairs = suspects(updates, facts, dims)
    if dims.get("as_info") is not None:
        flags = cut(as_flags(dims["as_info"]))
    else:
        flags = as_flags(updates.sparkSession.createDataFrame(
            [], "asn long, heg_v4 double, heg_v6 double, pop_pct double, pop_users long"))
    # Hot prefixes are taken out before the join with the facts by prefix; their own facts are few.
    cold_rows, hot_rows = split_hot(updates, hot)
    df = _counted(_as_of_update(cold_rows, small(facts)), pairs)
    if hot_rows is not None:
        hot_facts = small(cut(facts.join(small(hot.select("prefix")), "prefix", "left_semi")))
        df = df.unionByName(_counted(_as_of_update(hot_rows, hot_facts), pairs, hot))
    df = leak_patterns(df, updates, flags, when=F.col("n_hosts") >= 7)

    zero = F.lit(0).cast("long")
    origin, hist = F.col("origin_asn"), F.col("historical_asn")
    n_withdrawn = F.col("n_known") - F.col("n_active")
    # The message's own host counts too when none of its sessions is active.
    hosts = F.coalesce("foreign_hosts", zero) + (F.col("host_active") == 0).cast("long")
    foreign = F.col("foreign_hosts").isNotNull() & (hist != 0) & (origin != 0) & (origin != hist)
    resolved = F.when(origin != 0, origin).when(F.col("last_origin") != 0, F.col("last_origin")).otherwise(hist)
    dark = ((F.col("n_known") >= 3) & (F.col("n_active") == 0) & F.col("elapsed_30") & (resolved != 0))
    waited = F.col("ts") - F.col("fw_ts") >= K.OUTAGE_DELAY
    facts = {
        "foreign": foreign, "foreign_hosts": hosts, "dark": dark, "waited": waited, "leak": F.col("leak").isNotNull(),
        "bogon": F.coalesce(F.col("is_bogon"), F.lit(False)), "blackhole": is_blackhole(F.col("comm_str")),
        "hosts": F.col("n_hosts"), "all_hosts": F.col("n_all_hosts"), "flaps": F.col("flap_10m"),
        "longer": F.col("len_inc_10m"), "path_changes": F.col("path_change_10m")}
    cand = F
    for code, rule in rules(facts):
        cand = cand.when(rule, F.lit(code))
    df = df.withColumn("cand", cand.otherwise(F.lit(0)))
    is_leak = F.col("cand").isin(K.ROUTE_LEAK, K.MINOR_LEAK)
    own = F.struct(F.lit(0).alias("leak_type"), origin.alias("leaker_asn"), hist.alias("victim_asn"))
    out, flap = F.col("cand") == K.OUTAGE, F.col("cand") == K.FLAP
    none = F.lit(None).cast("long")
    df = df.withColumns({
        "cand_leak": F.when(is_leak, F.col("leak")).when(F.col("cand") == K.HIJACK, own),
        "needs_check": dark & ~waited,
        "asn": resolved,
        "last_asn": F.when(F.col("last_origin") != 0, F.col("last_origin")).otherwise(hist),
        "n_withdrawn": n_withdrawn,
        "num_collectors": F.when(out, F.col("n_hosts")).when(flap, F.col("n_all_hosts")).otherwise(none),
        "num_peers": F.when(out, n_withdrawn).when(flap, F.col("n_known")).otherwise(none),
        "num_withdrawals": F.when(out | flap, F.col("wd_10m")).otherwise(none),
        "num_announcements": F.when(out, zero).when(flap, F.col("ann_10m")).otherwise(none),
        "flap_count": F.when(out, zero).when(flap, F.col("flap_10m")).otherwise(none),
    })
    cols = ["prefix", SLICE, CHUNK, "ts", "update_id", "is_withdrawal", "cand", "cand_leak", "needs_check",
            "fw_ts", "asn", "last_asn", "historical_asn", "flap_cycle", "n_withdrawn", "wd_10m",
            "wd_10m_next", *DETAILS, "host", "peer", "source", "origin_asn", "lat", "lon", "city", "country", *timed]
    return df.select(*(cols if hot is not None else [c for c in cols if c != SLICE]))


# ---------------------------------------------------------------------------------------------
# Life cycle over sorted Arrow batches

READ = ["prefix", CHUNK, "ts", "is_withdrawal", "cand", "cand_leak", "needs_check", "fw_ts", "last_asn",
        "historical_asn", "flap_cycle", "n_withdrawn", "wd_10m", "wd_10m_next", "carry", "is_last"]
MADE = [("kind", pa.int32()), ("classification", pa.int32()), ("old_classification", pa.int32()),
        ("state_class", pa.int32()), ("incident_class", pa.int32()), ("incident_ts", pa.int64()),
        ("incident_start_time", pa.int64()), ("leak_type", pa.int32()), ("leaker_asn", pa.int64()),
        ("victim_asn", pa.int64()), ("state_ts", pa.int64())]
MADE_DDL = ("kind int, classification int, old_classification int, state_class int, incident_class int, "
            "incident_ts long, incident_start_time long, leak_type int, leaker_asn long, victim_asn long, state_ts long")
CHECK = -1  # kind of a row made by the outage check


def _made(kind, cls, old, state, incident, start, leak, state_ts):
    if kind in (ENDED, CONTINUED) and leak is not None and leak[0] == 0:
        leak = None  # a hijack leaves no leak type behind
    return (kind, cls, old, state, *(incident or (None, None)), start, *(leak or (None, None, None)), state_ts)


def _edge(ts):
    """First minute that still counts at ``ts``."""
    return -((K.BUCKET_SECONDS - ts) // 60)


class Replay:
    """Runs ``Life`` over Arrow batches sorted by (prefix, slice, ts, update_id).

    Held at any time: one group's scalars and the rows made for the current batch.
    """

    def __init__(self, now=None):
        self.now, self.place, self.life, self.is_last = now, None, None, True
        self.made, self.found, self.ends = [], [], []

    def over(self, batches):
        for batch in batches:
            self.made, self.found, self.ends = [], [], []
            names = batch.schema.names
            cols = [batch.column(names.index(c)).to_pylist() for c in READ]
            self.geo = batch.column(names.index("geo"))
            for i, row in enumerate(zip(*cols)):
                self._take(i, *row)
            self._settle()
            yield batch
        self.made, self.found, self.ends = [], [], []
        self._close()
        yield None

    def _settle(self):
        """Turn the place of the last row from a row number of this batch into values."""
        last = self.life.last if self.life else None
        if last is not None and isinstance(last[-1], int):
            self.life.last = (*last[:-1], self.geo[last[-1]].as_py())

    def _close(self):
        if self.place is None:
            return
        self._settle()
        if self.is_last:
            self._check(self.now)
        self.ends.append((self.place, self.life))

    def _check(self, until):
        life = self.life
        self._settle()
        for at, incident in life.checks(until):
            _, asn, n_wd, wd, wd_next, prev_ts, hist, geo = life.last
            # a minute of withdrawals may have left the look-back since the last update
            total = wd if _edge(at) == _edge(prev_ts) else wd_next
            self.found.append((self.place, at, asn, hist, n_wd, total, incident, geo, prev_ts))

    def _take(self, i, prefix, chunk, ts, wd, cand, leak, ask, fw, asn, hist, cycle, n_wd, w10, w10n,
              carry, is_last):
        if (prefix, chunk) != self.place:
            self._close()
            self.place, self.is_last = (prefix, chunk), is_last
            self.life = Life() if carry is None else restore(carry)
        life = self.life
        if life.due:
            self._check(ts)
        if leak is not None:
            leak = (leak["leak_type"], leak["leaker_asn"], leak["victim_asn"])
        kind, cls, old, incident, start, shown = life.step(ts, wd, cand, leak, hist, cycle)
        life.last = (fw, asn, n_wd, w10, w10n, ts, hist, i)
        if ask:
            life.ask(ts)
        self.made.append(_made(kind, cls, old, life.cls, incident, start, shown, ts))


def restore(carry) -> Life:
    c = json.loads(carry)
    as_tuple = lambda v: None if v is None else tuple(v)
    return Life(c["state"][0], c["state"][1], as_tuple(c["incident"]), as_tuple(c["leak"]), c["due"],
                as_tuple(c["last"]))


def _events(now, schema: T.StructType):
    """Partition function: every update with what the life cycle made of it, and outage checks."""
    names = [f.name for f in schema.fields]

    def run(batches):
        replay, target = Replay(now), None
        made_names = [n for n, _ in MADE]
        for batch in replay.over(batches):
            if batch is not None:
                kept = [n for n in names if n not in made_names]
                target = target or pa.schema(
                    [batch.schema.field(n) for n in kept] + [pa.field(n, t) for n, t in MADE])
                if replay.made:
                    arrays = [pa.array(c, t) for c, (_, t) in zip(zip(*replay.made), MADE)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(batch.schema.names.index(n)) for n in kept] + arrays, schema=target)
            if replay.found:
                rows = [_check_row(*f) for f in replay.found]
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in target.names} for r in rows],
                                                 schema=target)
    return run


def _check_row(place, at, asn, hist, n_wd, n_withdrawals, incident, geo, update_ts):
    made = dict(zip([n for n, _ in MADE], _made(CHECK, K.OUTAGE, K.NONE, K.OUTAGE, incident, at, None, update_ts)))
    return {"prefix": place[0], CHUNK: place[1], "ts": at, "asn": asn, "historical_asn": hist,
            "is_withdrawal": False, "flap_cycle": 0, "num_collectors": 0, "num_peers": n_wd,
            "num_withdrawals": n_withdrawals, "num_announcements": 0, "flap_count": 0,
            "peer": "synthetic", "source": "timer", **(geo or {}), **made}


SUMMARY_DDL = f"prefix string, {CHUNK} long, state string, incident string, leak string, due string, last string"


def _slice_ends(batches):
    """Partition function: per slice what it sets itself, as JSON; null where it sets nothing."""
    replay = Replay()
    schema = pa.schema([("prefix", pa.string()), (CHUNK, pa.int64())] + [
        (n, pa.string()) for n in ("state", "incident", "leak", "due", "last")])
    for _ in replay.over(batches):
        rows = [{
            "prefix": place[0], CHUNK: place[1],
            "state": json.dumps([life.cls, life.since]) if "state" in life.touched else None,
            "incident": json.dumps(life.incident) if "incident" in life.touched else None,
            "leak": json.dumps(life.leak) if "leak" in life.touched else None,
            "due": json.dumps(life.due), "last": json.dumps(life.last),
        } for place, life in replay.ends]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _sorted_groups(df: DataFrame, sliced=True) -> DataFrame:
    """Whole groups per partition, in order. Without slices the rows lie by prefix already, and
    Spark drops the repeated shuffle."""
    place = ["prefix", CHUNK] if sliced else ["prefix"]
    return df.repartition(*place).sortWithinPartitions("prefix", CHUNK, "ts", "update_id")


def _slice_carries(rows: DataFrame) -> DataFrame:
    """(prefix, slice) -> state at the start of each slice of a hot prefix, exactly.

    All slices run at once from a guessed state (nothing open). What each leaves behind is handed
    to the next, and the slices handed another state than they ran from run again, until none is.
    The first r slices are right after r rounds, so it always ends; since classes expire within
    minutes, two or three rounds are usual.
    """
    back = Window.partitionBy("prefix").orderBy(CHUNK)
    before = back.rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.select("prefix", CHUNK).distinct().withColumn("carry", F.lit(None).cast("string"))
    carry = todo = cut(carry)
    ends = None
    while True:
        again = _sorted_groups(rows.drop("carry").join(small(todo), ["prefix", CHUNK])).mapInArrow(_slice_ends, SUMMARY_DDL)
        ends = cut(again if ends is None else ends.join(small(todo), ["prefix", CHUNK], "left_anti").unionByName(again))
        kept = lambda c, d: F.coalesce(F.last(c, ignorenulls=True).over(before), F.lit(d))
        text = F.concat(
            F.lit('{"state":'), kept("state", "[0, 0]"), F.lit(',"incident":'), kept("incident", "null"),
            F.lit(',"leak":'), kept("leak", "null"), F.lit(',"due":'), F.lag("due").over(back),
            F.lit(',"last":'), F.lag("last").over(back), F.lit("}"))
        found = cut(ends.select("prefix", CHUNK, text.alias("carry")))
        todo = cut(found.join(carry.withColumnRenamed("carry", "_old"), ["prefix", CHUNK]).filter(
            ~F.col("carry").eqNullSafe(F.col("_old"))).drop("_old"))
        if todo.isEmpty():
            return found
        carry = found


def classify_batch(prepared: DataFrame, now=None) -> DataFrame:
    """Events: one row per judged update, and one per outage the ten-second check finds.

    ``state_ts`` is the time of the prefix's last update, also where a check found the outage.
    Updates with an ``event_time`` (microseconds) give events with one.

    ``now`` ends the replay: checks due after it are left out (None: all are run).
    """
    # Only small columns cross into Python as values; the rest passes through as Arrow.
    df = prepared.withColumn("geo", F.struct("lat", "lon", "city", "country"))
    narrow = [c for c in READ if c not in ("carry", "is_last")] + ["geo"]
    if SLICE not in prepared.columns:
        df = df.withColumns({"carry": F.lit(None).cast("string"), "is_last": F.lit(True)})
    else:
        hot = df.filter(F.col(SLICE).isNotNull()).select(*narrow, "update_id")
        hot = cut(hot.withColumn("is_last", F.lit(False)))
        carry = _slice_carries(hot)
        last = Window.partitionBy("prefix").orderBy(F.desc(CHUNK))
        carry = carry.withColumn("is_last", F.row_number().over(last) == 1)
        df = df.join(carry, ["prefix", CHUNK], "left").withColumn(
            "is_last", F.coalesce("is_last", F.lit(True)))
    kept = [f for f in prepared.schema.fields if f.name not in ("cand_leak", "needs_check", SLICE)]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in kept]
                          + T._parse_datatype_string(MADE_DDL).fields)
    out = _sorted_groups(df, SLICE in prepared.columns).mapInArrow(_events(now, schema), schema)
    incident = F.when(F.col("incident_ts").isNotNull(), F.md5(F.concat_ws(
        "|", "prefix", F.col("incident_class").cast("string"), F.col("incident_ts").cast("string"))))
    quiet = F.col("kind") == QUIET
    details = F.col("kind").isin(ENTERED, CHECK)
    routeviews = quiet & (F.col("source") == "routeviews")
    # an outage found by the check has the whole second of the check
    timed = [F.coalesce("event_time", F.timestamp_seconds("ts")).alias("event_time")] if "event_time" in out.columns else []
    return out.select(
        "update_id", "ts", "prefix",
        F.when(quiet, F.col("origin_asn")).otherwise(F.col("asn")).alias("asn"),
        F.when(routeviews, F.lit("routeviews")).otherwise(F.col("peer")).alias("peer_ip"),
        F.when(quiet, F.lit(0)).otherwise(F.col("historical_asn")).alias("historical_asn"),
        "classification", "old_classification", incident.alias("incident_id"), "incident_start_time",
        F.when(F.col("leak_type").isNotNull(), F.struct("leak_type", "leaker_asn", "victim_asn")).alias("leak_detail"),
        F.when(details & F.col("num_peers").isNotNull(), F.struct(*DETAILS)).alias("anomaly_details"),
        "source", "lat", "lon", "city", "country",
        F.when(F.col("kind") == CHECK, 0).otherwise(F.col("flap_cycle")).cast("long").alias("num_flaps"),
        (~quiet).alias("is_classified"), "is_withdrawal", "state_class",
        F.col("asn").alias("state_asn"), "state_ts", *timed)


def classify(updates: DataFrame, dims: dict, now=None, target_rows=2_000_000) -> DataFrame:
    """Updates to events in one call."""
    return classify_batch(prepare(updates, dims, target_rows), now)
