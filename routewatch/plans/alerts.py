"""Alerts: spikes of critical events per location, ASN, country and organisation."""

from pyspark.sql import DataFrame, Window, functions as F

from .. import constants as K
from ..functions.ipaddr import prefix_table
from ..operators.anomaly import minute_states, rate_limit, z_score
from ..operators.networks import as_names
from ..operators.tiles import quantise
from ..session import cut

TICK_SECOND = 59  # alerts are evaluated at the last second of every minute
GROUP = ["alert_type", "group_key", "classification"]
FACTS = ["asn", "as_name", "city", "country"]
SALTS = 16


def critical_events(events: DataFrame, as_info: DataFrame | None = None) -> DataFrame:
    """Events that feed the alert windows, with AS name and organisation."""
    return named_events(events.filter(F.col("classification").isin(K.CRITICAL)), as_info)


def named_events(rows: DataFrame, as_info: DataFrame | None = None) -> DataFrame:
    """Critical events in the columns of ``critical_events``."""
    if as_info is not None:
        names = as_names(as_info).filter("asn <> 0").select("asn", "as_name", F.col("as_org").alias("org_name"))
        rows = rows.join(names, "asn", "left")
    else:
        rows = rows.withColumns({"as_name": F.lit(None).cast("string"), "org_name": F.lit(None).cast("string")})
    timed = [c for c in ("event_time",) if c in rows.columns]
    return rows.select("update_id", "ts", "prefix", "city", "country", "asn", F.coalesce(
        "as_name", F.lit("")).alias("as_name"), "org_name", "lat", "lon", "classification", *timed)


def grouped(critical: DataFrame) -> DataFrame:
    """One row per event and grouping it belongs to; empty countries and organisations have none."""
    c = critical if "lat_q" in critical.columns else critical.withColumns({"lat_q": quantise("lat"), "lon_q": quantise("lon")})
    text = lambda kind, name, key: F.when(key.isNotNull() & (key != ""), F.struct(
        F.lit(kind).alias("alert_type"), key.alias("group_key")))
    groups = F.array(
        text(1, "loc", F.concat_ws(":", F.col("lat_q").cast("string"), F.col("lon_q").cast("string"))),
        text(2, "asn", F.col("asn").cast("string")), text(3, "country", F.col("country")),
        text(4, "org", F.col("org_name")))
    return c.withColumn("g", F.explode(F.filter(groups, lambda g: g.isNotNull()))).select(
        "g.*", *[x for x in c.columns])


def _ticks(df: DataFrame) -> DataFrame:
    """One row per evaluation whose five minutes hold the row; at most six."""
    first = F.floor((F.col("ts") - TICK_SECOND + 59) / 60) * 60 + TICK_SECOND
    last = F.floor((F.col("ts") + K.ALERT_WINDOW - TICK_SECOND) / 60) * 60 + TICK_SECOND
    return df.withColumn("tick", F.explode(F.sequence(first, last, F.lit(60).cast("long")))).withColumn(
        "recent", F.col("ts") >= F.col("tick") - K.ALERT_RECENT)


def slot(ts):
    """The second that stands for ``ts`` in the windows: the tick's second of its minute for itself, else the minute's first.

    All other seconds of a minute lie in the same windows.
    """
    second = F.pmod(ts, F.lit(60))
    return ts - F.when(second == TICK_SECOND, 0).otherwise(second)


def alert_candidates(critical: DataFrame, now: int | None = None) -> DataFrame:
    """Measures of every (grouping, class, tick): counts, change, address space, score, places."""
    # Count per fact and minute first; a row reaches up to six ticks in four groupings.
    rows = grouped(critical.withColumn("ts", slot(F.col("ts")))).groupBy(*GROUP, "prefix", *FACTS, "ts").agg(
        F.count("*").alias("n"), F.sum("lat").alias("slat"), F.sum("lon").alias("slon"))
    rows = _ticks(rows)
    if now is not None:
        rows = rows.filter(F.col("tick") == now)
    states = minute_states(critical)
    # The running minute of a tick is the tick's own minute, else the state of the latest one.
    z = states.select("prefix", F.col("minute_ts").alias("_m"),
                      F.col("n").alias("_n"), F.col("mean").alias("_mean"), F.col("var").alias("_var"))
    # last critical minute of the prefix up to the tick: within the window for recent prefixes
    seen = critical.groupBy("prefix", (F.floor(F.col("ts") / 60) * 60).alias("_m")).agg(F.lit(1).alias("_one"))
    seen = seen.withColumn("tick", F.explode(F.array(F.col("_m") + TICK_SECOND, F.col("_m") + 60 + TICK_SECOND)))
    seen = seen.groupBy("prefix", "tick").agg(F.max("_m").alias("_m"))
    scores = seen.join(z, ["prefix", "_m"]).select(
        "prefix", "tick", z_score(F.when(F.col("_m") + TICK_SECOND == F.col("tick"), F.col("_n").cast("double")).otherwise(
            F.lit(0.0)), F.col("_mean"), F.col("_var")).alias("z"))
    return measures(rows.withColumn("n_recent", F.when(F.col("recent"), F.col("n")).otherwise(0)), scores)


def measures(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates from counts (n, n_recent, slat, slon) by grouping, class, tick, prefix and ``FACTS``, and scores z by prefix and tick."""
    by = [*GROUP, "tick"]
    sizes = prefix_table(rows).select("prefix", "family", "size")
    per = rows.groupBy(*by, "prefix").agg(*[F.sum(c).alias(c) for c in ("n", "n_recent", "slat", "slon")])
    per = per.join(sizes, "prefix", "left").join(scores, ["prefix", "tick"], "left")
    main = per.groupBy(*by).agg(
        F.sum("n").alias("events_count"), F.sum("n_recent").alias("_recent"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("impacted_ipv4_ips"),
        F.count(F.when(F.col("family") == 6, 1)).alias("impacted_ipv6_prefixes"),
        F.sum(F.when(F.col("n_recent") > 0, F.coalesce("z", F.lit(0.0))).otherwise(0.0)).alias("anomaly_score"),
        F.sum("slat").alias("_lat"), F.sum("slon").alias("_lon"))
    asns = rows.groupBy(*by, "asn").agg(F.max("as_name").alias("as_name")).groupBy(*by).agg(
        F.count("*").alias("asn_count"), F.max("as_name").alias("_as_name"))
    out = main.join(asns, by)
    for c in ("city", "country"):
        out = out.join(top_value(rows, by, c, f"top_{c}"), by, "left")
    old = F.ceil((F.col("events_count") - F.col("_recent")) / 4.0)
    out = out.withColumn("_old", old).withColumn("delta", F.col("_recent") - F.col("_old"))
    return out.withColumn("percentage_increase", F.when(
        F.col("_old") > 0, F.col("delta") / F.col("_old") * 100.0).otherwise(0.0))


def top_value(rows: DataFrame, by, col, out, weight="n") -> DataFrame:
    """Most frequent value of a group; ties go to the smallest value."""
    n = rows.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.sum(weight).alias("_w"))
    return n.groupBy(*by).agg(F.min_by(col, F.struct(-F.col("_w"), F.col(col))).alias(out))


def passing(cand: DataFrame) -> DataFrame:
    """Candidates over the thresholds of their type, with cooldown key and place."""
    rule = F.lit(False)
    for kind, _, v4, v6, pct in K.ALERT_RULES:
        rule = rule | ((F.col("alert_type") == kind) & ((F.col("impacted_ipv4_ips") >= v4) | (
            F.col("impacted_ipv6_prefixes") >= v6)) & (F.col("percentage_increase") > pct))
    out = cand.filter(rule & (F.col("anomaly_score") >= K.ALERT_MIN_SCORE))
    kind = F.col("alert_type")
    name = F.element_at(F.array(*[F.lit(r[1]) for r in K.ALERT_RULES]), kind)
    key = F.concat_ws(":", name, "group_key", F.when(kind == 1, F.coalesce("top_country", F.lit(""))))
    loc, mean = F.split("group_key", ":"), F.col("events_count")
    return out.withColumns({
        "cooldown_key": key,
        "lat": F.when(kind == 1, F.get(loc, F.lit(0)).try_cast("int") / 10.0).otherwise(F.col("_lat") / mean),
        "lon": F.when(kind == 1, F.get(loc, F.lit(1)).try_cast("int") / 10.0).otherwise(F.col("_lon") / mean)})


def alerts(critical: DataFrame, now: int | None = None, samples=True) -> DataFrame:
    """Alerts at every minute tick (or at tick ``now`` only): thresholds, cooldown, two per type.

    Two classes of one key share the cooldown; the higher score goes first.
    """
    cand = cut(passing(alert_candidates(critical, now)))
    out = shown(cooled(cand))
    return with_samples(cut(out), critical) if samples else out


def cooled(cand: DataFrame) -> DataFrame:
    """Candidates at least 300 s after the last one kept of their cooldown key."""
    cand = cand.withColumn("_neg", -F.col("anomaly_score"))
    return rate_limit(cand, ["cooldown_key"], K.ALERT_COOLDOWN, ("tick", "_neg", "classification"), ts="tick")


def shown(kept: DataFrame) -> DataFrame:
    """The two best of each type and tick, as alerts."""
    best = Window.partitionBy("tick", "alert_type").orderBy(F.desc("anomaly_score"), "group_key", "classification")
    top = kept.withColumn("_r", F.row_number().over(best)).filter("_r <= 2")
    kind = F.col("alert_type")
    text = lambda cond, c: F.when(cond, F.coalesce(F.col(c), F.lit(""))).otherwise("")
    out = top.select(
        *GROUP, F.col("tick").alias("timestamp"),
        F.struct(F.coalesce("top_city", F.lit("")).alias("city"), F.coalesce("top_country", F.lit("")).alias("country"),
                 "lat", "lon", F.when(kind == 1, 11.0).otherwise(0.0).alias("radius_km")).alias("location"),
        F.when(kind == 2, F.col("group_key").try_cast("long")).otherwise(0).alias("asn"),
        text(kind == 3, "group_key").alias("country"), text(kind == 4, "group_key").alias("organization"),
        text(kind == 2, "_as_name").alias("as_name"),
        F.when(kind == 2, F.lit(1)).otherwise(F.col("asn_count")).cast("long").alias("asn_count"),
        "events_count", "delta", "impacted_ipv4_ips", "impacted_ipv6_prefixes", "percentage_increase",
        "anomaly_score")
    return out


def with_samples(alerts_df: DataFrame, critical: DataFrame) -> DataFrame:
    """Add the five newest events of each alert's window, newest first.

    Only events in the windows of alerts are looked at. The rows of a group are numbered per salt first, so
    that a large group is not sorted at once.
    """
    first = F.col("timestamp") - K.ALERT_WINDOW
    # the minutes of the alerts' windows, so that events meet them before they are dealt to groupings
    minutes = alerts_df.select(F.explode(F.sequence(F.floor(first / 60), F.floor(F.col("timestamp") / 60))).alias("_m")).distinct()
    near = critical.withColumn("_m", F.floor(F.col("ts") / 60)).join(minutes, "_m", "left_semi").drop("_m")
    rows = _ticks(grouped(near)).withColumnRenamed("tick", "timestamp")
    by = [*GROUP, "timestamp"]
    rows = rows.join(alerts_df.select(*by), by, "left_semi")
    return alerts_df.join(newest_events(rows), by, "left")


def newest_events(rows: DataFrame) -> DataFrame:
    """The five newest events of each grouping, class and ``timestamp``, newest first, as ``sample_events``."""
    by = [*GROUP, "timestamp"]
    entry = F.struct("ts", "update_id", "prefix", "asn", "as_name", "lat", "lon", "city", "country",
                     F.col("classification").alias("new_state"), F.lit(0).alias("old_state"),
                     F.coalesce("org_name", F.lit("")).alias("organization"))
    rows = rows.select(*by, "ts", "update_id", entry.alias("e"), F.pmod(F.xxhash64("update_id"), F.lit(SALTS)).alias("_s"))
    newest = [F.desc("ts"), F.desc("update_id")]
    for parts in ([*by, "_s"], by):
        w = Window.partitionBy(*parts).orderBy(*newest)
        rows = rows.withColumn("_r", F.row_number().over(w)).filter("_r <= 5").drop("_r")
    return rows.groupBy(*by).agg(F.reverse(F.array_sort(F.collect_list("e"))).alias("sample_events"))


def alert_key(df: DataFrame) -> DataFrame:
    """Add the de-duplication key: type, class, target, four-hour window."""
    kind = F.col("alert_type")
    one = lambda c: F.format_string("%.1f", c)
    target = (F.when(kind == 1, F.concat_ws(":", one(F.col("location.lat")), one(F.col("location.lon"))))
              .when(kind == 2, F.col("asn").cast("string")).when(kind == 3, F.col("country"))
              .when(kind == 4, F.col("organization")).otherwise("unknown"))
    return df.withColumn("alert_key", F.concat_ws(
        ":", kind.cast("string"), F.col("classification").cast("string"), target,
        F.floor(F.col("timestamp") / K.ALERT_KEY_SECONDS).cast("string")))


def merge_alerts(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Alert table keyed by alert key; a key keeps its highest score, the earlier row on a tie."""
    rows = alert_key(new if old is None else old.drop("alert_key").unionByName(new.drop("alert_key")))
    cols = [c for c in rows.columns if c != "alert_key"]
    best = rows.groupBy("alert_key").agg(F.max_by(F.struct(*cols), F.struct(
        "anomaly_score", -F.col("timestamp"))).alias("a"))
    return best.select("alert_key", "a.*")


def recent_alerts(table: DataFrame, now: int, per_class=10) -> DataFrame:
    """Top alerts per class by score over the last day; ties by key."""
    w = Window.partitionBy("classification").orderBy(F.desc("anomaly_score"), "alert_key")
    rows = table.filter(F.col("timestamp") >= now - K.DAY)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_class)


def selected_alerts(table: DataFrame, selected) -> DataFrame:
    """Alerts of the selected classes, highest score first."""
    return table.filter(F.col("classification").isin(list(selected))).orderBy(F.desc("anomaly_score"), "alert_key")


def sort_samples(table: DataFrame, n=5) -> DataFrame:
    """Order each alert's samples by prefix length, shortest first, and keep ``n``."""
    def length(e):
        text = F.try_element_at(F.split(e["prefix"], "/"), F.lit(2))
        return F.coalesce(text.try_cast("int"), F.when(F.instr(e["prefix"], ":") > 0, 128).otherwise(32))

    s = F.array_sort(F.transform("sample_events", lambda e, i: F.struct(length(e).alias("l"), i.alias("i"), e.alias("e"))))
    return table.withColumn("sample_events", F.transform(F.slice(s, 1, n), lambda x: x["e"]))
