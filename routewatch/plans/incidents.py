"""State transitions, incidents, and the day archives."""

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.classes import display_name
from ..functions.ipaddr import ipv4_size, is_ipv4
from ..functions.text import impact_text, slugify
from ..operators.anomaly import rate_limit
from ..operators.networks import as_names
from ..operators.rpki import rpki_status
from ..session import cut

RESULT = [K.OUTAGE, K.ROUTE_LEAK, K.MINOR_LEAK, K.HIJACK]


def transitions(events: DataFrame, dims: dict | None = None, target_states=None) -> DataFrame:
    """Rows whose class changed while an incident is open, at most one per (prefix, ASN) in 300 s.

    Of the rows of one second the smallest update_id goes first; an outage found by the timed check, which has none,
    goes last. ``target_states`` keeps rows that enter or leave one of the classes.
    """
    rows = cut(events.filter(changes_class()).withColumn("_o", F.coalesce("update_id", F.lit((1 << 63) - 1))))
    return transition_rows(rate_limit(rows, ["prefix", "asn"], 300, ("ts", "_o")), dims, target_states)


def changes_class():
    """Whether an event's class changed while an incident is open."""
    return (F.col("classification") != F.col("old_classification")) & F.col("incident_id").isNotNull()


def transition_rows(rows: DataFrame, dims: dict | None = None, target_states=None) -> DataFrame:
    """Rate-limited class changes as transitions, with names if ``dims`` has AS data."""
    if target_states:
        want = list(target_states)
        rows = rows.filter(F.col("classification").isin(want) | F.col("old_classification").isin(want))
    rows = rows.select(
        "incident_id", "prefix", "asn", "lat", "lon", F.coalesce("city", F.lit("")).alias("city"),
        F.coalesce("country", F.lit("")).alias("country"), F.col("classification").alias("new_state"),
        F.col("old_classification").alias("old_state"), F.col("incident_start_time").alias("start_time"),
        F.when(F.col("classification") == 0, F.col("ts")).otherwise(0).alias("end_time"), "leak_detail",
        F.when(F.col("anomaly_details").isNotNull(), F.to_json("anomaly_details")).otherwise("").alias("anomaly_details"),
        F.lit(0).alias("rpki_status"), "ts", "update_id")
    return with_names(rows, dims) if dims and dims.get("as_info") is not None else rows.withColumns(
        {"as_name": F.lit(""), "organization": F.lit("")})


def with_names(rows: DataFrame, dims: dict) -> DataFrame:
    """AS name and organisation of the row, names and RPKI status of leaker and victim."""
    names = cut(as_names(dims["as_info"]).filter("asn <> 0").select("asn", "as_name", "as_org"))
    rows = rows.join(names.select("asn", "as_name", F.col("as_org").alias("organization")), "asn", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("as_name", "organization")})
    d = F.col("leak_detail")
    rows = rows.withColumns({"_l": d["leaker_asn"], "_v": d["victim_asn"]})
    for side in ("_l", "_v"):
        rows = rows.join(names.select(F.col("asn").alias(side), F.col("as_name").alias(f"{side}_name")), side, "left")
    rows = cut(rows)
    for side in ("_l", "_v"):
        rows = rpki_status(rows, dims.get("roas"), side, out=f"{side}_rpki")
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.withColumn("leak_detail", F.when(d.isNotNull(), F.struct(
        d["leak_type"].alias("leak_type"), d["leaker_asn"].alias("leaker_asn"), d["victim_asn"].alias("victim_asn"),
        text("_l_name").alias("leaker_as_name"), text("_v_name").alias("victim_as_name"),
        F.col("_l_rpki").alias("leaker_rpki_status"), F.col("_v_rpki").alias("victim_rpki_status")))).drop(
        "_l", "_v", "_l_name", "_v_name", "_l_rpki", "_v_rpki")


def incidents(trans: DataFrame) -> DataFrame:
    """Transitions rolled up by (class name, ASN).

    A prefix is active in the group of its latest transition into that class, until a later
    transition takes it out. Groups without active prefix are resolved.
    """
    order = F.struct("ts", F.coalesce("update_id", F.lit(-1)))
    t = trans.withColumn("anomaly", display_name("new_state"))
    critical = F.col("new_state").isin(RESULT)
    # latest transition of each prefix: only there it can still be active
    now = t.groupBy("prefix").agg(F.max_by(F.struct(
        critical.alias("live"), "anomaly", "asn", (F.col("end_time") == 0).alias("open")), order).alias("s"))
    now = now.filter("s.live and s.open").select("prefix", F.col("s.anomaly").alias("anomaly"),
                                                 F.col("s.asn").alias("asn"), F.lit(1).alias("_active"))
    hits = t.filter(critical)
    loc = F.concat_ws(", ", F.nullif("city", F.lit("")), F.nullif("country", F.lit("")))
    per = hits.groupBy("anomaly", "asn", "prefix").agg(
        F.min("start_time").alias("start"), F.max("ts").alias("last_ts"))
    per = per.join(now, ["anomaly", "asn", "prefix"], "left")
    v4 = is_ipv4("prefix")
    groups = per.groupBy("anomaly", "asn").agg(
        F.min("start").alias("first_start"), F.max("last_ts").alias("last_ts"),
        F.count("*").alias("impacted_prefixes"), F.count("_active").alias("active_prefixes"),
        F.coalesce(F.sum(F.when(v4, ipv4_size(F.col("prefix")))), F.lit(0)).alias("impacted_ips"),
        F.count(F.when(~v4, 1)).alias("impacted_ipv6_prefixes"),
        F.min("prefix").alias("first_prefix"))
    ids = hits.filter("incident_id <> ''").select("anomaly", "asn", "incident_id").distinct().groupBy(
        "anomaly", "asn").agg(F.count("*").alias("n_incidents"))
    places = hits.withColumn("loc", loc).filter("loc <> ''").groupBy("anomaly", "asn", "loc").agg(
        F.min(order).alias("o")).groupBy("anomaly", "asn").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("o", "loc"))), lambda x: x["loc"]), " | ").alias("locations"))
    leak = hits.filter("leak_detail is not null").groupBy("anomaly", "asn").agg(
        F.max_by("leak_detail", order).alias("leak_detail"))
    out = groups.join(ids, ["anomaly", "asn"], "left").join(places, ["anomaly", "asn"], "left").join(
        leak, ["anomaly", "asn"], "left")
    return out.withColumns({
        "resolved": F.col("active_prefixes") == 0, "n_incidents": F.coalesce("n_incidents", F.lit(0)),
        "locations": F.coalesce("locations", F.lit(""))})


def significant(inc: DataFrame, now: int, newest=5, max_age=600) -> DataFrame:
    """Unresolved incidents of at least 5000 addresses or 500 IPv6 prefixes, newest first."""
    big = (F.col("impacted_ips") >= K.SIGNIFICANT_IPV4) | (F.col("impacted_ipv6_prefixes") >= K.SIGNIFICANT_IPV6)
    young = F.lit(now) - F.col("first_start") < max_age
    return inc.filter(big & young & ~F.col("resolved")).orderBy(F.desc("first_start"), "anomaly", "asn").limit(newest)


def shown_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts the display takes: a rise, and enough addresses or prefixes."""
    return alerts.filter((F.col("percentage_increase") > 0) & (
        (F.col("impacted_ipv4_ips") >= K.SIGNIFICANT_IPV4) | (F.col("impacted_ipv6_prefixes") >= K.SIGNIFICANT_IPV6)))


def incident_impact(trans: DataFrame) -> DataFrame:
    """Impact line per (class name, ASN)."""
    t = trans.filter(F.col("new_state").isin(RESULT)).withColumn("anomaly", display_name("new_state"))
    p = t.select("anomaly", "asn", "prefix").distinct()
    out = p.groupBy("anomaly", "asn").agg(
        F.sum(F.when(is_ipv4("prefix"), ipv4_size(F.col("prefix"))).otherwise(0)).alias("ips"),
        F.count("*").alias("n"), F.min("prefix").alias("first"))
    # The line names the first prefix and counts the rest, so the rest is never collected.
    line = impact_text(F.col("ips"), F.array("first"))
    more = F.when(F.col("n") > 1, F.concat(F.lit(" ("), (F.col("n") - 1).cast("string"), F.lit(" more)"))).otherwise("")
    return out.select("anomaly", "asn", F.concat(line, more).alias("impact"))


def asn_archive(trans: DataFrame, as_info: DataFrame) -> DataFrame:
    """Per (day, ASN, prefix): the transitions in order. Rows per prefix keep groups small; the
    nested per-ASN form is ``asn_day``."""
    names = as_names(as_info).select("asn", F.col("as_name").alias("name"), F.col("as_org").alias("org"))
    entry = F.struct("ts", "old_state", "new_state", "incident_id", "leak_detail", "anomaly_details", "rpki_status")
    per = trans.withColumn("day", F.floor(F.col("ts") / K.DAY) * K.DAY).groupBy("day", "asn", "prefix").agg(
        F.sort_array(F.collect_list(entry)).alias("events"))
    return per.join(names, "asn", "left")


def asn_day(archive: DataFrame) -> DataFrame:
    """Nested: one row per (day, ASN) with its prefixes and their transitions."""
    return archive.groupBy("day", "asn", "name", "org").agg(
        F.sort_array(F.collect_list(F.struct("prefix", "events"))).alias("prefixes"))


def org_archive(events: DataFrame, as_info: DataFrame) -> DataFrame:
    """Per organisation: its ASNs and the number of events."""
    names = as_names(as_info).select("asn", F.col("as_org").alias("org")).filter("org <> ''")
    per = events.groupBy("asn").agg(F.count("*").alias("n")).join(names, "asn")
    return per.groupBy("org").agg(F.sort_array(F.collect_list("asn")).alias("asns"), F.sum("n").alias("event_count"))


def prefix_snapshots(events: DataFrame) -> DataFrame:
    """Per prefix: last class and ASN, last update and the number of events."""
    return events.groupBy("prefix").agg(
        F.max_by(F.struct("classification", "asn"), F.struct("ts", F.coalesce("update_id", F.lit(-1)))).alias("s"),
        F.max("ts").alias("last_update_ts"), F.count("*").alias("total_events")).select(
        "prefix", "s.classification", "s.asn", "last_update_ts", "total_events")


def asn_metadata(events: DataFrame, dims: dict) -> DataFrame:
    """Per seen ASN: name, organisation, and the RPKI status of its latest prefix."""
    names = as_names(dims["as_info"]).select("asn", F.col("as_name").alias("name"), F.col("as_org").alias("org"))
    last = events.filter("asn <> 0").groupBy("asn").agg(F.max_by("prefix", F.struct("ts", "update_id")).alias("prefix"))
    return rpki_status(last, dims["roas"]).join(names, "asn", "left").select("asn", "name", "org", "rpki_status")


def org_metadata(as_info: DataFrame) -> DataFrame:
    return as_info.filter("org_name <> ''").select(F.col("org_name").alias("name")).distinct().withColumn(
        "slug", slugify(F.col("name")))


def day_transitions(trans: DataFrame) -> DataFrame:
    """Per day: transitions, distinct organisations, and the newest transition; the others are rows of ``trans``."""
    day = (F.floor(F.col("ts") / K.DAY) * K.DAY).alias("day")
    return trans.groupBy(day).agg(
        F.count("*").alias("total_transitions"), F.count_distinct(F.when(F.col("organization") != "", F.col("organization"))).alias("unique_orgs"),
        F.max(F.struct("ts", "update_id", "prefix", "asn", "as_name", "organization", "old_state", "new_state", "incident_id")).alias("newest"))
