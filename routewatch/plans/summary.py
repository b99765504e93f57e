"""State tables and summaries."""

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.classes import classes, display_name, display_priority
from ..functions.ipaddr import is_ipv4, prefix_table
from ..functions.text import human_number, short_number
from ..operators.address_space import covered_ipv4
from ..operators.networks import as_names
from ..operators.rates import current_rates, event_composition
from ..operators.rpki import rpki_status

ORDER = ["ts", "update_id"]


def prefix_state(events: DataFrame) -> DataFrame:
    """Latest stored row per prefix; a row is stored on a withdrawal or when the class changed.

    The origin is the announced one, else the last announced, else the historical one.
    """
    # Rows that only show a class (discovery, continued incidents) leave the state as it was.
    changed = F.col("is_withdrawal") | ((F.col("old_classification") != F.col("classification")) & (
        F.col("state_class") == F.col("classification")))
    rows = events.filter(changed)
    # an outage found by the timed check leaves the time of the last update
    updated = F.col("state_ts" if "state_ts" in events.columns else "ts").alias("ts")
    last = rows.groupBy("prefix").agg(F.max_by(
        F.struct(updated, "state_class", "state_asn"), F.struct("ts", F.coalesce("update_id", F.lit(-1)))).alias("s"))
    return last.select("prefix", F.col("s.ts").alias("last_update_ts"),
                       F.col("s.state_class").alias("classified_type"), F.col("s.state_asn").alias("origin_asn"))


def merge_prefix_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: the row with the later update wins, the new one on a tie."""
    rows = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    cols = [c for c in new.columns if c != "prefix"]
    best = rows.groupBy("prefix").agg(F.max_by(F.struct(*cols), F.struct("last_update_ts", "_n")).alias("s"))
    return best.select("prefix", "s.*")


def flap_events(events: DataFrame) -> DataFrame:
    """One flap row per completed cycle."""
    rows = events.filter("num_flaps > 0").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("num_flaps").cast("int"))))
    return rows.select("prefix", "asn", F.lit(K.FLAP).alias("event_type"), "ts")


def global_counts(state: DataFrame) -> DataFrame:
    v4 = F.count(F.when(is_ipv4("prefix"), 1))
    return state.agg(
        F.count_distinct(F.when(F.col("origin_asn") != 0, F.col("origin_asn"))).alias("asn_count"),
        F.count("*").alias("prefix_count"), v4.alias("ipv4_prefix_count"),
        (F.count("*") - v4).alias("ipv6_prefix_count"))


def class_stats(state: DataFrame) -> DataFrame:
    v4 = F.count(F.when(is_ipv4("prefix"), 1))
    return state.groupBy("classified_type").agg(
        F.count("*").alias("prefix_count"), v4.alias("ipv4_prefix_count"),
        (F.count("*") - v4).alias("ipv6_prefix_count"),
        F.count_distinct(F.when(F.col("origin_asn") != 0, F.col("origin_asn"))).alias("asn_count"))


def flappiest(flaps: DataFrame, now: int, limit: int, as_info: DataFrame | None = None) -> DataFrame:
    """ASNs with the most flaps of the last day; the limit is kept in 1..100, ties by ASN."""
    rows = flaps.filter((F.col("event_type") == K.FLAP) & (F.col("ts") >= now - K.DAY))
    top = rows.groupBy("asn").agg(F.count("*").alias("flap_count")).orderBy(
        F.desc("flap_count"), "asn").limit(max(1, min(100, limit)))
    return top if as_info is None else with_network_name(top, as_info, "")


def with_network_name(df: DataFrame, as_info: DataFrame, default=None) -> DataFrame:
    names = as_names(as_info).filter("asn <> 0").select("asn", F.col("as_name").alias("network_name"))
    fallback = F.lit(default) if default is not None else F.concat(F.lit("AS"), F.col("asn").cast("string"))
    return df.join(names, "asn", "left").withColumn("network_name", F.coalesce("network_name", fallback))


def top_flappy(flaps: DataFrame, state: DataFrame, now: int, as_info: DataFrame, n=5) -> DataFrame:
    """Top ASNs by flaps with their most-flapping prefix and recent update rate."""
    rows = flaps.filter((F.col("event_type") == K.FLAP) & (F.col("ts") >= now - K.DAY))
    per = rows.groupBy("asn", "prefix").agg(F.count("*").alias("c"))
    # count first, then pick: no ASN's rows are ever sorted
    best = per.groupBy("asn").agg(F.sum("c").alias("flap_count"), F.min_by(
        "prefix", F.struct(-F.col("c"), F.col("prefix"))).alias("prefix"))
    top = best.orderBy(F.desc("flap_count"), "asn").limit(n)
    rate = state.filter(F.col("last_update_ts") >= now - 300).groupBy(F.col("origin_asn").alias("asn")).agg(
        (F.count("*") / F.lit(300.0)).alias("event_rate"))
    top = top.join(rate, "asn", "left").withColumn("event_rate", F.coalesce("event_rate", F.lit(0.0)))
    return with_network_name(top, as_info)


def org_sizes(state: DataFrame, as_info: DataFrame) -> DataFrame:
    """Plain sum of IPv4 prefix sizes per organisation (else AS name); overlaps are not merged."""
    sizes = prefix_table(state, ["origin_asn"]).filter("family = 4").groupBy("origin_asn").agg(F.sum("size").alias("ips"))
    names = as_names(as_info).select(F.col("asn").alias("origin_asn"), F.col("rank_org").alias("org"))
    return sizes.filter("origin_asn > 0").join(names, "origin_asn").filter("org is not null").groupBy("org").agg(
        F.sum("ips").alias("ipv4_count"))


def largest_org(state: DataFrame, as_info: DataFrame) -> DataFrame:
    return org_sizes(state, as_info).orderBy(F.desc("ipv4_count"), "org").limit(1).select(
        F.col("org").alias("largest_org_name"), F.col("ipv4_count").alias("largest_org_ipv4_count"))


def rpki_counts(state: DataFrame, roas: DataFrame) -> DataFrame:
    """One row: prefixes valid, invalid, not found per family; ASN 0 counts as not found."""
    rows = prefix_table(state, ["origin_asn"]).select("prefix", "origin_asn", "family")
    rows = rpki_status(rows, roas, "origin_asn").withColumn(
        "rpki_status", F.when(F.col("origin_asn") > 0, F.col("rpki_status")).otherwise(3))
    n = lambda fam, s: F.count(F.when((F.col("family") == fam) & (F.col("rpki_status") == s), 1))
    return rows.agg(*[n(fam, s).alias(f"rpki_{name}_ipv{fam}") for fam in (4, 6)
                      for s, name in ((1, "valid"), (2, "invalid"), (3, "not_found"))])


def with_cached_rpki(fresh: DataFrame | None, cached: DataFrame) -> DataFrame:
    """Fresh counts when RPKI data was loaded, else the cached row."""
    return cached if fresh is None else fresh


def summary_classes(state: DataFrame, events: DataFrame, now: int, start: int) -> DataFrame:
    """One row per listed class: message counts and rates, prefixes, ASNs and addresses.

    Discovery shows the state rows without a class. Without covered addresses the IPv4 prefixes
    count 256 each.
    """
    listed = classes(state.sparkSession).filter(F.col("id").isin(K.SUMMARY_CLASSES)).select(
        F.col("id").alias("classification"), F.when(F.col("id") == K.DISCOVERY, 0).otherwise(F.col("id")).alias("classified_type"))
    rates = current_rates(events, now, start, ["classification"]).withColumnRenamed("rate", "messages_per_second")
    space = covered_ipv4(state, ["classified_type"])
    out = listed.join(rates, "classification", "left").join(class_stats(state), "classified_type", "left").join(
        space, "classified_type", "left")
    counts = ["window_count", "total_count", "asn_count", "prefix_count", "ipv4_prefix_count", "ipv6_prefix_count"]
    out = out.na.fill(0, counts).na.fill(0.0, ["messages_per_second"])
    covered = F.coalesce("ipv4_count", F.lit(0))
    return out.withColumn("ipv4_count", F.when(covered == 0, F.col("ipv4_prefix_count") * 256).otherwise(covered)).select(
        "classification", F.col("window_count").alias("count"), "messages_per_second", "asn_count", "prefix_count",
        "ipv4_prefix_count", "ipv6_prefix_count", "ipv4_count", "total_count")


def summary(state, flaps, events, dims, now: int, start: int, lag: DataFrame | None = None) -> DataFrame:
    """The whole summary as one nested row. Every part is an aggregate of one or few rows."""
    spark = state.sparkSession
    part = lambda df, name, cols: df.agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    per_class = summary_classes(state, events, now, start)
    flappy = top_flappy(flaps, state, now, dims["as_info"]).withColumn("_o", -F.col("flap_count"))
    rate = current_rates(events, now, start).select(F.col("rate").alias("messages_per_second"))
    pieces = [
        global_counts(state), covered_ipv4(state), largest_org(state, dims["as_info"]).agg(
            F.first("largest_org_name").alias("largest_org_name"),
            F.first("largest_org_ipv4_count").alias("largest_org_ipv4_count")),
        rpki_counts(state, dims["roas"]), rate,
        part(per_class, "classification_counts", per_class.columns),
        part(flappy, "flappiest_network_stats", ["_o", "asn", "network_name", "event_rate", "flap_count", "prefix"]),
        part(event_composition(events), "event_composition", ["type", "percentage"])]
    if lag is not None:
        pieces.append(lag.agg(F.max("max_lag").alias("max_lag_seconds")))
    out = spark.range(1).select(F.lit(now).cast("long").alias("timestamp"))
    for p in pieces:  # one row each
        out = out.crossJoin(F.broadcast(p))
    return out


DISPLAY_SUMS = {"msg_count": "total_count", "rate": "messages_per_second"}
DISPLAY_MAX = {"asn_count": "asn_count", "prefix_count": "prefix_count", "ipv4_prefix_count": "ipv4_prefix_count",
               "ipv6_prefix_count": "ipv6_prefix_count", "ip_count": "ipv4_count"}


def display_summary(per_class: DataFrame) -> DataFrame:
    """Rows the display lists: no class counts as discovery, bogons hidden, minor leaks left out."""
    spark = per_class.sparkSession
    shown = spark.createDataFrame([(c,) for c in K.DISPLAY_CLASSES], "classification int")
    rows = per_class.withColumn("classification", F.when(
        F.col("classification") == 0, K.DISCOVERY).otherwise(F.col("classification")))
    rows = rows.groupBy("classification").agg(
        *[F.sum(c).alias(n) for n, c in DISPLAY_SUMS.items()], *[F.max(c).alias(n) for n, c in DISPLAY_MAX.items()])
    out = shown.join(rows, "classification", "left").na.fill(0)
    out = out.withColumn("name", display_name("classification")).withColumn("priority", display_priority(F.col("name")))
    out = out.withColumns({
        "rate_text": F.format_string("%.1f", F.col("rate")), "msg_text": short_number(F.col("msg_count")),
        "prefix_text": short_number(F.col("prefix_count")), "ip_text": short_number(F.col("ip_count"))})
    return out.orderBy(F.desc("priority"), F.desc("msg_count"), "classification")


def tier_totals(per_class: DataFrame) -> DataFrame:
    """Addresses per severity tier; bogons are hidden and minor leaks not counted."""
    tier = {c[0]: c[5] for c in K.CLASSES if c[0] not in (K.BOGON, K.MINOR_LEAK)}
    of = lambda t: F.coalesce(F.sum(F.when(F.col("classification").isin(
        [k for k, v in tier.items() if v == t]), F.col("ipv4_count"))), F.lit(0))
    return per_class.agg(*[of(t).alias(f"{t}_ips") for t in ("good", "poly", "bad", "crit")])


def report_card(row: DataFrame) -> DataFrame:
    """Shares for the report: families, RPKI per family and overall. ``row`` is one summary row."""
    total = F.col("ipv4_prefix_count") + F.col("ipv6_prefix_count")
    total = F.when(total == 0, 1).otherwise(total)
    share = lambda c: F.floor(c * 100.0 / total + 0.5).cast("long")
    s = {f"{n}_{fam}": F.col(f"rpki_{n}_{fam}") for n in ("valid", "invalid", "not_found") for fam in ("ipv4", "ipv6")}
    both = {n: s[f"{n}_ipv4"] + s[f"{n}_ipv6"] for n in ("valid", "invalid", "not_found")}
    of_all = both["valid"] + both["invalid"] + both["not_found"]
    pct = F.when(of_all == 0, F.lit(0.0)).otherwise(both["valid"] * 100.0 / of_all)
    return row.select(
        share(F.col("ipv4_prefix_count")).alias("ipv4_share"), share(F.col("ipv6_prefix_count")).alias("ipv6_share"),
        *[c.alias(f"rpki_{n}") for n, c in s.items()], *[c.alias(f"rpki_{n}_all") for n, c in both.items()],
        F.format_string("%.1f", pct).alias("rpki_valid_percent"))


def active_classes(per_class: DataFrame) -> DataFrame:
    return per_class.filter("prefix_count > 0").orderBy(F.desc("prefix_count"), "classification").select(
        "classification", "prefix_count", human_number(F.col("prefix_count")).alias("prefix_text"))


def day_summary(summary_row: DataFrame, alerts: DataFrame) -> DataFrame:
    """The day's report: summary counts, classes, flappiest networks and the recent alerts."""
    a = [c for c in alerts.columns if c not in ("alert_key", "rank", "group_key")]
    top = alerts.agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("anomaly_score")).alias("_o"), *a))).alias("top_alerts"))
    counts = ["ipv4_prefix_count", "ipv6_prefix_count", "ipv4_count"] + [
        f"rpki_{n}_{f}" for f in ("ipv4", "ipv6") for n in ("valid", "invalid", "not_found")]
    day = summary_row.select(
        F.col("timestamp").alias("date"), F.col("asn_count").alias("unique_asns"),
        F.col("prefix_count").alias("unique_prefixes"), *counts,
        F.col("flappiest_network_stats").alias("flappiest_networks"), "classification_counts")
    return day.crossJoin(F.broadcast(top))


def retain_recent(df: DataFrame, now: int, seconds=K.DAY, ts="ts") -> DataFrame:
    return df.filter(F.col(ts) >= now - seconds)


def stale_prefixes(state: DataFrame, threshold: int) -> DataFrame:
    return state.filter(F.col("last_update_ts") < threshold)


