"""Number and label formats for display."""

from pyspark.sql import Column, functions as F


def commas(n) -> Column:
    """1234567 -> 1,234,567."""
    return F.format_number(n, 0)


def short_number(n: Column) -> Column:
    """Floor to k / m / b."""
    scaled = lambda d, unit: F.concat(F.floor(n / d).cast("string"), F.lit(unit))
    return (
        F.when(n < 1000, n.cast("string"))
        .when(n < 1_000_000, scaled(1000, "k"))
        .when(n < 1_000_000_000, scaled(1_000_000, "m"))
        .otherwise(scaled(1_000_000_000, "b"))
    )


def _one_decimal(n: Column, unit: int) -> Column:
    """One decimal, half up on the exact decimal value, no grouping."""
    exact = n.cast("decimal(20,0)") / F.lit(unit).cast("decimal(10,0)")
    return F.round(exact, 1).cast("decimal(20,1)").cast("string")


def human_number(n: Column) -> Column:
    """One decimal k / m / b, a trailing .0 dropped."""
    def form(unit, mark):
        return F.concat(F.regexp_replace(_one_decimal(n, unit), r"\.0$", ""), F.lit(mark))

    return (
        F.when(n >= 1_000_000_000, form(1_000_000_000, "b"))
        .when(n >= 1_000_000, form(1_000_000, "m"))
        .when(n >= 1000, form(1000, "k"))
        .otherwise(n.cast("string"))
    )


def impact_number(n: Column) -> Column:
    """One decimal K / M, the trailing .0 kept."""
    return (
        F.when(n >= 1_000_000, F.concat(_one_decimal(n, 1_000_000), F.lit("M")))
        .when(n >= 1000, F.concat(_one_decimal(n, 1000), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def impact_text(ips: Column, prefixes: Column) -> Column:
    """``Impact(<n> IPs): <first prefix> (<m> more)`` from an array of prefixes."""
    names = F.array_sort(prefixes)
    first = F.coalesce(F.get(names, F.lit(0)), F.lit(""))
    more = F.when(
        F.size(names) > 1, F.concat(F.lit(" ("), (F.size(names) - 1).cast("string"), F.lit(" more)"))
    ).otherwise(F.lit(""))
    return F.concat(F.lit("Impact("), impact_number(ips), F.lit(" IPs): "), first, more)


def outage_label(name: Column, ips: Column, v6: Column) -> Column:
    """``[NAME] <n> IPv4 Addrs, <m> IPv6 Prefixes``, parts that are zero left out."""
    parts = F.concat_ws(
        ", ",
        F.when(ips > 0, F.concat(impact_number(ips), F.lit(" IPv4 Addrs"))),
        F.when(v6 > 0, F.concat(v6.cast("string"), F.lit(" IPv6 Prefixes"))),
    )
    return F.when(parts != "", F.concat(F.lit("["), F.upper(name), F.lit("] "), parts))


def networks_text(prefixes: Column, shown=2) -> Column:
    """The first two prefixes and how many more there are."""
    names = F.array_sort(prefixes)
    more = F.size(names) - shown
    return F.concat(
        F.concat_ws(", ", F.slice(names, 1, shown)),
        F.when(more > 0, F.concat(F.lit(", ("), more.cast("string"), F.lit(" more)"))).otherwise(
            F.lit("")),
    )


def alert_impact(ipv4: Column, ipv6: Column, events: Column) -> Column:
    """Short impact line of an alert: addresses and prefixes, else the number of events."""
    def num(n):
        scaled = lambda d, u: F.concat(
            F.format_string("%.0f", n.cast("double") / F.lit(float(d))), F.lit(u))
        return F.when(n >= 1_000_000, scaled(1_000_000, "m")).when(n >= 1000, scaled(1000, "k")).otherwise(
            n.cast("string"))

    v4 = F.when(ipv4 > 0, F.concat(num(ipv4), F.lit(" IPv4 IPs")))
    v6 = F.when(ipv6 > 0, F.concat(num(ipv6), F.lit(" IPv6 Prefixes")))
    text = F.concat_ws(", ", v4, v6)
    return F.when(text != "", text).otherwise(F.concat(num(events), F.lit(" Events")))


def slugify(name) -> Column:
    """Lower case, other characters to single dashes, no dash at the ends."""
    dashed = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "(^-|-$)+", "")


def relative_time(ts: Column, now: Column) -> Column:
    """Age in words; older than a day gives the date as m/d/yyyy."""
    age = now - ts
    unit = lambda d, mark: F.concat(F.floor(age / d).cast("string"), F.lit(mark))
    return (
        F.when(age < 5, F.lit("just now"))
        .when(age < 60, F.concat(age.cast("string"), F.lit("s ago")))
        .when(age < 3600, unit(60, "m ago"))
        .when(age < 86400, unit(3600, "h ago"))
        .otherwise(F.date_format(F.timestamp_seconds(ts), "M/d/yyyy"))
    )
