"""Fixed examples and edge cases of single operators."""

import ipaddress
import random

from pyspark.sql import functions as F

from routewatch.functions import ipaddr, paths, text
from routewatch.functions.classes import display_name, display_priority
from routewatch.operators import address_space, anomaly, networks, prefix_join, rates, rpki
from routewatch.plans import alerts as AL
from routewatch.plans import incidents as IN
from routewatch.plans import summary as SU
from routewatch.session import small

CRIT = ("update_id long, ts long, prefix string, city string, country string, asn long, as_name string, org_name string, "
        "lat double, lon double, classification int")


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_prefix_parser_agrees_with_ipaddress(spark):
    texts = ["1.2.3.0/24", "10.0.0.0/8", "255.255.255.255/32", "256.1.1.1/24", "1.2.3/24", "1.2.3.4", "1.2.3.4/33", "::/0",
             "::1/128", "fe80::1:2/64", "1:2:3:4:5:6:7:8/128", "1:2:3:4:5:6:7::/112", "1:2:3/48", "2001:db8::g/32",
             "2001::db8::/32", "0.0.0.0/0", ":1::/16", "1:::2/16", "1:2:3:4:5:6:7:8:9/128", "", "/", "x/8", "2400:104::/129"]
    rows = ipaddr.with_prefix_cols(spark.createDataFrame([(t,) for t in texts], "prefix string")).collect()
    for r in rows:
        try:
            i = ipaddress.ip_interface(r.prefix)
            signed = lambda n: n - (1 << 64) if n >> 63 else n
            halves = lambda ip: tuple(map(signed, divmod(int(ip) << (96 if i.version == 4 else 0), 1 << 64)))
            want = (i.version, i.network.prefixlen, *halves(i.ip), *halves(i.network.network_address)) if "/" in r.prefix else (None,) * 6
        except ValueError:
            want = (None,) * 6
        assert (r.family, r.len, r.a, r.b, r.net_a, r.net_b) == want, r.prefix


def test_prefix_size_ignores_family(spark):
    cases = {"1.2.3.0/24": 256, "2001:db8::/32": 1, "2001:db8::/48": 0, "1.2.3.4": 0, "1.2.3.0/x": 0, "0.0.0.0/0": 1 << 32}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", ipaddr.ipv4_size(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in rows} == cases


def test_longest_match_against_brute_force(spark):
    rnd = random.Random(7)
    nets = {str(ipaddress.ip_network((rnd.getrandbits(32) & 0xFF00FFFF | 0x0A000000, rnd.randint(6, 32)), strict=False)) for _ in range(150)}
    nets |= {str(ipaddress.ip_network((0x20010DB8 << 96 | rnd.getrandbits(40) << 56, rnd.choice([33, 37, 48, 61])), strict=False)) for _ in range(60)}
    table = [(n, i) for i, n in enumerate(sorted(nets))]
    probes = [str(ipaddress.ip_address(rnd.getrandbits(24) | 0x0A000000)) for _ in range(200)]
    probes += [str(ipaddress.ip_address(0x20010DB8 << 96 | rnd.getrandbits(40) << 56)) for _ in range(80)] + ["bad"]
    left = spark.createDataFrame([(p,) for p in probes], "addr string")
    got = {r.addr: r.v for r in prefix_join.lpm_join(
        left, "addr", spark.createDataFrame(table, "net string, v int"), ["v"], "net").collect()}
    parsed = [(ipaddress.ip_network(n), v) for n, v in table]
    for p in probes:
        hits = [] if p == "bad" else [(n.prefixlen, v) for n, v in parsed if n.version == ipaddress.ip_address(p).version and ipaddress.ip_address(p) in n]
        assert got[p] == (max(hits)[1] if hits else None)


def test_covering_pairs_against_brute_force(spark):
    """Nested networks of every length, some wider than a bucket, some repeated; all covers, not only the longest."""
    rnd = random.Random(9)
    v4 = [ipaddress.ip_network((rnd.getrandbits(32) & 0xC0FF0FFF | 0x0A000000, rnd.randint(0, 32)), strict=False) for _ in range(150)]
    v6 = [ipaddress.ip_network((0x2001 << 112 | rnd.getrandbits(6) << 90 | rnd.getrandbits(4) << 60 | rnd.getrandbits(3), rnd.choice([0, 3, 16, 40, 48, 49, 64, 65, 100, 128])), strict=False)
          for _ in range(150)]
    nets = sorted({str(n) for n in v4 + v6})
    table = [(n, i) for i, n in enumerate(nets)] + [(n, -1) for n in nets[::7]] + [("bad/1", 0), (None, 0)]
    left = spark.createDataFrame([(n,) for n in nets] + [("x",), (None,)], "prefix string")
    right = spark.createDataFrame(table, "prefix string, v int")
    parsed = [(ipaddress.ip_network(n), n, v) for n, v in table if n and n != "bad/1"]
    for within in (True, False):
        got = sorted((r.prefix, r.cover, r.v) for r in prefix_join.covering_pairs(left, right, ["v"], within=within).collect())
        want = []
        for p in map(ipaddress.ip_network, nets):
            want += [(str(p), n, v) for q, n, v in parsed if q.version == p.version and p.network_address in q and (not within or q.prefixlen <= p.prefixlen)]
        assert got == sorted(want)
    ranked = spark.createDataFrame([("10.0.0.0/8", 1, 1), ("10.1.0.0/16", 2, 0), ("0.0.0.0/0", 3, 2)], "net string, v int, rank int")
    found = prefix_join.lpm_join(spark.createDataFrame([("10.1.2.3",), ("10.9.0.0/16",), ("11.0.0.1",)], "p string"), "p", ranked, ["v"], "net", "rank")
    assert {r.p: (r.v, r.match_len) for r in found.collect()} == {"10.1.2.3": (2, 16), "10.9.0.0/16": (1, 8), "11.0.0.1": (3, 0)}


def test_coverage_against_brute_force(spark):
    rnd = random.Random(3)
    nets = [ipaddress.ip_network((rnd.getrandbits(12) << 20, rnd.randint(5, 28)), strict=False) for _ in range(60)] + [
        ipaddress.ip_network("64.0.0.0/3"), ipaddress.ip_network("80.0.0.0/6")]
    want = sum(n.num_addresses for n in ipaddress.collapse_addresses(nets))
    df = spark.createDataFrame([(str(n),) for n in nets] * 2, "prefix string")
    assert address_space.covered_ipv4(df).first().ipv4_count == want


def test_ranges_against_ipaddress(spark):
    cases = [(0, 4294967295), (1, 1), (1, 10), (3232235777, 3232236287), (4294967295, 4294967295), (5, 4)]
    got = address_space.ranges_to_cidrs(spark.createDataFrame(cases, "start_ip long, end_ip long")).collect()
    for s, e in cases:
        want = [] if s > e else [str(n) for n in ipaddress.summarize_address_range(ipaddress.ip_address(s), ipaddress.ip_address(e))]
        assert sorted(r.cidr for r in got if (r.start_ip, r.end_ip) == (s, e)) == sorted(want)


def test_rpki_verdicts(spark):
    roas = spark.createDataFrame([("10.0.0.0/16", 20, 1), ("10.0.0.0/8", 8, 2)], "prefix string, max_len int, asn long")
    rows = [("10.0.0.0/16", 1), ("10.0.0.0/24", 1), ("10.1.0.0/16", 2), ("11.0.0.0/8", 2), ("10.0.0.0/8", 2)]
    df = spark.createDataFrame(rows, "prefix string, asn long")
    got = {(r.prefix, r.asn): r.rpki_status for r in rpki.rpki_status(df, roas).collect()}
    assert [got[r] for r in rows] == [1, 2, 2, 3, 1]
    assert rpki.rpki_status(df, None).first().rpki_status == 0


def test_paths(spark):
    assert one(spark, paths.parse_path(F.lit("3356 x 174 174 {5} 174 9"))) == [3356, 174, 9]
    assert one(spark, paths.parse_path(F.lit(""))) == []
    assert one(spark, paths.path_len_from_text(F.lit("1 2 {3,4,5}"))) == 5
    assert one(spark, paths.path_len(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3))))) == 3
    assert one(spark, paths.origin_asn(F.lit(7).cast("long"), F.lit("1 2"))) == 7
    assert one(spark, paths.origin_asn(F.lit(0).cast("long"), F.lit("1 {2}"))) == 0
    assert one(spark, paths.is_blackhole(F.lit("1:2 65535:666"))) and not one(spark, paths.is_blackhole(F.lit("1:6660")))


def test_formats(spark):
    n = lambda v: F.lit(v).cast("long")
    assert one(spark, text.commas(n(1234567))) == "1,234,567"
    assert [one(spark, text.short_number(n(v))) for v in (999, 1999, 1999999, 5 * 10**9)] == ["999", "1k", "1m", "5b"]
    assert [one(spark, text.human_number(n(v))) for v in (999, 1000, 1500, 2_340_000)] == ["999", "1k", "1.5k", "2.3m"]
    assert one(spark, text.slugify(F.lit("  Foo & Bar, Inc. "))) == "foo-bar-inc"
    ages = [one(spark, text.relative_time(n(1_000_000 - a), n(1_000_000))) for a in (4, 59, 3599, 7200, 90000)]
    assert ages == ["just now", "59s ago", "59m ago", "2h ago", "1/11/1970"]
    assert one(spark, text.impact_text(n(1500), F.array(F.lit("b"), F.lit("a")))) == "Impact(1.5K IPs): a (1 more)"
    assert one(spark, text.outage_label(F.lit("Outage"), n(2_000_000), n(3))) == "[OUTAGE] 2.0M IPv4 Addrs, 3 IPv6 Prefixes"
    assert one(spark, text.networks_text(F.array(*[F.lit(x) for x in "cab"]))) == "a, b, (1 more)"
    assert one(spark, text.alert_impact(n(5000), n(0), n(9))) == "5k IPv4 IPs"
    assert one(spark, text.alert_impact(n(0), n(0), n(9))) == "9 Events"


def test_display_names_and_priority(spark):
    names = {"Route Leak": 3, "Outage": 3, "BGP Hijack": 3, "Flap": 2, "DDoS Mitigation": 1, "Discovery": 0, "": 0, "Unknown": 0}
    for k, v in names.items():
        assert one(spark, display_priority(F.lit(k))) == v
    assert [one(spark, display_name(F.lit(c))) for c in (0, 10, 42)] == ["Discovery", "Route Leak", "Discovery"]


def test_global_counts_ignore_asn_zero(spark):
    st = spark.createDataFrame([("1.1.1.0/24", 0, 0, 0), ("2.2.2.0/24", 0, 0, 12345), ("2.2.3.0/24", 0, 0, 12345)],
                               "prefix string, last_update_ts long, classified_type int, origin_asn long")
    r = SU.global_counts(st).first()
    assert (r.asn_count, r.prefix_count, r.ipv6_prefix_count) == (1, 3, 0)


def test_rates(spark):
    ev = spark.createDataFrame([(t,) for t in range(100, 105)], "ts long")
    assert rates.message_rates(ev, w=10).filter("ts = 104").first().rate == 0.5
    assert rates.message_totals(ev.filter("ts < 102")).first().msg_count == 2
    r = rates.current_rates(ev, 104, 100).first()
    assert (r.total_count, r.window_count, r.rate) == (5, 5, 1.25)
    late = spark.createDataFrame([(3599,), (3601,), (3655,)], "ts long")  # a window over the hour
    assert rates.message_rates(late, w=60).orderBy("ts").collect()[-1].rate == 3 / 60


def test_rate_limit_is_greedy(spark):
    ts = [0, 100, 299, 300, 310, 599, 600, 1200, 1201]
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate(ts)], "k string, ts long, update_id long")
    assert sorted(r.ts for r in anomaly.rate_limit(df, ["k"], 300).collect()) == [0, 300, 600, 1200]


def ewma(counts, last):
    """The update rule minute by minute."""
    mean = var = 0.0
    for m in range(min(counts), last):
        d = counts.get(m, 0) - mean
        inc = (1 - 0.95) * d
        mean, var = mean + inc, 0.95 * (var + d * inc)
    return mean, var


def test_ewma_keeps_its_digits(spark):
    """Steady and very high counts over several blocks: variance to a relative 1e-6 of the rule's."""
    rnd = random.Random(6)
    for low, high in ((1, 1), (1000, 1000), (10 ** 5, 10 ** 5), (1, 10 ** 7)):
        counts = {m: rnd.randint(low, high) for m in range(0, 2200) if m % 3 != 1}
        # a count of n stands for n events, so the counting itself is left out
        states = anomaly.states_of(spark.createDataFrame([("1.0.0.0/8", m, n) for m, n in counts.items()], "prefix string, m long, n long"))
        got = {r.minute_ts // 60: r for r in states.collect()}
        mean = var = 0.0
        for m in range(0, max(counts) + 1):
            if m in counts:
                assert abs(got[m]["mean"] - mean) <= 1e-9 * (1 + mean) and abs(got[m]["var"] - var) <= 1e-6 * var + 1e-30
            d = counts.get(m, 0) - mean
            mean, var = mean + 0.05 * d, 0.95 * (var + d * 0.05 * d)


def test_one_row_per_asn(spark):
    info = spark.createDataFrame([(5, "B", "org", "x", 0.1), (5, "A", None, "x", 0.2), (6, "C", "", "y", 0.0)], "asn long, name string, org_name string, country string, heg_v4 double")
    assert {r.asn: r.name for r in networks.one_per_asn(info).collect()} == {5: "A", 6: "C"}
    events = spark.createDataFrame([(5,), (5,), (6,), (7,)], "asn long")
    assert networks.with_as_names(events, info).count() == 4


def test_ewma_blocks_and_restart(spark):
    """Spans more than one block of minutes, and a pause that starts the prefix anew."""
    rnd = random.Random(5)
    counts = {m: rnd.randint(1, 9) for m in range(0, 2600, 7)}
    counts.update({3000 + m: 2 for m in range(5)})
    rows = [(i, m * 60 + i % 60, "1.0.0.0/8", None, None, 1, "", None, 0.0, 0.0, 2) for m, n in counts.items() for i in range(n)]
    got = {r.minute_ts // 60: r for r in anomaly.minute_states(spark.createDataFrame(rows, CRIT)).collect()}
    old, new = {m: n for m, n in counts.items() if m < 2999}, {m: n for m, n in counts.items() if m >= 3000}
    for m, r in got.items():
        mean, var = ewma(old if m < 2999 else new, m)
        assert abs(r["mean"] - mean) < 1e-9 and abs(r["var"] - var) < 1e-9


def test_siblings(spark):
    info = spark.createDataFrame([(1, "Google A", None), (2, "GOOGLE B", None), (3, "x", "Org"), (4, "y", "Org"), (5, "", "")],
                                 "asn long, name string, org_name string")
    known = spark.createDataFrame([(5, 1)], "asn1 long, asn2 long")
    pairs = [(1, 2), (3, 4), (1, 5), (3, 1), (9, 9), (8, 9)]
    got = {(r.asn1, r.asn2): r.is_sibling for r in networks.siblings(
        spark.createDataFrame(pairs, "asn1 long, asn2 long"), info, known).collect()}
    assert [got[p] for p in pairs] == [True, True, True, False, True, False]


def test_alert_cooldown_and_thresholds(spark):
    """The first minute has nothing older to rise from; the second fires, the next stay silent."""
    rows = [(i, 60 * m + i % 50, f"20.{i % 40}.0.0/16", "C", "N", 7, "net", "Org", 10.04, -20.06, 2)
            for m, n in ((100, 4), (101, 4), (102, 4), (103, 40), (104, 60)) for i in range(n)]
    crit = spark.createDataFrame(rows, CRIT)
    out = AL.alerts(crit).collect()
    assert {r.alert_type for r in out} == {1, 2, 3, 4}
    first = min(r.timestamp for r in out)
    assert all(r.timestamp == first for r in out) and first == 101 * 60 + 59
    r = next(r for r in out if r.alert_type == 1)
    assert (r.events_count, r.delta, r.percentage_increase) == (8, 3, 300.0)
    assert (r.location.lat, r.location.lon, r.location.radius_km, r.location.city) == (10.0, -20.0, 11.0, "C")
    assert r.impacted_ipv4_ips == 4 * 65536 and len(r.sample_events) == 5
    assert [e.ts for e in r.sample_events] == sorted((e.ts for e in r.sample_events), reverse=True)
    key = AL.alert_key(AL.alerts(crit).filter("alert_type = 1")).first().alert_key
    assert key == f"1:2:10.0:-20.0:{first // 14400}"


def test_incidents_move_between_groups(spark):
    cols = ("incident_id string, prefix string, asn long, lat double, lon double, city string, country string, new_state int, old_state int, "
            "start_time long, end_time long, ts long, update_id long, leak_detail struct<leak_type:int,leaker_asn:bigint,victim_asn:bigint>")
    t = spark.createDataFrame([
        ("i1", "1.0.0.0/16", 5, 0.0, 0.0, "A", "X", 2, 0, 10, 0, 10, 1, (0, 9, 5)),
        ("i2", "2400::/32", 5, 0.0, 0.0, "", "X", 2, 0, 11, 0, 11, 2, None),
        ("i3", "1.0.0.0/16", 5, 0.0, 0.0, "A", "X", 4, 2, 20, 0, 20, 3, None),
        ("i3", "1.0.0.0/16", 5, 0.0, 0.0, "A", "X", 0, 4, 30, 30, 30, 4, None)], cols)
    got = {r.anomaly: r for r in IN.incidents(t).collect()}
    h, o = got["BGP Hijack"], got["Outage"]
    assert (h.impacted_prefixes, h.active_prefixes, h.impacted_ips, h.impacted_ipv6_prefixes, h.resolved) == (2, 1, 65536, 1, False)
    assert h.locations == "A, X | X" and h.n_incidents == 2
    assert (o.active_prefixes, o.resolved) == (0, True)
    assert [r.anomaly for r in IN.significant(IN.incidents(t), 100).collect()] == ["BGP Hijack"]


def test_broadcasts_are_limited_by_rows_and_bytes(spark):
    df = spark.range(100).selectExpr("id", "repeat('x', 1000) AS t", "array(named_struct('a', id, 'b', 1.5D)) AS s", "array(repeat('y', 10)) AS u")
    hinted = lambda out: out is not df
    assert hinted(small(df)) and not hinted(small(df, rows=99)) and not hinted(small(df, size=100_000))
    assert hinted(small(df.limit(0), size=0)) and hinted(small(df, rows=100, size=200_000))
