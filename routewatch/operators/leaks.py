"""Provider edges and route-leak patterns in AS paths."""

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.paths import parse_path
from ..session import cut, small


def distinct_paths(updates: DataFrame) -> DataFrame:
    """Announced paths, each once, with the time it was first seen and its ASNs."""
    paths = updates.filter(~F.col("is_withdrawal")).groupBy("path_str").agg(F.min("ts").alias("ts"))
    return paths.withColumn("path", parse_path(F.col("path_str")))


def provider_edges(updates: DataFrame, flags: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(provider, customer, first_ts) for neighbours in a path whose left ASN is tier-1 or large.

    Paths repeat a lot, so they are reduced to (path, first time) before they are taken apart.
    """
    path = (distinct_paths(updates) if paths is None else paths).filter(F.size("path") >= 2)
    pairs = path.select(
        "ts", F.explode(F.arrays_zip(
            F.slice("path", F.lit(1), F.size("path") - 1).alias("provider"),
            F.slice("path", F.lit(2), F.size("path") - 1).alias("customer"))).alias("e"))
    edges = pairs.groupBy(F.col("e.provider").alias("provider"), F.col("e.customer").alias("customer")).agg(
        F.min("ts").alias("first_ts"))
    big = flags.filter("is_tier1 or is_large").select(F.col("asn").alias("provider"))
    return edges.join(big, "provider", "left_semi")


def path_triples(paths: DataFrame, edges: DataFrame, flags: DataFrame) -> DataFrame:
    """Per distinct path of three or more ASNs: its triples with what a leak rule needs of them.

    A triple holds when each of the four edges was first seen (null: never) and the size flags.
    """
    paths = paths.filter(F.size("path") >= 3)
    t = paths.select("path_str", "path", F.explode(F.sequence(F.lit(0), F.size("path") - 3)).alias("i"))
    t = t.select("path_str", "i", *[F.get("path", F.col("i") + k).alias(f"p{k + 1}") for k in range(3)])
    # Same neighbours occur in many paths: look edges and flags up once per distinct triple.
    d = t.select("p1", "p2", "p3").distinct()
    for a, b in (("p1", "p2"), ("p3", "p2"), ("p2", "p3"), ("p2", "p1")):
        d = d.join(edges.select(F.col("provider").alias(a), F.col("customer").alias(b),
                                F.col("first_ts").alias(f"e_{a}{b}")), [a, b], "left")
    for p in ("p1", "p2", "p3"):
        d = d.join(flags.select(F.col("asn").alias(p), F.col("is_tier1").alias(f"t_{p}"),
                                (F.col("is_tier1") | F.col("is_large")).alias(f"b_{p}")), p, "left")
        d = d.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in (f"t_{p}", f"b_{p}")})
    t = t.join(d, ["p1", "p2", "p3"])
    fields = ["i", "p1", "p2", "p3", "e_p1p2", "e_p3p2", "e_p2p3", "e_p2p1",
              "t_p1", "t_p2", "t_p3", "b_p1", "b_p2", "b_p3"]
    return t.groupBy("path_str").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("triples"))


def leak_detail(triples, ts):
    """The first pattern that matches, patterns in order, each over the triples left to right."""

    def since(edge):
        return F.coalesce(edge <= ts, F.lit(False))

    def apart(t):
        return (t["p1"] != t["p2"]) & (t["p2"] != t["p3"]) & (t["p1"] != t["p3"])

    def hairpin(t):
        return apart(t) & since(t["e_p1p2"]) & since(t["e_p3p2"])

    def lateral(t):
        return apart(t) & t["b_p1"] & t["b_p2"] & t["b_p3"]

    def down_then_peer(t):
        return apart(t) & since(t["e_p1p2"]) & ~since(t["e_p3p2"]) & ~since(t["e_p2p3"])

    def peer_then_up(t):
        return apart(t) & ~since(t["e_p1p2"]) & ~since(t["e_p2p1"]) & since(t["e_p3p2"])

    def tier1_gap(t):
        return apart(t) & t["t_p1"] & ~t["t_p2"] & t["t_p3"]

    def back_again(t):
        return (t["p1"] == t["p3"]) & (t["p1"] != t["p2"])

    def first(rule, code, victim):
        hit = F.get(F.filter(triples, rule), F.lit(0))
        return F.when(hit.isNotNull(), F.struct(
            F.lit(code).alias("leak_type"), hit["p2"].alias("leaker_asn"), victim(hit).alias("victim_asn")))

    return F.coalesce(
        first(hairpin, K.LEAK_HAIRPIN, lambda t: t["p1"]),
        first(lateral, K.LEAK_LATERAL, lambda t: t["p1"]),
        first(lambda t: down_then_peer(t) | peer_then_up(t), K.LEAK_VALLEY_FREE,
              lambda t: F.when(down_then_peer(t), t["p1"]).otherwise(t["p3"])),
        first(tier1_gap, K.LEAK_VALLEY_FREE, lambda t: t["p3"]),
        first(back_again, K.LEAK_HAIRPIN, lambda t: t["p1"]))


def leak_patterns(df: DataFrame, updates: DataFrame, flags: DataFrame, when=None,
                  edges: DataFrame | None = None) -> DataFrame:
    """Add ``leak`` (leak_type, leaker_asn, victim_asn) to rows; null without a pattern.

    The rows' paths must occur in ``updates``, which also give the provider edges unless they are
    passed. ``when`` limits the rows that are looked up. The others get a spread-out key that
    matches nothing, so that withdrawals do not meet in one task.
    """
    paths = cut(distinct_paths(updates))
    edges = cut(provider_edges(updates, flags, paths)) if edges is None else edges
    table = cut(path_triples(paths, edges, flags).withColumnRenamed("path_str", "_path"))
    wanted = ~F.col("is_withdrawal") if when is None else ~F.col("is_withdrawal") & when
    spread = F.concat(F.lit("#"), F.pmod(F.col("update_id"), F.lit(4096)).cast("string"))
    df = df.withColumn("_path", F.when(wanted, F.col("path_str")).otherwise(spread))
    df = df.join(small(table), "_path", "left")
    return df.withColumn("leak", leak_detail(F.col("triples"), F.col("ts"))).drop("_path", "triples")
