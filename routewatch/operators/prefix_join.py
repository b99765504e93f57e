"""Joins on IP prefixes: each address is one row of a sorted bucket, whatever lengths the table has.

Prefixes nest or lie apart, never across. So of the table's networks that start at or before an address, the last
one is inside every network that covers the address, or covers it itself: the answer is
among that network's chain, the networks around it from the widest to itself. A chain is made once per
network of the table, by equi-joins on masked longs. A probe takes the chain of the last network before it by a
window over its bucket (the first 16 bits for IPv4, 48 for IPv6) and keeps what covers it. Networks
wider than a bucket are looked up once for each bucket and stand at its start.

Probes are reduced to distinct addresses first, so repeated rows of one prefix cost nothing here.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ipaddr import in_network, network, prefix_table

#: Bits of a bucket: an IPv4 bucket has at most 65,536 addresses.
BUCKET_BITS = {4: 16, 6: 48}
NETWORK = ["family", "rank", "len", "net_a", "net_b"]
BUCKET = ["family", "rank", "bucket"]


def _bucket(a: Column) -> Column:
    bits = F.when(F.col("family") == 4, BUCKET_BITS[4]).otherwise(BUCKET_BITS[6])
    return network(a, F.lit(0).cast("long"), bits)[0]


def _unsigned(half: Column) -> Column:
    """Longs in the order of their bits: the first one as sign, turned."""
    return half.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def _around(inner: DataFrame, entries: DataFrame, key: list[str], longest: Column) -> DataFrame:
    """``key`` and chain: of each network or bucket in ``inner`` (family, rank, net_a, net_b) the entries of at most ``longest`` bits
    that cover it, widest first. A row for each length that occurs in the table, which has at most 33 or 129."""
    lengths = entries.groupBy("family", "rank").agg(F.collect_set("len").alias("lens"))
    each = inner.withColumn("_most", longest).join(F.broadcast(lengths), ["family", "rank"])
    each = each.withColumn("_len", F.explode(F.filter("lens", lambda n: n <= F.col("_most"))))
    net_a, net_b = network(F.col("net_a"), F.col("net_b"), F.col("_len"))
    each = each.select(*key, F.struct(*key).alias("_key"), F.col("family").alias("_f"), F.col("rank").alias("_r"), "_len", net_a.alias("_a"), net_b.alias("_b"))
    outer = entries.select(F.col("family").alias("_f"), F.col("rank").alias("_r"), F.col("len").alias("_len"),
                           F.col("net_a").alias("_a"), F.col("net_b").alias("_b"), F.struct(F.col("len"), "v").alias("_e"))
    met = each.select("_key", "_f", "_r", "_len", "_a", "_b").join(outer, ["_f", "_r", "_len", "_a", "_b"])
    return met.groupBy("_key").agg(F.sort_array(F.collect_list("_e")).alias("chain")).select("_key.*", "chain")


def _covers(probes: DataFrame, entries: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and hits: the entries (len, v) that cover the address of each probe, widest first; no row where there are none.

    ``probes`` have family, a, b and the columns ``key``; ``entries`` the columns of a network and v.
    """
    ranks = F.broadcast(entries.groupBy("family").agg(F.collect_set("rank").alias("ranks")))  # a row for each family
    asked = probes.join(ranks, "family").withColumn("rank", F.explode("ranks")).withColumn("bucket", _bucket(F.col("a")))
    chains = _around(entries.select(*NETWORK).distinct(), entries, NETWORK, F.col("len"))
    starts = asked.select(*BUCKET).distinct().withColumns({"net_a": F.col("bucket"), "net_b": F.lit(0).cast("long")})
    shorter = F.when(F.col("family") == 4, BUCKET_BITS[4]).otherwise(BUCKET_BITS[6]) - 1
    wide = _around(starts, entries, BUCKET, shorter).select(
        *BUCKET, F.col("bucket").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(-1).alias("len"), "chain")
    held = chains.withColumn("bucket", _bucket(F.col("net_a"))).select(*BUCKET, F.col("net_a").alias("x"), F.col("net_b").alias("y"), "len", "chain")
    rows = held.unionByName(wide).select(*BUCKET, "x", "y", "len", F.struct("x", "y", "chain").alias("last"))
    rows = rows.unionByName(asked.select(*BUCKET, F.col("a").alias("x"), F.col("b").alias("y"), F.lit(999).alias("len"), F.struct(*key).alias("probe")),
                            allowMissingColumns=True)
    order = Window.partitionBy(*BUCKET).orderBy(_unsigned(F.col("x")), _unsigned(F.col("y")), "len").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("last", F.last("last", ignorenulls=True).over(order)).filter("probe is not null and last is not null")
    hits = F.filter("last.chain", lambda e: in_network(F.col("x"), F.col("y"), F.col("last.x"), F.col("last.y"), e["len"]))
    return found.select("probe.*", "rank", hits.alias("hits")).filter(F.size("hits") > 0)


def _as_prefix(col):
    """A bare address becomes a host prefix."""
    c = F.col(col)
    return F.when(F.instr(c, "/") > 0, c).when(
        F.instr(c, ":") > 0, F.concat(c, F.lit("/128"))
    ).otherwise(F.concat(c, F.lit("/32")))


def lpm_join(left: DataFrame, addr_col: str, table: DataFrame, value_cols,
             prefix_col="prefix", rank_col=None) -> DataFrame:
    """Left join: the most specific table prefix that covers the address in ``addr_col``.

    ``addr_col`` holds an address or a prefix (its network address is used). Adds ``value_cols``
    and ``match_len``; null where nothing covers. Among equal prefixes the smallest values win.
    With ``rank_col`` the lowest rank that covers the address answers, whatever its length.
    """
    values = list(value_cols)
    rank = F.lit(0) if rank_col is None else F.col(rank_col)
    t = prefix_table(table, [*values, *([rank_col] if rank_col else [])], prefix_col).withColumn("rank", rank)
    t = t.groupBy(*NETWORK).agg(F.min(F.struct(*values)).alias("v"))
    p = left.select(addr_col).distinct().withColumn("_p", _as_prefix(addr_col))
    p = prefix_table(p, [addr_col], "_p").select(F.col(addr_col).alias("_addr"), "family", F.col("net_a").alias("a"), F.col("net_b").alias("b"))
    best = _covers(p, t, ["_addr"])
    if rank_col is not None:
        best = best.groupBy("_addr").agg(F.min_by("hits", "rank").alias("hits"))
    best = best.select(F.col("_addr").alias(addr_col), F.element_at("hits", -1).alias("_b"))
    best = best.select(
        addr_col, F.col("_b.len").alias("match_len"), *[F.col(f"_b.v.{v}").alias(v) for v in values])
    return left.join(best, addr_col, "left")


def covering_pairs(left: DataFrame, table: DataFrame, value_cols=(), col="prefix",
                   table_col="prefix", within=True) -> DataFrame:
    """Distinct left prefixes with every table prefix that covers them (equal or shorter).

    Without ``within`` it is enough that the network address is covered, as in ``lpm_join``.
    """
    values = list(value_cols)
    t = prefix_table(table, values, table_col).withColumns({
        "rank": F.lit(0), "v": F.struct(F.col(table_col).alias("cover"), *values)})
    p = prefix_table(left, [], col).select(F.col(col).alias("_lp"), F.col("len").alias("_plen"), "family", F.col("net_a").alias("a"), F.col("net_b").alias("b"))
    pairs = _covers(p, t, ["_lp", "_plen"]).withColumn("_e", F.explode("hits"))
    if within:
        pairs = pairs.filter(F.col("_e.len") <= F.col("_plen"))
    return pairs.select(F.col("_lp").alias(col), F.col("_plen").alias("len"), F.col("_e.len").alias("cover_len"), "_e.v.*")


def contains_join(left: DataFrame, table: DataFrame, how="covered", col="prefix",
                  flag="is_covered") -> DataFrame:
    """Add a flag: the left prefix is ``covered`` by a table prefix, ``covers`` one, or either."""
    found = []
    if how in ("covered", "either"):
        found.append(covering_pairs(left, table, col=col).select(col))
    if how in ("covers", "either"):
        lefts = left.select(F.col(col).alias("prefix")).distinct()
        rev = covering_pairs(table.select("prefix"), lefts)
        found.append(rev.select(F.col("cover").alias(col)))
    hits = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    hits = hits.distinct().withColumn(flag, F.lit(True))
    return left.join(hits, col, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
