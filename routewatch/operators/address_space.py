"""IPv4 address space: distinct coverage and range decomposition."""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.ipaddr import prefix_table

SLASH8 = 1 << 24


def covered_ipv4(df: DataFrame, by=(), col="prefix") -> DataFrame:
    """Distinct IPv4 addresses covered per group; overlaps and nesting count once.

    Prefixes shorter than /8 are cut into /8 pieces, so the interval union runs per (group, /8)
    and one group never sits in one task. Equal prefixes are dropped before the window.
    """
    by = list(by)
    p = prefix_table(df, by, col).filter("family = 4")
    pieces = p.select(
        *by, "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") / SLASH8), F.floor(F.col("hi") / SLASH8))).alias("slash8"),
    ).select(
        *by, "slash8",
        F.greatest("lo", F.col("slash8") * SLASH8).alias("lo"),
        F.least("hi", F.col("slash8") * SLASH8 + SLASH8 - 1).alias("hi"),
    ).distinct()
    w = Window.partitionBy(*by, "slash8").orderBy("lo", F.desc("hi")).rowsBetween(
        Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("hi").over(w), F.lit(-1))
    new = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo") - 1, seen))
    out = pieces.withColumn("new", new).groupBy(*by, "slash8").agg(F.sum("new").alias("n"))
    return out.groupBy(*by).agg(F.sum("n").cast("long").alias("ipv4_count"))


def ranges_to_cidrs(df: DataFrame, start="start_ip", end="end_ip") -> DataFrame:
    """Rows of [start, end] address ranges -> their minimal CIDR blocks (network, len, cidr).

    A block of size 2^k is in the answer when it is aligned, inside the range, and its parent
    block is not inside the range. Both ends can contribute at most one block per size, so two
    blocks of every size up to the range's own are tried, without any loop over addresses.
    """
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    cand = df.filter(s <= e).withColumn("k", F.explode(F.sequence(F.lit(0), F.length(F.bin(e - s + 1)) - 1)))
    size = F.pow(F.lit(2), F.col("k")).cast("long")
    first = F.ceil(s / size).cast("long") * size
    last = F.floor((e + 1) / size).cast("long") * size - size
    cand = cand.withColumn("size", size).withColumn(
        "network", F.explode(F.array_distinct(F.array(first, last))))
    n, z = F.col("network"), F.col("size")
    inside = (n >= s) & (n + z - 1 <= e)
    parent = n - F.pmod(n, z * 2)
    parent_in = (F.col("k") < 32) & (parent >= s) & (parent + z * 2 - 1 <= e)
    out = cand.filter(inside & ~parent_in).withColumn("len", (F.lit(32) - F.col("k")).cast("int"))
    octet = lambda sh: F.shiftright(n, sh).bitwiseAND(F.lit(255)).cast("string")
    text = F.concat(F.concat_ws(".", octet(24), octet(16), octet(8), octet(0)), F.lit("/"),
                    F.col("len").cast("string"))
    return out.withColumn("cidr", text).drop("k", "size")
