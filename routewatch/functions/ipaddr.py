"""IP prefixes as columns.

An address is two longs of 64 bits each, ``a`` and ``b``, read from the left: an IPv4 address fills the upper half
of ``a``, an IPv6 address both. The network of n bits is what a mask leaves of them, for both families and any n.
"""

from pyspark.sql import Column, DataFrame, functions as F

V4_PATTERN = r"^\d{1,3}(\.\d{1,3}){3}$"
V6_PATTERN = r"^([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)?(::([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)?)?$"


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``; without it a column used n times is n copies in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv4_to_long(addr) -> Column:
    """Dotted IPv4 address as a long; 0 when it is not one."""
    addr = F.col(addr) if isinstance(addr, str) else addr
    return F.coalesce(_v4_number(addr), F.lit(0).cast("long"))


def _v4_number(addr: Column) -> Column:
    """The address as a number; null unless it is four octets."""
    octets = F.transform(F.split(addr, r"\."), lambda o: o.try_cast("long"))
    zero = F.lit(0).cast("long")
    valid = addr.rlike(V4_PATTERN) & F.forall(octets, lambda o: o <= 255)
    return F.when(valid, F.aggregate(octets, zero, lambda so_far, o: so_far * 256 + o))


def _v6_halves(addr: Column) -> Column:
    """struct(a, b); null unless it is eight groups, where one ``::`` stands for the missing ones."""
    short = F.instr(addr, "::") > 0
    given = F.size(F.filter(F.split(addr, ":"), lambda g: g != ""))
    zeros = F.when(given < 8, F.repeat(F.lit("0:"), F.lit(8) - given)).otherwise("")
    full = F.when(short, F.replace(addr, F.lit("::"), F.concat(F.lit(":"), zeros))).otherwise(addr)
    groups = F.transform(F.filter(F.split(full, ":"), lambda g: (g != "") | ~short), lambda g: F.conv(g, 16, 10).cast("long"))
    zero = F.lit(0).cast("long")
    half = lambda g, first: F.aggregate(F.slice(g, first, 4), zero, lambda so_far, x: F.shiftleft(so_far, 16).bitwiseOR(x))
    valid = addr.rlike(V6_PATTERN) & (F.size(groups) == 8)
    halves = let(groups, lambda g: F.struct(half(g, 1).alias("a"), half(g, 5).alias("b")))
    return F.when(valid, F.when(halves["a"].isNotNull() & halves["b"].isNotNull(), halves))


def address(addr: Column) -> Column:
    """struct(family, a, b) of an IPv4 or IPv6 address; null when it is neither."""
    v4 = _v4_number(addr)
    wide = lambda n: F.when(n.isNotNull(), F.struct(F.lit(4).alias("family"), F.shiftleft(n, 32).alias("a"), F.lit(0).cast("long").alias("b")))
    long = lambda h: F.when(h.isNotNull(), F.struct(F.lit(6).alias("family"), h["a"].alias("a"), h["b"].alias("b")))
    return F.when(F.instr(addr, ":") > 0, let(_v6_halves(addr), long)).otherwise(let(v4, wide))


def _ones(n: Column) -> Column:
    """A long whose first n bits are set, n from 0 to 64."""
    return F.when(n <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), F.lit(64) - F.least(n, F.lit(64))))


def network(a: Column, b: Column, length: Column) -> tuple[Column, Column]:
    """Both halves of the network of the first ``length`` bits."""
    return a.bitwiseAND(_ones(length)), b.bitwiseAND(_ones(length - 64))


def in_network(a: Column, b: Column, other_a: Column, other_b: Column, length: Column) -> Column:
    """Whether two addresses of one family have the first ``length`` bits in common."""
    x, y = network(a.bitwiseXOR(other_a), b.bitwiseXOR(other_b), length)
    return (x == 0) & (y == 0)


def is_ipv4(prefix) -> Column:
    """Family test used by every count: no colon in the text."""
    return F.instr(prefix, ":") == 0


def ipv4_size(prefix) -> Column:
    """``2^(32-len)``; 0 when there is not exactly one ``/`` or the length is not in 0..32.

    The family is not looked at, so a short IPv6 prefix gets the IPv4 formula.
    """
    parts = F.split(prefix, "/")
    length = F.regexp_extract(F.try_element_at(parts, F.lit(2)), r"^\s*([+-]?\d+)", 1).try_cast("int")
    ok = (F.size(parts) == 2) & length.between(0, 32)
    return F.when(ok, F.pow(F.lit(2), F.lit(32) - length).cast("long")).otherwise(
        F.lit(0).cast("long")
    )


def _prefix_facts(prefix: Column) -> Column:
    """struct(address, len) of an ``address/length`` text; null when malformed."""
    both = F.struct(
        address(F.split_part(prefix, F.lit("/"), F.lit(1))).alias("address"),
        F.regexp_extract(prefix, r"^[^/]*/(\d{1,3})$", 1).try_cast("int").alias("len"))
    return let(both, lambda p: F.when(p["len"] <= F.when(p["address"]["family"] == 4, 32).when(p["address"].isNotNull(), 128), p))


def _spread(df: DataFrame) -> DataFrame:
    """Columns family, len, a, b, net_a, net_b, size, lo, hi from the parsed struct ``_facts``."""
    df = df.select("*", "_facts.address.family", "_facts.address.a", "_facts.address.b", "_facts.len").drop("_facts")
    net_a, net_b = network(F.col("a"), F.col("b"), F.col("len"))
    v4 = F.col("family") == 4
    df = df.withColumns({"net_a": net_a, "net_b": net_b})
    df = df.withColumns({
        "size": F.when(v4, F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(32) - F.col("len"))),
        "lo": F.when(v4, F.shiftrightunsigned("net_a", 32))})
    return df.withColumn("hi", F.col("lo") + F.col("size") - 1)


def with_prefix_cols(df: DataFrame, col="prefix") -> DataFrame:
    """Add family (4/6), len, the address (a, b) and its network (net_a, net_b), and for IPv4 size, lo, hi; null if malformed."""
    return _spread(df.withColumn("_facts", _prefix_facts(F.col(col))))


def prefix_table(df: DataFrame, cols=(), col="prefix") -> DataFrame:
    """Distinct (prefix, *cols) rows of well-formed prefixes with the columns of
    ``with_prefix_cols``. Parsing happens once per distinct row, and as an aggregate result, so
    that the optimizer does not copy the parser into every filter and join key.
    """
    keys = [col, *cols]
    rows = df.select(*keys).distinct().groupBy(*keys).agg(
        F.any_value(_prefix_facts(F.col(col))).alias("_facts"))
    return _spread(rows.filter("_facts is not null"))


def hash32(col) -> Column:
    """Mix a 32-bit value: two multiply-xorshift rounds and a final xorshift."""
    word = 0xFFFFFFFF
    mult = 0x45D9F3B  # fixed value
    x = F.col(col).cast("long") if isinstance(col, str) else col.cast("long")
    for _ in range(2):
        y = F.shiftrightunsigned(x, 16).bitwiseXOR(x)
        # 32-bit product from 16-bit halves, so that no step leaves the long range
        low = y.bitwiseAND(F.lit(0xFFFF)) * F.lit(mult)
        high = F.shiftleft((F.shiftrightunsigned(y, 16) * F.lit(mult)).bitwiseAND(F.lit(0xFFFF)).cast("long"), 16)
        x = (low + high).bitwiseAND(F.lit(word).cast("long"))
    return F.shiftrightunsigned(x, 16).bitwiseXOR(x)
