"""SQL pieces for the check queries: the derived tables and prefixes as 32-bit numbers.

The derived IPv6 prefixes use only their first two groups, so 32 bits hold them as well.
"""

from .fixtures import duckdb_ctes


def sql(tables, body, extra="", recursive=False):
    ctes = duckdb_ctes(*tables)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{', ' + extra if extra else ''} {body}"


FAMILY = "CASE WHEN instr({p}, ':') > 0 THEN 6 ELSE 4 END"
LENGTH = "CAST(split_part({p}, '/', 2) AS INT)"
ADDR = """CASE WHEN instr({p}, ':') > 0 THEN
  CAST(concat('0x', split_part({p}, ':', 1)) AS BIGINT) * 65536 +
  CAST(concat('0x', CASE WHEN split_part({p}, ':', 2) = '' THEN '0' ELSE split_part({p}, ':', 2) END) AS BIGINT)
 ELSE CAST(split_part({p}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({p}, '.', 2) AS BIGINT) * 65536 +
  CAST(split_part({p}, '.', 3) AS BIGINT) * 256 + CAST(split_part(split_part({p}, '.', 4), '/', 1) AS BIGINT) END"""


def numbers(col="prefix"):
    """Select list: fam, len, a of a prefix column."""
    return ", ".join(f"{e.replace('{p}', col)} AS {n}" for e, n in ((FAMILY, "fam"), (LENGTH, "len"), (ADDR, "a")))


def parsed(name, table, cols="prefix", col="prefix"):
    return f"{name} AS (SELECT DISTINCT {cols}, {numbers(col)} FROM {table})"


def at(q, p):
    """q covers the address of p."""
    shift = f"(32 - least({q}.len, 32))"
    return f"{q}.fam = {p}.fam AND ({p}.a >> {shift}) = ({q}.a >> {shift})"


def covers(q, p):
    """q covers p."""
    return f"{at(q, p)} AND {q}.len <= {p}.len"
