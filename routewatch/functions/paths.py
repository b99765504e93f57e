"""AS paths and communities as columns."""

from pyspark.sql import Column, functions as F


def parse_path(path_str) -> Column:
    """Numeric 32-bit tokens of the path, consecutive repeats dropped."""
    tokens = F.filter(F.split(F.trim(path_str), r"\s+"), lambda t: t.rlike(r"^\+?\d{1,10}$"))
    asns = F.filter(F.transform(tokens, lambda t: t.cast("long")), lambda a: a <= 4294967295)
    return F.aggregate(
        asns,
        F.array().cast("array<bigint>"),
        lambda path, a: F.when(F.get(path, F.size(path) - 1) == a, path).otherwise(
            F.concat(path, F.array(a))),
    )


def origin_asn(given, path_str) -> Column:
    """The given origin if not 0, else the last path token if numeric, else 0."""
    last = F.element_at(F.split(F.trim(path_str), r"\s+"), -1)
    asn = F.when(last.rlike(r"^\+?\d{1,10}$"), last.cast("long"))
    return F.coalesce(
        F.nullif(given, F.lit(0).cast("long")), F.when(asn <= 4294967295, asn), F.lit(0).cast("long")
    )


def path_len(segments) -> Column:
    """Members over all segments; every member of a set counts."""
    return F.coalesce(
        F.aggregate(segments, F.lit(0), lambda n, seg: n + F.size(seg)), F.lit(0)
    )


def path_len_from_text(path_str) -> Column:
    """Members of a textual path; ``{a,b}`` and ``(a b)`` segments count every member."""
    members = F.regexp_extract_all(F.coalesce(path_str, F.lit("")), F.lit(r"\d+"), F.lit(0))
    return F.size(members)


def is_blackhole(comm_str) -> Column:
    """Any community token that ends in ``:666``."""
    return F.exists(F.split(F.coalesce(comm_str, F.lit("")), r"\s+"), lambda t: t.endswith(":666"))
