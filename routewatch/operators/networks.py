"""AS names, sizes, siblings, and enrichment by ASN."""

from pyspark.sql import DataFrame, functions as F

from .. import constants as K


def one_per_asn(as_info: DataFrame) -> DataFrame:
    """One row per ASN, so that joins on it never multiply rows: the smallest, column by column as they stand, nulls first."""
    others = [c for c in as_info.columns if c != "asn"]
    return as_info.groupBy("asn").agg(F.min(F.struct(*others)).alias("_row")).select("asn", "_row.*")


def as_names(as_info: DataFrame) -> DataFrame:
    """asn -> display name (organisation, else a telling name, else the name) and organisation."""
    org, name, asn = F.col("org_name"), F.col("name"), F.col("asn")
    telling = (F.upper(name) != F.concat(F.lit("AS"), asn)) & (F.upper(name) != F.concat(F.lit("AS "), asn))
    return one_per_asn(as_info).select(
        "asn",
        F.when(org != "", org).when((name != "") & telling, name).when(name != "", name).otherwise(
            org).alias("as_name"),
        org.alias("as_org"),
        F.when(org.isNotNull(), org).when(name != "", name).alias("rank_org"))


def with_as_names(df: DataFrame, as_info: DataFrame, asn="asn") -> DataFrame:
    """Enrich rows with as_name and organization; empty text where unknown or ASN 0."""
    names = as_names(as_info).filter("asn <> 0").select(
        F.col("asn").alias(asn), "as_name", F.col("as_org").alias("organization"))
    return df.join(names, asn, "left").withColumns({
        "as_name": F.coalesce("as_name", F.lit("")),
        "organization": F.coalesce("organization", F.lit(""))})


def as_flags(as_info: DataFrame) -> DataFrame:
    """asn -> is_tier1, is_large; the fixed lists hold also without a row in ``as_info``."""
    fixed = as_info.sparkSession.createDataFrame(
        [(a,) for a in K.TIER1_ASNS + K.LARGE_ASNS], "asn long")
    df = one_per_asn(as_info).select("asn", "heg_v4", "heg_v6", "pop_pct", "pop_users").join(fixed, "asn", "full")
    more = lambda c, x: F.coalesce(F.col(c) > x, F.lit(False))
    return df.select(
        "asn",
        (more("heg_v4", 0.05) | more("heg_v6", 0.05) | F.col("asn").isin(K.TIER1_ASNS)).alias("is_tier1"),
        (more("pop_pct", 0.01) | more("pop_users", 10_000_000) | more("heg_v4", 0.01)
         | more("heg_v6", 0.01) | F.col("asn").isin(K.LARGE_ASNS)).alias("is_large"))


def siblings(pairs: DataFrame, as_info: DataFrame, as_siblings: DataFrame, a="asn1", b="asn2") -> DataFrame:
    """Add is_sibling to (asn1, asn2) rows: equal, a known pair, same organisation, same brand."""
    todo = pairs.select(a, b).distinct()
    known = as_siblings.select(F.col("asn1").alias(a), F.col("asn2").alias(b))
    known = known.unionByName(known.select(F.col(b).alias(a), F.col(a).alias(b))).distinct().withColumn(
        "_pair", F.lit(True))
    info = as_names(as_info).filter("asn <> 0")
    # One bit per brand word, so that two names share a brand when their bits overlap.
    brand = F.lit(0)
    for i, word in enumerate(K.BRAND_WORDS):
        brand = brand + F.when(F.instr(F.lower("as_name"), word) > 0, 1 << i).otherwise(0)
    info = info.select("asn", "as_org", brand.alias("brand"))
    left = info.select(F.col("asn").alias(a), F.col("as_org").alias("_o1"), F.col("brand").alias("_b1"))
    right = info.select(F.col("asn").alias(b), F.col("as_org").alias("_o2"), F.col("brand").alias("_b2"))
    todo = todo.join(known, [a, b], "left").join(left, a, "left").join(right, b, "left")
    flag = (
        (F.col(a) == F.col(b)) | F.col("_pair").isNotNull()
        | F.coalesce(F.col("_o1") == F.col("_o2"), F.lit(False))
        | F.coalesce(F.col("_b1").bitwiseAND(F.col("_b2")) != 0, F.lit(False)))
    return pairs.join(todo.select(a, b, flag.alias("is_sibling")), [a, b], "left")


def excluded_category(df: DataFrame, asn="asn") -> DataFrame:
    """Add the exclusion category of an ASN; null for the rest. The table has nine rows."""
    table = df.sparkSession.createDataFrame(K.EXCLUDED_ASNS, f"{asn} long, excluded_category string")
    return df.join(F.broadcast(table), asn, "left")


def beacons(spark) -> DataFrame:
    return spark.createDataFrame([(p,) for p in K.BEACON_PREFIXES], "prefix string")


def is_beacon(df: DataFrame, col="prefix") -> DataFrame:
    """Add is_beacon: the prefix overlaps one of the beacon prefixes, in either direction."""
    from .prefix_join import contains_join

    return contains_join(df, beacons(df.sparkSession), "either", col, "is_beacon")
