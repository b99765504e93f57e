"""RPKI origin validation (RFC 6811)."""

from pyspark.sql import DataFrame, functions as F

from .prefix_join import covering_pairs

NOT_LOADED, VALID, INVALID, NOT_FOUND = 0, 1, 2, 3


def rpki_status(df: DataFrame, roas: DataFrame | None, asn="asn", prefix="prefix",
                out="rpki_status") -> DataFrame:
    """Add the status of (prefix, asn): 1 valid, 2 invalid, 3 not found, 0 without ROAs.

    Only distinct (prefix, asn) pairs are validated; the verdict is joined back.
    """
    if roas is None:
        return df.withColumn(out, F.lit(NOT_LOADED))
    pairs = df.select(prefix, asn).distinct()
    cover = covering_pairs(
        pairs, roas.select("prefix", "max_len", F.col("asn").alias("_roa_asn")),
        ["max_len", "_roa_asn"], col=prefix)
    hit = (F.col("_roa_asn") == F.col(asn)) & (F.col("len") <= F.col("max_len"))
    verdict = pairs.join(cover, prefix).groupBy(prefix, asn).agg(
        F.max(F.when(hit, 1).otherwise(0)).alias("_hit"))
    verdict = verdict.select(
        prefix, asn, F.when(F.col("_hit") == 1, VALID).otherwise(INVALID).alias(out))
    return df.join(verdict, [prefix, asn], "left").withColumn(
        out, F.coalesce(F.col(out), F.lit(NOT_FOUND)))
