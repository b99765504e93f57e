"""Bogon test of prefixes."""

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions.ipaddr import prefix_table
from .prefix_join import contains_join, covering_pairs


def bogon_flag(df: DataFrame, bogons: DataFrame | None, col="prefix") -> DataFrame:
    """Add is_bogon: covered by the bogon list or, without a list, by address class.

    The address-class rule looks at the address as written, whatever the prefix length.
    """
    if bogons is not None:
        return contains_join(df, bogons, "covered", col, "is_bogon")
    spark = df.sparkSession
    martians = spark.createDataFrame([(p,) for p in K.MARTIAN_NETWORKS], "prefix string")
    p = prefix_table(df, [], col)
    host = F.concat(F.split_part(F.col(col), F.lit("/"), F.lit(1)),
                    F.when(F.col("family") == 4, "/32").otherwise("/128"))
    p = p.select(col, host.alias("_host"))
    hits = p.join(covering_pairs(p.select(F.col("_host").alias("prefix")), martians).select(
        F.col("prefix").alias("_host")).distinct(), "_host").select(col, F.lit(True).alias("is_bogon"))
    return df.join(hits, col, "left").withColumn("is_bogon", F.coalesce("is_bogon", F.lit(False)))
