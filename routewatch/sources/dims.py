"""Dimension tables and location look-up."""


from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from ..operators.prefix_join import lpm_join
from ..session import cut, small

SCHEMAS = {
    "seen": "prefix string, origin_asn long",
    "roas": "prefix string, max_len int, asn long",
    "bogons": "prefix string",
    "as_info": "asn long, name string, org_name string, country string, heg_v4 double, heg_v6 double, "
               "pop_pct double, pop_users long",
    "as_siblings": "asn1 long, asn2 long",
    "geo": "prefix string, lat double, lon double, city string, country string, source_rank int",
}


def load_dims(spark, folder, fmt="parquet") -> dict:
    """The dimension tables found in ``folder`` as ``<name>.<fmt>``; absent ones are None."""
    out = {}
    for name, schema in SCHEMAS.items():
        path = f"{folder}/{name}.{fmt}"
        try:
            table = spark.read.format(fmt).schema(schema).load(path)
            table.isEmpty()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            table = None
        out[name] = table
    return out


def geo_enrich(updates: DataFrame, geo: DataFrame) -> DataFrame:
    """Location by prefix address, else by peer address, else (0, 0).

    Several location tables are asked in order of ``source_rank``: the first that covers the
    address answers with its most specific entry.
    """
    found = updates.drop("lat", "lon", "city", "country")
    for col in ("prefix", "peer"):
        # One row per address, looked up once; the updates themselves are joined once.
        table = geo.select("prefix", "source_rank", F.struct("lat", "lon", "city", "country").alias(f"_{col}"))
        spots = lpm_join(updates.select(col).distinct(), col, table.withColumnRenamed("prefix", "net"),
                         [f"_{col}"], "net", "source_rank")
        found = found.join(small(cut(spots.drop("match_len"))), col, "left")
    spot = F.coalesce("_prefix", "_peer")
    return found.withColumns({
        "lat": F.coalesce(spot["lat"], F.lit(0.0)), "lon": F.coalesce(spot["lon"], F.lit(0.0)),
        "city": spot["city"], "country": spot["country"]}).drop("_prefix", "_peer")
