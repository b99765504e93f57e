"""Facts the per-prefix state machine needs, joined on before the shuffle by prefix."""

from pyspark.sql import DataFrame, functions as F

from ..functions.paths import is_blackhole
from ..operators.bogons import bogon_flag
from ..operators.leaks import leak_patterns, provider_edges
from ..operators.networks import as_flags, as_names
from ..operators.rpki import rpki_status
from ..plans.classify import remembered_origins, with_historical
from ..session import cut
from ..sources import sinks
from ..sources.dims import SCHEMAS
from .. import constants as K

NO_FACTS = "asn long, as_org string, brand int, kin array<long>"


def sibling_facts(dims: dict, spark) -> DataFrame:
    """asn -> organisation, brand bits and known sibling ASNs, enough to test two ASNs for kin."""
    if dims.get("as_info") is None:
        return spark.createDataFrame([], NO_FACTS)
    brand = F.lit(0)
    for i, word in enumerate(K.BRAND_WORDS):
        brand = brand + F.when(F.instr(F.lower("as_name"), word) > 0, 1 << i).otherwise(0)
    info = as_names(dims["as_info"]).filter("asn <> 0").select("asn", "as_org", brand.alias("brand"))
    pairs = dims["as_siblings"].select(F.col("asn1").alias("asn"), F.col("asn2").alias("other"))
    pairs = pairs.unionByName(pairs.select(F.col("other").alias("asn"), F.col("asn").alias("other")))
    kin = pairs.groupBy("asn").agg(F.collect_set("other").alias("kin"))
    return info.join(kin, "asn", "full")


def _before(spark, path, batch_id, schema):
    """What earlier micro-batches wrote; a repeated one does not see its own rows."""
    kept = spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(path) if sinks.exists(
        spark, path) else spark.createDataFrame([], f"{schema}, batch long")
    return kept.filter(F.col("batch") < batch_id).drop("batch")


def start_enrich(updates: DataFrame, dims: dict, root: str, checkpoint: str, **trigger):
    """From a stream of updates to the table the classifier stream reads, ``root``/enriched.

    Provider edges and remembered origins found in a micro-batch are written to a folder of that
    batch and used from the next one on; the edges of the batch itself count as well. Only new ones
    are written, so both grow with the network and not with the updates.
    """
    spark = updates.sparkSession
    flags = cut(as_flags(dims["as_info"] if dims.get("as_info") is not None else spark.createDataFrame([], SCHEMAS["as_info"])))

    def write(batch, batch_id):
        spark = batch.sparkSession
        batch = batch.persist()
        known = _before(spark, f"{root}/edges", batch_id, "provider long, customer long, first_ts long")
        edges = cut(known.unionByName(provider_edges(batch, flags)).groupBy("provider", "customer").agg(
            F.min("first_ts").alias("first_ts")))
        edges.join(known, edges.columns, "left_anti").write.mode("overwrite").parquet(f"{root}/edges/batch={batch_id}")
        now = dict(dims)
        if dims.get("seen") is not None:
            found = _before(spark, f"{root}/remembered", batch_id, "prefix string, origin_asn long")
            now["seen"] = cut(dims["seen"].select("prefix", "origin_asn").unionByName(found))
            remembered_origins(batch, now["seen"]).write.mode("overwrite").parquet(f"{root}/remembered/batch={batch_id}")
        enrich(batch, now, edges, flags).write.mode("overwrite").parquet(f"{root}/enriched/batch={batch_id}")
        batch.unpersist()

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def enriched_schema(updates: DataFrame, dims: dict):
    """The schema of ``enrich`` for updates with the columns of a stream."""
    spark = updates.sparkSession
    flags = as_flags(spark.createDataFrame([], SCHEMAS["as_info"]))
    edges = spark.createDataFrame([], "provider long, customer long, first_ts long")
    return enrich(spark.createDataFrame([], updates.schema), dims, edges, flags).schema


def enrich(updates: DataFrame, dims: dict, edges: DataFrame, flags: DataFrame) -> DataFrame:
    """One micro-batch of updates with bogon, known origin, RPKI, sibling and leak facts.

    ``edges`` are the provider edges known by then, and what ``remembered_origins`` finds in a batch
    belongs into ``seen`` for the batches after it: ``start_enrich`` keeps both.
    """
    spark = updates.sparkSession
    df = bogon_flag(updates, dims.get("bogons"))
    df = with_historical(df, dims.get("seen")).withColumn("remember", F.lit(dims.get("seen") is not None))
    df = rpki_status(df, dims.get("roas"), "origin_asn")
    facts = sibling_facts(dims, spark)
    for asn, p in (("origin_asn", "o"), ("historical_asn", "h")):
        df = df.join(facts.select(F.col("asn").alias(asn), F.col("as_org").alias(f"{p}_org"),
                                  F.col("brand").alias(f"{p}_brand"), F.col("kin").alias(f"{p}_kin")),
                     asn, "left")
    df = leak_patterns(df, updates, flags, edges=edges)
    df = df.withColumn("blackhole", is_blackhole(F.col("comm_str")))
    return df if "event_time" in updates.columns else df.withColumn("event_time", F.timestamp_seconds("ts"))
