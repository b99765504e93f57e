"""Readers of routing feeds."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import origin_asn, path_len_from_text

UPDATE_SCHEMA = ("update_id long, ts long, prefix string, host string, peer string, is_withdrawal boolean, "
                 "origin_asn long, path_str string, path_len int, comm_str string, source string")

# A message as the RIS live feed sends it. Path members are numbers, or arrays for AS sets, so the
# path is read as text members and taken apart below.
RIS_SCHEMA = ("type string, data struct<timestamp:double, peer:string, peer_asn:string, id:string, host:string, "
              "type:string, path:array<string>, community:array<array<long>>, origin:string, "
              "announcements:array<struct<next_hop:string, prefixes:array<string>>>, withdrawals:array<string>>")


def read_ris_json(spark, path, streaming=False, max_files=None) -> DataFrame:
    """JSON messages, one per line, to one row per announced or withdrawn prefix.

    Lines that are no update message give no rows. ``host`` and ``peer`` are both the peer address.
    ``event_time`` keeps the microsecond and ``update_id`` the order inside a second, see ``_order_id``.
    """
    reader = spark.readStream if streaming else spark.read
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return ris_rows(reader.format("text").load(path))


# The collector ends a message id in a hexadecimal counter that grows per peer.
COUNTER = r"([0-9A-Fa-f]{1,4})$"


def _order_id(us, msg_id, withdrawn, *identity) -> Column:
    """Grows with (microsecond in the second, message counter, withdrawn before announced).

    The low 26 bits are a hash of the row's identity, the same on every re-read. Rows of equal order
    differ in it unless they share prefix, peer and message, up to a chance of one in 67 million.
    """
    counter = F.coalesce(F.conv(F.regexp_extract(msg_id, COUNTER, 1), 16, 10).cast("long"), F.lit(0).cast("long"))
    low = F.shiftrightunsigned(F.xxhash64(*identity), 38)
    return (F.shiftleft(F.pmod(us, F.lit(1_000_000)), 43) + F.shiftleft(counter, 27)
            + F.shiftleft((~withdrawn).cast("long"), 26) + low)


def ris_rows(lines: DataFrame, col="value") -> DataFrame:
    """Parsed feed messages from a text column (also a Kafka value)."""
    m = lines.select(F.from_json(F.col(col), RIS_SCHEMA).alias("m")).filter(
        "m.type = 'ris_message' and m.data.type = 'UPDATE'").select("m.data.*")
    # [1, 2, [3, 4]] -> "1 2 {3,4}"
    path = F.array_join(F.transform(F.coalesce("path", F.array()), lambda p: F.when(
        p.startswith("["), F.concat(F.lit("{"), F.regexp_replace(p, r"[\[\]\s]", ""), F.lit("}"))).otherwise(p)), " ")
    comm = F.array_join(F.transform(F.coalesce("community", F.array().cast("array<array<bigint>>")), lambda c: F.array_join(
        c.cast("array<string>"), ":")), " ")
    us = F.round(F.col("timestamp") * 1_000_000).cast("long")
    m = m.select(us.alias("us"), F.floor(us / 1_000_000).cast("long").alias("ts"), "peer", "id", path.alias("path_str"), comm.alias("comm_str"),
                 "announcements", "withdrawals")
    announced = F.flatten(F.transform(F.coalesce("announcements", F.array().cast(
        "array<struct<next_hop:string,prefixes:array<string>>>")), lambda a: F.transform(
        a["prefixes"], lambda p: F.struct(p.alias("prefix"), F.lit(False).alias("is_withdrawal")))))
    withdrawn = F.transform(F.coalesce("withdrawals", F.array().cast("array<string>")), lambda p: F.struct(
        p.alias("prefix"), F.lit(True).alias("is_withdrawal")))
    rows = m.select("*", F.posexplode(F.concat(announced, withdrawn)).alias("pos", "e"))
    gone = F.col("e.is_withdrawal")
    text = F.when(gone, "").otherwise(F.col("path_str"))
    return rows.select(
        _order_id(F.col("us"), F.col("id"), gone, "us", "peer", "id", "pos", "e.prefix").alias("update_id"),
        "ts", F.timestamp_micros("us").alias("event_time"), F.col("e.prefix").alias("prefix"), F.col("peer").alias("host"), "peer", gone.alias("is_withdrawal"),
        F.when(gone, F.lit(0).cast("long")).otherwise(origin_asn(F.lit(0).cast("long"), text)).alias("origin_asn"),
        text.alias("path_str"), F.when(gone, 0).otherwise(path_len_from_text(text)).alias("path_len"),
        F.when(gone, "").otherwise(F.col("comm_str")).alias("comm_str"), F.lit("ris").alias("source"))


def kafka_rows(values: DataFrame, col="value"):
    """(rows, rejected) of a text column of decoded updates: JSON in the update schema.

    ``rejected`` holds the texts that are no update with a prefix and a time; write them next to the
    rows, so that nothing is lost unseen.
    """
    both = values.select(F.col(col).cast("string").alias("value")).withColumn("u", F.from_json("value", UPDATE_SCHEMA))
    good = F.col("u.prefix").isNotNull() & F.col("u.ts").isNotNull()
    return both.filter(good).select("u.*"), both.filter(~F.coalesce(good, F.lit(False))).select("value")


def read_kafka(spark, servers, pattern, **options):
    """(rows, rejected) of the Kafka topics that match ``pattern`` and carry decoded updates.

    Needs the Kafka connector on the class path; binary BMP decoding is outside this package.
    """
    return kafka_rows(spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
                      .option("subscribePattern", pattern).options(**options).load())


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Feeds in one schema. RouteViews rows share the host name of the collector project."""
    def normal(df):
        host = F.when(F.col("source") == "routeviews", "routeviews").otherwise(F.col("peer"))
        return df.withColumns({"host": host, "path_len": F.col("path_len").cast("int")})

    out = normal(feeds[0])
    for f in feeds[1:]:
        out = out.unionByName(normal(f), allowMissingColumns=True)
    return out
