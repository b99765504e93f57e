"""Message totals, rates, lag and trend series."""

from pyspark.sql import DataFrame, Window, functions as F

from .. import constants as K

HOUR = 3600


def message_totals(events: DataFrame, by=()) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("msg_count"))


def message_rates(events: DataFrame, by=(), w=60) -> DataFrame:
    """Per second with a message: messages per second over the last ``w`` seconds (1..60).

    Rows are counted per second first. Windows run per hour of each group, where the seconds
    that reach into the next hour are handed to it as well, so no group is one task.
    """
    w, by = max(1, min(60, w)), list(by)
    sec = events.groupBy(*by, "ts").agg(F.count("*").alias("n"))
    hours = F.array_distinct(F.array(F.floor(F.col("ts") / HOUR), F.floor((F.col("ts") + w - 1) / HOUR)))
    sec = sec.withColumn("_hour", F.explode(hours))
    win = Window.partitionBy(*by, "_hour").orderBy("ts").rangeBetween(-(w - 1), 0)
    sec = sec.withColumn("rate", F.sum("n").over(win) / F.lit(float(w)))
    return sec.filter(F.col("_hour") == F.floor(F.col("ts") / HOUR)).drop("_hour")


def current_rates(events: DataFrame, now: int, start: int, by=()) -> DataFrame:
    """Per group: total, messages of the last 60 s, and their rate over min(elapsed, 60)."""
    span = float(min(max(now - start, 1), 60))
    recent = F.col("ts").between(now - 59, now)
    return events.filter(F.col("ts") <= now).groupBy(*by).agg(
        F.count("*").alias("total_count"), F.count(F.when(recent, 1)).alias("window_count"),
    ).withColumn("rate", F.col("window_count") / F.lit(span))


def max_lag(df: DataFrame, interval="1 minute") -> DataFrame:
    """Largest arrival delay per arrival window."""
    return df.groupBy(F.window(F.timestamp_seconds("arrival_ts"), interval).alias("w")).agg(
        F.max(F.greatest(F.col("arrival_ts") - F.col("ts"), F.lit(0))).alias("max_lag")
    ).select(F.unix_timestamp("w.start").alias("window_start"), "max_lag")


TREND = {"discovery": [0, 9], "hunting": [8], "flap": [6], "outage": [4], "leak": [3], "hijack": [2],
         "ddos": [5]}


def trend(events: DataFrame, now: int, length=120) -> DataFrame:
    """The last ``length`` one-second snapshots of the class rates (60 s rates).

    A second's count adds to the sixty snapshots that follow it, so the series is one aggregate.
    """
    spark = events.sparkSession
    axis = spark.range(now - length + 1, now + 1).select(F.col("id").alias("second"))
    sec = events.filter(F.col("ts").between(now - length - 58, now)).groupBy("ts", "classification").agg(
        F.count("*").alias("n"))
    sec = sec.withColumn("second", F.explode(F.sequence("ts", F.col("ts") + 59)))
    sums = sec.groupBy("second").agg(*[
        (F.sum(F.when(F.col("classification").isin(ids), F.col("n")).otherwise(0)) / F.lit(60.0)).alias(name)
        for name, ids in TREND.items()])
    return axis.join(sums, "second", "left").na.fill(0.0)


def event_composition(events: DataFrame) -> DataFrame:
    """Share of beacon, research and organic events; the beacon test comes first."""
    from .networks import beacons
    from .prefix_join import contains_join

    n = events.groupBy("prefix", "asn").agg(F.count("*").alias("n"))
    n = contains_join(n, beacons(events.sparkSession), "either", flag="is_beacon")
    research = F.col("asn").isin([a for a, _ in K.EXCLUDED_ASNS])
    kind = F.when(F.col("is_beacon"), "BEACON").when(research, "RESEARCH").otherwise("ORGANIC")
    per = n.groupBy(kind.alias("type")).agg(F.sum("n").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return per.crossJoin(F.broadcast(total)).select(
        "type", F.col("n").alias("events"), (F.col("n") * 100.0 / F.col("total")).alias("percentage"))
