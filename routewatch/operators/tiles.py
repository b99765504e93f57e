"""Events on the map: tiles per interval and pixel cells."""

import math

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K


def quantise(coord) -> Column:
    """``trunc(x * 10)`` in 32-bit float."""
    return (F.col(coord).cast("float") * F.lit(10.0).cast("float")).cast("int")


def dequantise(q) -> Column:
    return F.col(q) / F.lit(10.0)


def tiles(events: DataFrame, interval="500 milliseconds") -> DataFrame:
    """Events per (interval, tile of a tenth of a degree, class). Works on streams too."""
    at = F.col("event_time") if "event_time" in events.columns else F.timestamp_seconds("ts")
    out = events.groupBy(
        F.window(at, interval).alias("w"), quantise("lat").alias("lat_q"), quantise("lon").alias("lon_q"),
        "classification").agg(F.count("*").alias("n_events"))
    return out.select(
        F.unix_millis("w.start").alias("window_ms"), dequantise("lat_q").alias("lat"),
        dequantise("lon_q").alias("lon"), "classification", "n_events")


def fine_tiles(events: DataFrame, interval="100 milliseconds") -> DataFrame:
    """Events per (interval, hundredth of a degree, class); rows without a place are dropped."""
    at = F.col("event_time") if "event_time" in events.columns else F.timestamp_seconds("ts")
    placed = events.filter((F.col("lat") != 0) | (F.col("lon") != 0))
    cell = lambda c: F.round(F.col(c) * 100, 0) / 100
    out = placed.groupBy(F.window(at, interval).alias("w"), cell("lat").alias("lat"), cell("lon").alias("lon"),
                         "classification").agg(F.count("*").alias("n_events"))
    return out.select(F.unix_millis("w.start").alias("window_ms"), "lat", "lon", "classification", "n_events")


def project(lat: Column, lon: Column, width: int, height: int, scale: float):
    """Mollweide x and y of a coordinate.

    The auxiliary angle t solves 2t + sin 2t = pi sin(lat); Newton's method on u = 2t, ten steps from
    u = 2 lat, which suffice within the latitudes of the map.
    """
    lat = F.radians(F.least(F.greatest(lat, F.lit(-K.MAP_LATITUDE)), F.lit(K.MAP_LATITUDE)))
    target = F.pi() * F.sin(lat)
    u = F.aggregate(F.sequence(F.lit(1), F.lit(10)), lat * 2.0,
                    lambda u, _: u - (u + F.sin(u) - target) / F.greatest(F.cos(u) + 1.0, F.lit(1e-12)))
    radius = math.sqrt(2.0) * scale
    return (F.lit(width / 2.0) + F.radians(lon) * F.cos(u / 2.0) * (2.0 * radius / math.pi),
            F.lit(height / 2.0) - F.sin(u / 2.0) * radius)


def map_cells(events: DataFrame, width=1920, height=1080, scale=380.0, cell=8) -> DataFrame:
    """Events per square of ``cell`` pixels. Coordinates repeat, so they are projected once each."""
    per = events.filter((F.col("lat") != 0) | (F.col("lon") != 0)).groupBy("lat", "lon").agg(
        F.count("*").alias("n"))
    x, y = project(F.col("lat"), F.col("lon"), width, height, scale)
    per = per.select("n", F.floor(x / cell).cast("long").alias("cell_x"), F.floor(y / cell).cast("long").alias("cell_y"))
    return per.groupBy("cell_x", "cell_y").agg(F.sum("n").alias("n_events"))
