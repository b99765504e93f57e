"""Class and leak-type tables, and the columns taken from them."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K


def _lookup(col, pairs, default) -> Column:
    key = F.col(col) if isinstance(col, str) else col
    out = F
    for k, v in pairs:
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def classes(spark) -> DataFrame:
    """The ten classes with names, priorities and tier."""
    web = K.WEB_NAMES
    rows = [c + (web.get(c[0], "Unknown"),) for c in K.CLASSES]
    return spark.createDataFrame(
        rows,
        "id int, name string, display_name string, priority int, display_priority int, "
        "tier string, web_name string",
    )


def leak_labels(spark) -> DataFrame:
    """Leak-type codes and labels."""
    return spark.createDataFrame(K.LEAK_TYPES, "leak_type int, leak_label string")


def priority(col) -> Column:
    return _lookup(col, [(c[0], c[3]) for c in K.CLASSES], 0)


def display_name(col) -> Column:
    return _lookup(col, [(c[0], c[2]) for c in K.CLASSES], "Discovery")


def display_priority(name) -> Column:
    """Priority of a display name: 3 critical, 2 bad, 1 normal, 0 the rest."""
    pairs = {c[2]: c[4] for c in K.CLASSES}
    return _lookup(name, list(pairs.items()), 0)


def leak_label(col) -> Column:
    return _lookup(col, K.LEAK_TYPES, "Unknown")
