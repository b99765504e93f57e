"""Session and checkpoint settings."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def get_spark(master="local[*]", shuffle_partitions=8, app="routewatch"):
    """A session with the settings the operators expect; a cluster passes its own instead."""
    return (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        # a join on (prefix, update_id) may use rows that already lie by prefix
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, the one ``cut`` writes to."""
    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"


def compiled(spark: SparkSession) -> None:
    """Set the largest method Spark generates to HotSpot's own limit, unless the session names one.

    The long projections of these plans pass it; left at Spark's default of 65535 bytes they run interpreted, as
    HotSpot compiles no method over 8000. Spark's documentation names this value for HotSpot.
    """
    if spark.conf.get(HUGE_METHOD, None) is None:
        spark.conf.set(HUGE_METHOD, "8000")


def _shared(spark: SparkSession) -> str:
    compiled(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if sc.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            shared = tempfile.mkdtemp(prefix="routewatch-ckpt-")
        sc.setCheckpointDir(shared)
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only where a local
    session names none (tests) a temporary folder is set; a cluster must name a shared one.
    """
    _shared(df.sparkSession)
    return df.checkpoint()


BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def _width(kind):
    """Bytes of a value of a type, about, where all values take the same; else None."""
    if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)):
        return None
    if isinstance(kind, T.StructType):
        parts = [_width(f.dataType) for f in kind.fields]
        return None if None in parts else 8 + sum(parts)
    return 8


def _bytes(column, kind) -> Column:
    """Bytes that a value takes, about; what is nested and has texts in it counts as JSON."""
    width = _width(kind)
    if width is not None:
        return F.lit(width).cast("long")
    if isinstance(kind, T.ArrayType) and _width(kind.elementType) is not None:
        size = F.greatest(F.size(column), F.lit(0)) * _width(kind.elementType)
    else:
        size = F.octet_length(column if isinstance(kind, (T.StringType, T.BinaryType)) else F.to_json(column))
    return F.coalesce(size, F.lit(0)).cast("long")


def small(df: DataFrame, rows=BROADCAST_ROWS, size=BROADCAST_BYTES) -> DataFrame:
    """A written-out table as broadcast side if it has few rows and bytes, else as it is (shuffled join)."""
    if df.limit(rows + 1).count() > rows:
        return df
    of_row = sum((_bytes(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(0).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(of_row)).first()[0] or 0) <= size else df
