"""Helpers of the operators: whole texts, salts, the shared folder, and files written by tasks."""

import functools
import operator
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A key's rows go to this many groups before they meet; at most 63, as a bit set of salts is one long.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(docs: DataFrame, column="text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def salt_of(*columns) -> Column:
    """A salt that depends on the row's own values, so a task run again gives the same one."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def salt_bit(salt: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), salt)


def one_row_per_salt(df: DataFrame, mask="salts", into="salt") -> DataFrame:
    """A row for each salt in the bit set ``mask``: as many as the key has salted groups, never more."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda b: F.col(mask).bitwiseAND(salt_bit(b)) != 0)
    return df.withColumn(into, F.explode(bits)).drop(mask)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``. A local session without that setting (tests) gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="routewatch-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and outlives executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``written`` made and nothing reads any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        files, path = file_system(folder)
        files.delete_dir(path)


def file_system(uri: str):
    """The file system of a folder's URI and the path in it; to be called inside tasks."""
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://") if uri.startswith("file:") else f"file://{uri}")


def one_of_each(docs: DataFrame, keys: dict[str, Column], chosen: DataFrame) -> DataFrame:
    """Rows of ``docs`` with a row in ``chosen`` (the key columns, each key once, and others), one row per key.

    ``keys`` says how a row of ``docs`` gets its key columns; nulls are equal. Rows of one key are
    taken for copies: only where such exist are rows compared, and of those the one that reads least as
    JSON stays. The columns of ``docs`` come first, as they are, then the other columns of
    ``chosen`` as ``__chosen_<name>``.
    """
    chosen = written(chosen, "chosen")
    right = chosen.withColumnsRenamed({name: f"__chosen_{name}" for name in chosen.columns})
    left = docs.withColumns({f"__own_{name}": column for name, column in keys.items()})
    condition = functools.reduce(operator.and_, (F.col(f"__own_{name}").eqNullSafe(F.col(f"__chosen_{name}")) for name in keys))
    joined = left.join(right, condition)
    own, more = [f"__own_{name}" for name in keys], [f"__chosen_{c}" for c in chosen.columns if c not in keys]
    if not left.groupBy(*own).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").isEmpty():
        least = F.min_by(F.struct(*docs.columns, *more), F.to_json(F.struct(*docs.columns)))
        joined = joined.groupBy(*own).agg(least.alias("__row")).select("__row.*")
    return joined.select(*docs.columns, *more)
