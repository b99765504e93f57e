"""Table sinks: appended events, replaced state tables, and the day report."""

from pyarrow import fs
from pyspark.sql import DataFrame

from ..plans.alerts import merge_alerts
from ..plans.summary import flap_events, merge_prefix_state, prefix_state, retain_recent


KEPT_VERSIONS = 3


def _files(path):
    """The file system of a folder's path or URI, and the path in it."""
    uri = path if "://" in path else f"file://{path.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri)


def _listed(path):
    """Names of what is in a folder; none if there is no such folder."""
    files, at = _files(path)
    return [f.base_name for f in files.get_file_info(fs.FileSelector(at, allow_not_found=True))]


def _removed(path):
    files, at = _files(path)
    files.delete_dir(at)


def exists(spark, path):
    files, at = _files(path)
    return files.get_file_info(at).type != fs.FileType.NotFound


def _versions(spark, path):
    """Numbers of the table's complete versions, oldest first. What a failed write left does not count."""
    return sorted(int(name[2:]) for name in _listed(path) if name.startswith("v-") and exists(spark, f"{path}/{name}/_SUCCESS"))


def of_batch(spark, path, batch_id) -> DataFrame | None:
    """What the last micro-batch before ``batch_id`` wrote to its folder of a table; None if there is none.

    A micro-batch that runs again does not see its own rows. Folders no later batch can ask for are removed.
    """
    there = sorted(int(name[6:]) for name in _listed(path) if name.startswith("batch=") and exists(spark, f"{path}/{name}/_SUCCESS"))
    before = [n for n in there if n < batch_id]
    for old in before[:-KEPT_VERSIONS]:
        _removed(f"{path}/batch={old}")
    return spark.read.parquet(f"{path}/batch={before[-1]}") if before else None


def drop_batch(path, batch):
    """Remove what one micro-batch wrote to an appended table."""
    _removed(f"{path}/batch={batch}")


def _at(path, version):
    return f"{path}/v-{version:012d}"


def read_table(spark, path) -> DataFrame | None:
    """The latest complete version; None where there is none yet."""
    there = _versions(spark, path)
    return spark.read.parquet(_at(path, there[-1])) if there else None


def replace_table(df: DataFrame, path):
    """Write the next version; it is the table from the moment it is complete.

    Readers and the job itself can read the version before meanwhile. One writer per table; a crash
    at any point leaves the last complete version. Versions beyond the last three are dropped.
    """
    spark = df.sparkSession
    there = _versions(spark, path)
    df.write.mode("overwrite").parquet(_at(path, there[-1] + 1 if there else 1))
    for old in there[:1 - KEPT_VERSIONS]:
        _removed(_at(path, old))


def upsert_prefix_state(events: DataFrame, path):
    new, old = prefix_state(events), read_table(events.sparkSession, path)
    replace_table(new if old is None else merge_prefix_state(old, new), path)


def upsert_totals(totals: DataFrame, path, keys):
    """Running totals by key: a key's new row replaces the old one, so a repeated micro-batch changes nothing."""
    old = read_table(totals.sparkSession, path)
    replace_table(totals if old is None else old.join(totals.select(*keys), keys, "left_anti").unionByName(totals), path)


def append_flap_events(events: DataFrame, path):
    flap_events(events).write.mode("append").parquet(path)


def upsert_alerts(alerts: DataFrame, path, now=None):
    old = read_table(alerts.sparkSession, path)
    merged = merge_alerts(old, alerts)
    replace_table(merged if now is None else retain_recent(merged, now, ts="timestamp"), path)


def cache_rpki_stats(counts: DataFrame | None, path, spark):
    """Store fresh counts and return them; without fresh ones return the stored row."""
    if counts is None:
        return read_table(spark, path)
    replace_table(counts, path)
    return read_table(spark, path)


def write_day_summary(day: DataFrame, path, fmt="json"):
    """One nested row, replaced on every run."""
    day.coalesce(1).write.mode("overwrite").format(fmt).save(path)
