"""Query surface over the tables that the streams keep: each call reads what the last complete micro-batches left."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as K
from ..plans import alerts as AL
from ..plans import summary as SU
from ..sources import sinks


class Tables:
    """The tables under ``root`` that ``start_pipeline`` keeps."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _state(self, name) -> DataFrame:
        table = sinks.read_table(self.spark, f"{self.root}/{name}")
        if table is None:
            raise ValueError(f"no micro-batch has written {name} yet")
        return table

    def _appended(self, name) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def recent_alerts(self, now: int, per_class=10) -> DataFrame:
        """Top alerts per class of the last day."""
        return AL.recent_alerts(self._state("alerts"), now, per_class)

    def global_counts(self) -> DataFrame:
        return SU.global_counts(self._state("prefix_state"))

    def class_stats(self) -> DataFrame:
        return SU.class_stats(self._state("prefix_state"))

    def flappiest(self, now: int, limit=10, as_info: DataFrame | None = None) -> DataFrame:
        """The networks with most flaps in the last day."""
        return SU.flappiest(self._appended("flap_events"), now, limit, as_info)

    def totals(self) -> DataFrame:
        """Messages since the streams began, by source and class; kept over restarts."""
        return self._state("totals")

    def rates(self, now: int, seconds=60, by=("classification",)) -> DataFrame:
        """Messages per second over the last ``seconds`` up to ``now``, per class, source or (without ``by``) in all."""
        rows = self._appended("events").filter((F.col("ts") > now - seconds) & (F.col("ts") <= now))
        return rows.groupBy(*by).agg((F.count("*") / F.lit(float(seconds))).alias("rate"))

    def transitions(self, since: int, target_states=None) -> DataFrame:
        """Transitions from ``since`` on, newest first; those that enter or leave one of ``target_states`` if any are named."""
        rows = self._appended("transitions").filter(F.col("ts") >= since)
        want = list(target_states or [])
        rows = rows.filter(F.col("new_state").isin(want) | F.col("old_state").isin(want)) if want else rows
        return rows.orderBy(F.desc("ts"), "prefix")

    def retain(self, now: int, seconds=K.DAY):
        """Drop whole folders of appended tables whose newest row is older than ``seconds``."""
        for name in ("flap_events", "critical", "transitions"):
            if not sinks.exists(self.spark, f"{self.root}/{name}"):
                continue
            newest = self._appended(name).groupBy("batch").agg(F.max("ts").alias("ts")).filter(F.col("ts") < now - seconds)
            for row in newest.toLocalIterator():
                sinks.drop_batch(f"{self.root}/{name}", row.batch)
