"""Per-prefix anomaly scores and the greedy rate limit."""

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .. import constants as K

BLOCK = 1024  # minutes; 0.95^1024 is far below double precision


def minute_states(critical: DataFrame) -> DataFrame:
    """Per (prefix, minute with events): count, and the EWMA mean and variance before it.

    Blocks of 1024 minutes are folded in order by the update rule itself, each from the minutes of the
    block before; of older ones nothing is left in double precision. Minutes without events
    count zero; there are fewer than 60 in a row, as a prefix without events for an hour starts
    anew, so a block is followed by the next one or none.
    """
    return states_of(critical.groupBy("prefix", F.floor(F.col("ts") / 60).alias("m")).agg(F.count("*").alias("n")))


def states_of(n: DataFrame) -> DataFrame:
    """``minute_states`` of counts n per prefix and minute number m."""
    by = Window.partitionBy("prefix").orderBy("m")
    new = F.coalesce(F.col("m") - F.lag("m").over(by) > K.EWMA_RETENTION // 60, F.lit(True))
    n = n.withColumn("start", F.last(F.when(new, F.col("m")), ignorenulls=True).over(
        by.rowsBetween(Window.unboundedPreceding, 0)))
    n = n.withColumn("block", F.floor((F.col("m") - F.col("start")) / BLOCK))
    # at most 1024 minutes in an array
    blocks = n.groupBy("prefix", "start", "block").agg(F.sort_array(F.collect_list(F.struct("m", F.col("n").cast("double").alias("n")))).alias("rows"))
    before = blocks.select("prefix", "start", (F.col("block") + 1).alias("block"), F.col("rows").alias("old"))
    both = blocks.join(before, ["prefix", "start", "block"], "left").withColumn("first", F.col("rows")[0]["m"])
    both = both.withColumn("rows", F.when(F.col("old").isNull(), F.col("rows")).otherwise(F.concat("old", "rows")))

    a, zero = F.lit(K.EWMA_ALPHA), F.lit(0.0)
    state = "struct<m:bigint,mean:double,var:double,out:array<struct<m:bigint,n:double,mean:double,var:double>>>"

    def after(mean, var, count):
        d = count - mean
        inc = F.lit(round(1 - K.EWMA_ALPHA, 12)) * d
        return F.struct((mean + inc).alias("mean"), (a * (var + d * inc)).alias("var"))

    def step(so_far, row):
        quiet = F.coalesce(row["m"] - so_far["m"] - 1, F.lit(0))
        here = F.aggregate(F.sequence(F.lit(1), F.greatest(quiet, F.lit(1))), F.struct(so_far["mean"].alias("mean"), so_far["var"].alias("var")),
                           lambda s, i: F.when(i <= quiet, after(s["mean"], s["var"], zero)).otherwise(s))
        # a function of one field keeps the state from being worked out for each use
        return F.aggregate(F.array(here), so_far, lambda _, s: F.struct(
            row["m"].alias("m"), after(s["mean"], s["var"], row["n"])["mean"].alias("mean"), after(s["mean"], s["var"], row["n"])["var"].alias("var"),
            F.concat(so_far["out"], F.array(F.struct(row["m"].alias("m"), row["n"].alias("n"), s["mean"].alias("mean"), s["var"].alias("var")))).alias("out"),
        ).cast(state))

    nothing = F.struct(F.lit(None).cast("long").alias("m"), zero.alias("mean"), zero.alias("var"), F.array().alias("out")).cast(state)
    folded = both.select("prefix", "first", F.explode(F.aggregate("rows", nothing, step, lambda s: s["out"])).alias("s"))
    return folded.filter("s.m >= first").select(
        "prefix", (F.col("s.m") * 60).cast("long").alias("minute_ts"), F.col("s.n").cast("long").alias("n"), "s.mean", "s.var")


def z_score(count, mean, var):
    sd = F.sqrt(var)
    return F.when(sd < K.EWMA_MIN_SD, F.greatest(count - mean, F.lit(0.0))).otherwise((count - mean) / sd)


def prefix_zscores(critical: DataFrame, now: int) -> DataFrame:
    """Score of every prefix at ``now``: its running minute against its own history."""
    rows = critical.filter(F.col("ts") <= now)
    last = minute_states(rows).groupBy("prefix").agg(
        F.max_by(F.struct("minute_ts", "n", "mean", "var"), "minute_ts").alias("s"))
    last = last.filter(F.col("s.minute_ts") >= now - K.EWMA_RETENTION - 59)
    count = F.when(F.floor(F.lit(now) / 60) * 60 > F.col("s.minute_ts"), F.lit(0.0)).otherwise(
        F.col("s.n").cast("double"))
    return last.select("prefix", z_score(count, F.col("s.mean"), F.col("s.var")).alias("z"))


def rate_limit(df: DataFrame, keys, seconds=300, order=("ts", "update_id"), ts="ts") -> DataFrame:
    """Keep a row when at least ``seconds`` have passed since the last kept row of its key.

    Whether a row is kept depends on the kept one before it, so ``lag`` cannot tell. The times are
    reduced to distinct seconds per key, cut at pauses of ``seconds`` (the row after a pause is
    always kept), and only these runs are walked through, in sorted batches.
    """
    keys = list(keys)
    key = F.to_json(F.struct(*keys))
    times = df.select(key.alias("_rl_key"), F.col(ts).alias("_rl_ts")).distinct()
    by = Window.partitionBy("_rl_key").orderBy("_rl_ts")
    pause = F.coalesce(F.col("_rl_ts") - F.lag("_rl_ts").over(by) >= seconds, F.lit(True))
    run = F.last(F.when(pause, F.col("_rl_ts")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    runs = times.withColumn("_rl_run", run).repartition("_rl_key", "_rl_run").sortWithinPartitions("_rl_key", "_rl_run", "_rl_ts")

    def walk(batches):
        place, kept = None, None
        for batch in batches:
            keep = []
            for k, r, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (k, r) != place or t - kept >= seconds:
                    place, kept = (k, r), t
                    keep.append(True)
                else:
                    keep.append(False)
            yield batch.select(["_rl_key", "_rl_ts"]).filter(pa.array(keep, pa.bool_()))

    kept = runs.select("_rl_key", "_rl_run", "_rl_ts").mapInArrow(walk, f"_rl_key string, _rl_ts {dict(df.dtypes)[ts]}")
    # of the rows of a kept second the first one is the kept row
    first = df.groupBy(key.alias("_rl_key"), F.col(ts).alias("_rl_ts")).agg(
        F.min(F.struct(*order)).alias("_rl_row")).join(kept, ["_rl_key", "_rl_ts"])
    marked = df.withColumns({"_rl_key": key, "_rl_ts": F.col(ts)})
    return marked.join(first, ["_rl_key", "_rl_ts"]).filter(F.struct(*order) == F.col("_rl_row")).drop("_rl_key", "_rl_ts", "_rl_row")
