"""Running values over ordered groups that survive hot keys.

A plain window puts a whole key in one task. Here the rows of hot keys are taken apart from the
rest and cut into time slices: the window runs per (key, slice), and what the earlier slices
contribute is added from a small table of slice totals. Each such step writes its rows out first
(shared checkpoint folder), so that totals and rows come from one computation and the plan stays
short. Keys that are not hot use plain windows.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut, small

SLICE, CHUNK = "_slice", "_chunk"
SLICE_STEPS = 10        # slices of 60 * 2^k seconds, k = 0..10
SLICES = 8              # a slice holds at most this part of the rows that make a key hot


def find_hot(df: DataFrame, key="prefix", target_rows=2_000_000, slice_rows=None):
    """Keys with more than ``target_rows`` rows and the slice length each is cut with.

    A slice is the longest with at most ``slice_rows`` rows (an eighth of ``target_rows`` if not given), or a minute: with
    slices as large as the keys that stay whole, a key just over the limit would be two tasks.

    At most (all rows / target_rows) keys can be hot. Returns None when there are none. Counts
    are partial per minute, so nothing but (key, minute, n) is shuffled.
    """
    slice_rows = slice_rows or target_rows // SLICES
    per_min = df.groupBy(key, F.floor(F.col("ts") / 60).alias("m")).agg(F.count("*").alias("n"))
    big = per_min.groupBy(key).agg(F.sum("n").alias("n")).filter(F.col("n") > target_rows).select(key)
    sized = per_min.join(big, key).select(
        key, "m", "n", F.explode(F.sequence(F.lit(0), F.lit(SLICE_STEPS))).alias("k"))
    sized = sized.groupBy(key, "k", F.floor(F.col("m") / F.pow(F.lit(2), F.col("k"))).alias("s")).agg(
        F.sum("n").alias("n"))
    fits = sized.groupBy(key, "k").agg(F.max("n").alias("peak"))
    hot = fits.groupBy(key).agg(
        F.coalesce(F.max(F.when(F.col("peak") <= slice_rows, F.col("k"))), F.lit(0)).alias("k"))
    hot = hot.select(key, (F.lit(60) * F.pow(F.lit(2), F.col("k"))).cast("long").alias(SLICE))
    return None if hot.isEmpty() else hot


def chunk_of(ts="ts") -> Column:
    return F.floor(F.col(ts) / F.col(SLICE)).cast("long")


def split_hot(df: DataFrame, hot, key="prefix"):
    """(rows of the other keys, rows of hot keys with their slice length and number)."""
    df = df.withColumn(SLICE, F.lit(None).cast("long")).withColumn(CHUNK, F.lit(0).cast("long"))
    if hot is None:
        return df, None
    hot = small(hot)
    sliced = df.drop(SLICE, CHUNK).join(hot, key).withColumn(CHUNK, chunk_of())
    return df.join(hot, key, "left_anti"), sliced


def place(df: DataFrame, hot, key="prefix") -> DataFrame:
    """One shuffle that serves all windows below: by key, or by (key, slice) of hot keys."""
    return df.repartition(key) if hot is None else df.repartition(key, CHUNK)


class Running:
    """One running value: ``kind`` is sum, min, max, or last (last not null)."""

    def __init__(self, kind, expr: Column, before=False):
        self.kind, self.expr, self.before = kind, expr, before

    def fold(self, col):
        return {"sum": F.sum, "min": F.min, "max": F.max,
                "last": lambda c: F.last(c, ignorenulls=True)}[self.kind](col)

    def total(self, col, order):
        if self.kind == "last":
            return F.max_by(col, F.when(col.isNotNull(), F.struct(*order)))
        return self.fold(col)

    def merge(self, local, carry):
        if self.kind == "sum":
            return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
        if self.kind == "last":
            return F.coalesce(local, carry)
        return F.least(local, carry) if self.kind == "min" else F.greatest(local, carry)


def running(df: DataFrame, keys, order, values: dict, hot=None) -> DataFrame:
    """Add running values over ``keys`` in ``order``; rows up to this one, or before it."""
    keys, parts = list(keys), list(keys) + ([] if hot is None else [CHUNK])
    w = Window.partitionBy(*parts).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    if hot is None:
        new = {n: v.fold(v.expr).over(prior if v.before else upto) for n, v in values.items()}
        new = {n: F.coalesce(c, F.lit(0)) if values[n].kind == "sum" else c for n, c in new.items()}
        return df.withColumns(new)
    tmp = {n: f"_in_{n}" for n in values}
    df = cut(df.withColumns({tmp[n]: v.expr for n, v in values.items()}))
    totals = df.groupBy(*parts).agg(
        *[v.total(F.col(tmp[n]), order).alias(f"_c_{n}") for n, v in values.items()])
    back = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *parts, *[v.fold(F.col(f"_c_{n}")).over(back).alias(f"_c_{n}") for n, v in values.items()])
    df = df.withColumns(
        {f"_l_{n}": v.fold(F.col(tmp[n])).over(prior if v.before else upto) for n, v in values.items()})
    df = df.join(totals, parts, "left")
    df = df.withColumns({n: v.merge(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n, v in values.items()})
    return df.drop(*[f"_{p}_{n}" for n in values for p in ("in", "l", "c")])


def neighbours(df: DataFrame, keys, order, prev: dict, following: dict, hot=None) -> DataFrame:
    """Add values of the previous and the next row of the same key."""
    keys, parts = list(keys), list(keys) + ([] if hot is None else [CHUNK])
    w = Window.partitionBy(*parts).orderBy(*order)
    if hot is None:
        return df.withColumns({**{n: F.lag(c).over(w) for n, c in prev.items()},
                               **{n: F.lead(c).over(w) for n, c in following.items()}})
    # A struct per side, so that a null value of a present row is not taken for a missing row.
    df = cut(df.withColumns({
        "_pv": F.struct(*[c.alias(n) for n, c in prev.items()]),
        "_nv": F.struct(*[c.alias(n) for n, c in following.items()])}))
    ends = df.groupBy(*parts).agg(
        F.max_by("_pv", F.struct(*order)).alias("_pe"), F.min_by("_nv", F.struct(*order)).alias("_ne"))
    side = Window.partitionBy(*keys).orderBy(CHUNK)
    ends = ends.select(*parts, F.lag("_pe").over(side).alias("_pe"), F.lead("_ne").over(side).alias("_ne"))
    df = df.withColumns({"_pl": F.lag("_pv").over(w), "_nl": F.lead("_nv").over(w)})
    df = df.join(ends, parts, "left")
    df = df.withColumns({"_pl": F.coalesce("_pl", "_pe"), "_nl": F.coalesce("_nl", "_ne")})
    df = df.withColumns({**{n: F.col(f"_pl.{n}") for n in prev},
                         **{n: F.col(f"_nl.{n}") for n in following}})
    return df.drop("_pv", "_nv", "_pl", "_nl", "_pe", "_ne")


def sums_until(df: DataFrame, key, minute, lags: dict, hot=None) -> DataFrame:
    """For each counter and each of its lags L add ``<counter>_until_<L>``: the sum over rows at least L minutes back.

    Frames start at the beginning of the key, so Spark extends one running aggregate and never
    re-adds a frame. Hot keys read the same sums from their (key, minute) totals.
    """
    names = {f"{c}_until_{lag}": (c, lag) for c, ls in lags.items() for lag in ls}

    def frame(parts, lag):
        return Window.partitionBy(*parts).orderBy(minute).rangeBetween(Window.unboundedPreceding, -lag)

    if hot is None:
        return df.withColumns({n: F.coalesce(F.sum(c).over(frame([key], lag)), F.lit(0))
                               for n, (c, lag) in names.items()})
    df = cut(df)
    per_min = df.groupBy(key, minute).agg(*[F.sum(c).alias(c) for c in lags])
    per_min = per_min.select(key, minute, *[
        F.coalesce(F.sum(c).over(frame([key], lag)), F.lit(0)).alias(n) for n, (c, lag) in names.items()])
    return df.join(per_min, [key, minute], "left")
