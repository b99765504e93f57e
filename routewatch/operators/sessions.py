"""What each update changes: per session, per host and per prefix."""

from pyspark.sql import DataFrame, Window, functions as F

from .. import constants as K
from .scan import CHUNK, Running, chunk_of, neighbours, place, running, sums_until

SESSION = ["prefix", "host", "peer"]
ORDER = ["ts", "update_id"]
COUNTERS = ["ann", "wd", "path_change", "len_inc", "len_dec", "flap"]


def session_changes(updates: DataFrame, hot=None) -> DataFrame:
    """Compare every update with the session's remembered state.

    A session withdrawn for more than an hour is forgotten. A forgotten or new session that is
    withdrawn is remembered with an empty path of length 0. Adds the counters (path_change,
    len_inc, len_dec, flap, ann, wd), whether the session was ``known`` / ``was_active``, the
    origin it announced, and the time of its next update.
    """
    df = neighbours(
        place(updates, hot), SESSION, ORDER,
        prev={"prev_ts": F.col("ts"), "prev_wd": F.col("is_withdrawal")},
        following={"next_ts": F.col("ts")}, hot=hot)
    known = F.col("prev_ts").isNotNull() & ~(
        F.col("prev_wd") & (F.col("prev_ts") < F.col("ts") - K.SESSION_RETENTION))
    at = F.struct(*ORDER)
    df = df.withColumn("known", known).withColumn(
        "_restart", F.when(F.col("prev_ts").isNotNull() & ~F.col("known"), at))
    df = running(df, SESSION, ORDER, {
        "_ann": Running("last", F.when(~F.col("is_withdrawal"), F.struct(
            at.alias("at"), "path_str", "path_len", "origin_asn")), before=True),
        "_cut": Running("max", F.col("_restart"), before=True),
    }, hot)
    alive = F.col("_ann").isNotNull() & (F.col("_cut").isNull() | (F.col("_ann.at") >= F.col("_cut")))
    df = df.withColumns({
        "last_path": F.when(alive, F.col("_ann.path_str")).otherwise(""),
        "last_len": F.when(alive, F.col("_ann.path_len")).otherwise(0),
        "was_active": F.col("known") & ~F.coalesce(F.col("prev_wd"), F.lit(True)),
        "was_withdrawn": F.col("known") & F.coalesce(F.col("prev_wd"), F.lit(False)),
    })
    ann = ~F.col("is_withdrawal")
    moved = ann & F.col("known") & (F.col("last_path") != F.col("path_str"))
    one = lambda c: c.cast("long")
    df = df.withColumns({
        "active_origin": F.when(F.col("was_active"), F.col("_ann.origin_asn")),
        "ann": one(ann),
        "wd": one(~ann),
        "path_change": one(moved | (ann & ~F.col("known"))),
        "len_inc": one(moved & (F.col("path_len") > F.col("last_len"))),
        "len_dec": one(moved & (F.col("path_len") < F.col("last_len"))),
        "flap": one(ann & F.col("was_withdrawn")),
    })
    return df.drop("_restart", "_ann", "_cut")


def _with_expiries(changes: DataFrame, hot=None) -> DataFrame:
    """Add a row for every moment a withdrawn session is forgotten.

    The extra row leaves the known count one second after the retention time, before any update
    of that second.
    """
    forgotten = F.col("is_withdrawal") & (
        F.col("next_ts").isNull() | (F.col("next_ts") > F.col("ts") + K.SESSION_RETENTION))
    ann, one = ~F.col("is_withdrawal"), lambda c: c.cast("long")
    df = changes.withColumns({
        "d_active": one(ann & ~F.col("was_active")) - one(~ann & F.col("was_active")),
        "d_known": one(~F.col("known"))})
    update = F.struct(F.lit(1).alias("is_update"), F.col("ts").alias("at"), "d_active", "d_known")
    expiry = F.struct(F.lit(0).alias("is_update"), (F.col("ts") + K.SESSION_RETENTION + 1).alias("at"),
                      F.lit(0).cast("long").alias("d_active"), F.lit(-1).cast("long").alias("d_known"))
    df = df.withColumn("_e", F.explode(F.when(forgotten, F.array(update, expiry)).otherwise(
        F.array(update))))
    df = df.withColumns({c: F.col(f"_e.{c}") for c in ("is_update", "d_active", "d_known")}).withColumn(
        "ts", F.col("_e.at")).drop("_e")
    # An expiry carries none of the update's own counts.
    df = df.withColumns({c: F.when(F.col("is_update") == 1, F.col(c)).otherwise(0) for c in COUNTERS})
    if hot is not None:
        df = place(df.withColumn(CHUNK, chunk_of()), hot)
    return df


def prefix_counts(changes: DataFrame, hot=None) -> DataFrame:
    """Counts per prefix after each update.

    Adds n_active / n_known sessions, n_hosts / n_all_hosts (with an active / any session), the
    time the prefix became fully withdrawn, whether a withdrawn prefix came back, the last
    announced origin, and the 10-minute totals of the counters.
    """
    df = _with_expiries(changes, hot)
    order = ["ts", "is_update", "update_id"]
    df = running(df, ["prefix", "host"], order, {
        "host_active": Running("sum", F.col("d_active")),
        "host_known": Running("sum", F.col("d_known"))}, hot)

    def flip(total, delta):
        now, was = F.col(total) > 0, (F.col(total) - F.col(delta)) > 0
        return now.cast("long") - was.cast("long")

    df = df.withColumns({"_dh": flip("host_active", "d_active"), "_dk": flip("host_known", "d_known")})
    update = F.col("is_update") == 1
    at = F.struct("ts", "update_id")
    df = running(df, ["prefix"], order, {
        "n_active": Running("sum", F.col("d_active")),
        "n_known": Running("sum", F.col("d_known")),
        "n_hosts": Running("sum", F.col("_dh")),
        "n_all_hosts": Running("sum", F.col("_dk")),
        "last_origin": Running("last", F.when(
            update & ~F.col("is_withdrawal") & (F.col("origin_asn") != 0), F.col("origin_asn"))),
        "_first": Running("min", F.when(update, at)),
        **{f"_t_{c}": Running("sum", F.col(c)) for c in COUNTERS},
    }, hot)
    df = df.withColumns({
        "_was": F.col("n_active") - F.col("d_active"),
        "_is_first": update & (F.col("_first") == at),
        "last_origin": F.coalesce("last_origin", F.lit(0).cast("long"))})
    gone = update & (F.col("n_active") == 0)
    df = running(df, ["prefix"], order, {"_gone_ts": Running(
        "last", F.when(gone & ((F.col("_was") > 0) | F.col("_is_first")), F.col("ts")))}, hot)
    df = df.withColumns({
        "fw_ts": F.when(gone, F.col("_gone_ts")),
        "flap_cycle": (update & (F.col("n_active") > 0) & (F.col("_was") == 0) & ~F.col("_is_first")).cast("long"),
        "minute": F.floor(F.col("ts") / 60).cast("long"),
        "msgs": F.col("is_update").cast("long")})
    df = sums_until(df, "prefix", "minute", {
        **{c: [10, 11] for c in COUNTERS}, "wd": [9, 10, 11], "msgs": [1, 10, 11]}, hot)
    # A bucket counts while its minute is not before now - 600.
    whole = F.col("ts") % 60 == 0

    def until(c):
        return F.when(whole, F.col(f"{c}_until_11")).otherwise(F.col(f"{c}_until_10"))

    df = df.withColumns({f"{c}_10m": F.col(f"_t_{c}") - until(c) for c in COUNTERS})
    df = df.withColumns({
        # withdrawals that still count once the next minute has left the look-back
        "wd_10m_next": F.col("_t_wd") - F.when(whole, F.col("wd_until_10")).otherwise(F.col("wd_until_9")),
        # oldest bucket more than 30 s back: this minute's own start, or any earlier bucket
        "elapsed_30": (F.col("ts") % 60 > 30) | (F.col("msgs_until_1") - until("msgs") > 0)})
    keep = [c for c in df.columns if not c.startswith("_t_") and "_until_" not in c
            and c not in ("_dh", "_dk", "_first", "_was", "_is_first", "_gone_ts", "d_active",
                          "d_known", "is_update", "msgs", "host_known")]
    return df.filter(update).select(*keep)


def minute_buckets(updates: DataFrame, hot=None) -> DataFrame:
    """Counters per (prefix, minute)."""
    ch = session_changes(updates, hot)
    return ch.groupBy("prefix", (F.floor(F.col("ts") / 60) * 60).cast("long").alias("minute_ts")).agg(
        F.count("*").alias("total_messages"), *[F.sum(c).alias(c) for c in COUNTERS])


def rolling_10m(buckets: DataFrame) -> DataFrame:
    """Totals over the buckets with ``minute_ts`` in the last 600 s, at each bucket.

    One row per (prefix, minute) enters the window, so its size is bounded by time, not by rows.
    """
    w = Window.partitionBy("prefix").orderBy("minute_ts").rangeBetween(-K.BUCKET_SECONDS, 0)
    return buckets.select("prefix", "minute_ts", *[
        F.sum(c).over(w).alias(f"{c}_10m") for c in ["total_messages"] + COUNTERS])


def active_sessions(updates: DataFrame, at: int) -> DataFrame:
    """Per prefix: active and withdrawn sessions, and hosts with an active / any session at ``at``."""
    last = updates.filter(F.col("ts") <= at).groupBy(*SESSION).agg(
        F.max_by(F.struct("ts", "is_withdrawal"), F.struct(*ORDER)).alias("s"))
    last = last.filter(~F.col("s.is_withdrawal") | (F.col("s.ts") >= at - K.SESSION_RETENTION))
    live = ~F.col("s.is_withdrawal")
    return last.groupBy("prefix").agg(
        F.count(F.when(live, 1)).alias("n_active"),
        F.count(F.when(~live, 1)).alias("n_withdrawn"),
        F.count_distinct(F.when(live, F.col("host"))).alias("n_hosts"),
        F.count_distinct("host").alias("n_all_hosts"))
