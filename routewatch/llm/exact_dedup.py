"""Exact duplicates by skew-safe combining, with DataFrame functions only.

Three stages, each of which groups by digest *and* whole text, so equal means equal content:
a local combine inside each task, a merge of groups salted by doc_id, and a merge of the salt winners.
A group with a third of all rows thus never meets in one task: after the salted merge it has one row per salt.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .shared import one_row_per_salt, salt_bit, salt_of, whole_text, written

#: Runs of these bytes count as one space.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Texts are equal if they are so after ``normalised``. ``keep_id`` is the smallest doc_id of the
    group (nulls last; null if the group has none else). A null text is an empty one; empty texts
    form a group like any other. Of rows repeated with the same doc_id and text each counts and is
    returned, and one of the winner's is kept. An empty table gives no rows. Other columns of
    ``docs``, whatever their names, are not read.
    """
    rows = docs.select("doc_id", normalised(whole_text(docs)).alias("content"))
    rows = rows.withColumns({"digest": digest(F.col("content")), "salt": salt_of("doc_id")})

    # local combine and salted merge: Spark combines inside the map tasks, then by digest, salt and content
    salted = rows.groupBy("digest", "salt", "content").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    # salt winners meet by digest; a group has one row per salt here
    groups = (
        salted.repartition("digest").groupBy("digest", "content")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"),
             F.bit_or(salt_bit(F.col("salt"))).alias("salts"))
        .select("digest", "keep_id", "group_size", "salts")
    )
    groups = written(groups, "dedup-groups")
    shared_digests = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")

    members = rows.groupBy("digest", "salt", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    if shared_digests.isEmpty():
        found = members.join(one_row_per_salt(groups), ["digest", "salt"])
    else:
        found = _by_content(rows, salted, groups, shared_digests)
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def _by_content(rows, salted, groups, shared_digests):
    """Members where different texts share a digest: those rows are matched by their whole text."""
    alone = rows.join(shared_digests, "digest", "left_anti").groupBy("digest", "salt", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    alone = alone.join(one_row_per_salt(groups), ["digest", "salt"]).select("doc_id", "keep_id", "group_size", "copies", "digest")
    texts = salted.join(shared_digests, "digest").groupBy("digest", "content").agg(
        F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(salt_bit(F.col("salt"))).alias("salts"))
    several = rows.join(shared_digests, "digest").groupBy("digest", "salt", "content", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    several = several.join(one_row_per_salt(texts), ["digest", "salt", "content"])
    return alone.unionByName(several.select("doc_id", "keep_id", "group_size", "copies", "digest"))
