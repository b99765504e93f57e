"""Repeated passages: content-defined chunks of lines, with DataFrame functions only.

A rolling hash runs over the hashes of a text's lines, a few lines at a time. Where no other place of
the corpus has the same rolling hash, a chunk ends: a boundary depends on the lines around it alone,
so a passage copied anywhere, at any shift, falls into the same chunk. Windows that others share are
compared byte by byte, and of equal ones all but the first go; what goes in a text is thus its chunks
of several lines that stand earlier in the corpus.

Windows with a copy are found by hash first, so that only their text is moved. Hashes that many
documents share are counted and marked by salted groups.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .shared import one_row_per_salt, salt_bit, salt_of, whole_text, written

#: Lines that the rolling hash spans: the shortest chunk that may go.
WINDOW = 2


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def _held(df: DataFrame, **columns) -> DataFrame:
    """Adds columns that are computed once per row, also where a lambda uses them: a generator is not inlined."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _turned(hashed: Column, bits: int) -> Column:
    """The 64 bits turned left."""
    if not bits:
        return hashed
    return F.call_function("shiftleft", hashed, F.lit(bits)).bitwiseOR(F.shiftrightunsigned(hashed, 64 - bits))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_md5, salt, lines of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("content"))
    rows = rows.withColumns({"text_md5": F.unhex(F.md5("content")), "lines": F.split("content", "\n")})
    return rows.withColumn("salt", salt_of("doc_id", "text_md5")).drop("content")


def windows(rows: DataFrame, window=WINDOW, line_hash: Callable[[Column], Column] = line_hash) -> DataFrame:
    """doc_id, text_md5, salt, no, h: the rolling hash (cyclic polynomial) of each run of ``window`` lines, by its first line."""
    held = _held(rows, hashes=F.transform("lines", line_hash)).drop("lines")

    def rolled(i):
        out = _turned(F.get("hashes", i), window - 1)
        for ahead in range(1, window):
            out = out.bitwiseXOR(_turned(F.get("hashes", i + ahead), window - 1 - ahead))
        return F.struct(i.alias("no"), out.alias("h"))

    last = F.size("hashes") - window
    held = held.filter(last >= 0).withColumn("w", F.explode(F.transform(F.sequence(F.lit(0), last), rolled)))
    return held.select("doc_id", "text_md5", "salt", "w.no", "w.h")


def _same_document(doc_id="d", text_md5="t"):
    return F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.col("text_md5") == F.col(text_md5))


def _firsts(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The first place of every different window, its number of places and their salts; equal means equal bytes."""
    salted = texts.groupBy(*keys, "salt").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy(*keys).agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.bit_or(salt_bit(F.col("salt"))).alias("salts"))


def _later(places: DataFrame, firsts: DataFrame, keys: list[str]) -> DataFrame:
    """Places that are not the first of their window."""
    several = one_row_per_salt(firsts.filter("n > 1").select(*keys, "first", "salts"))
    return places.join(several, [*keys, "salt"]).filter(~F.col("place").eqNullSafe(F.col("first"))).select("place")


def line_dedup(docs: DataFrame, window=WINDOW, line_hash: Callable[[Column], Column] = line_hash) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, removed_chunks, removed_lines, text (what stays).

    Of equal runs of ``window`` lines the first stays, by doc_id (null first), the text's MD5, and
    place; the lines of the others go, also within one document. Runs that touch or overlap make one
    chunk. A line that goes always stays somewhere before. Rows repeated with the same doc_id and text
    are one document and keep the same lines. Lines end at line feeds; null texts are empty and have
    one empty line; a passage of fewer lines than ``window`` stays. An empty table gives no rows; other
    columns are not read.
    """
    rows = _lines(docs)

    # which hashes occur more than once: small rows, combined in the map tasks, then by salt
    found = windows(rows, window, line_hash)
    counts = found.groupBy("h", "salt").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(
        F.sum("n").alias("n"), F.bit_or(salt_bit(F.col("salt"))).alias("salts")).filter("n > 1").drop("n")
    marked = found.join(one_row_per_salt(counts), ["h", "salt"]).groupBy("doc_id", "text_md5", "salt").agg(
        F.collect_set(F.struct("no", "h")).alias("marked"))
    marked = written(marked, "marked-windows")
    places = marked.select("doc_id", "text_md5", "salt", F.inline("marked")).withColumn("place", F.struct("doc_id", "text_md5", "no"))

    # their texts, compared byte by byte; merge joins at every size: a broadcast would hold only while few documents share windows
    right = marked.select(F.col("doc_id").alias("d"), F.col("text_md5").alias("t"), "marked").hint("merge")
    text = lambda w: F.struct(w.no.alias("no"), w.h.alias("h"), F.array_join(F.slice("lines", w.no + 1, window), "\n").alias("chunk"))
    texts = rows.join(right, _same_document()).select("doc_id", "text_md5", "salt", F.inline(F.transform("marked", text)))
    texts = texts.select("h", "salt", "chunk", F.struct("doc_id", "text_md5", "no").alias("place"))
    firsts = written(_firsts(texts, ["h", "chunk"]).drop("chunk"), "first-windows")
    shared = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("h")
    if shared.isEmpty():  # a hash tells its text
        gone = _later(places, firsts, ["h"])
    else:
        alone = _later(places.join(shared, "h", "left_anti"), firsts.join(shared, "h", "left_anti"), ["h"])
        several = texts.join(shared, "h")
        gone = alone.unionByName(_later(several, _firsts(several, ["h", "chunk"]), ["h", "chunk"]))
    gone = gone.groupBy(F.col("place.doc_id").alias("d"), F.col("place.text_md5").alias("t")).agg(F.collect_set("place.no").alias("gone"))

    out = rows.join(gone.hint("merge"), _same_document(), "left")
    lines_of = F.transform("gone", lambda no: F.sequence(no, no + (window - 1)))
    out = _held(out, removed=F.coalesce(F.array_distinct(F.flatten(lines_of)), F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
    return out.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_except("removed", F.transform("removed", lambda i: i + 1))).cast("long").alias("removed_chunks"),
        F.size("removed").cast("long").alias("removed_lines"),
        F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n").alias("text"))
