"""Near-duplicates by SimHash: Golay-code keys, pigeonhole over segments, join, verification, components.

A 64-bit fingerprint is cut into segments A, B (23 bits) and C (18, padded to 23). If two fingerprints
differ in three bits at most, then either one segment is equal and another differs in one bit at
most, or each of the three differs in exactly one. So a family of keys joins the equal segment's bits
with a codeword index of the other (six families), and four more join a codeword index of A with one
equal half of B and one of C. Every fingerprint has one home key per family, with its nearest codeword,
and up to six probe keys, with the codewords within distance 4; a segment one bit away has its nearest
codeword among them. Probes meet homes in an equi-join, and the exact distance decides.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import golay
from .components import components
from .shared import one_of_each, one_row_per_salt, salt_bit, salt_of, whole_text, written

MAX_BITS = 3
SEGMENTS = {"A": (0, 23), "B": (23, 23), "C": (46, 18)}
#: Family number: (segment that is equal, segment that is decoded).
PAIRS = {1: ("A", "B"), 2: ("A", "C"), 3: ("B", "A"), 4: ("B", "C"), 5: ("C", "A"), 6: ("C", "B")}
#: Family number: (first bit and bits of the equal half of B, the same of C); segment A is decoded.
HALVES = {7: ((23, 12), (46, 9)), 8: ((23, 12), (55, 9)), 9: ((35, 11), (46, 9)), 10: ((35, 11), (55, 9))}


def fingerprint_of(text: str, shingle=3, seed=42) -> int:
    """SimHash of a text as a signed long; 0 for a text without words. Only A-Z are lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.split() cuts at 20 and 09-0D
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, ends = np.concatenate(([0], ends[:-1]))[:len(words) - size + 1].tolist(), (ends[size - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends)], np.uint64))


def majority(hashes: np.ndarray, block=1 << 16) -> int:
    """The bits that over half of the hashes have, as a signed long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        part = hashes[at:at + block].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle=3, seed=42) -> DataFrame:
    """doc_id, text_md5 and SimHash (fp, long) of every row's whole text; null counts as empty."""
    def batches(parts):
        for part in parts:
            found = [fingerprint_of(t.as_py(), shingle, seed) for t in part.column("content")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_md5"), pa.array(found, pa.int64())], ["doc_id", "text_md5", "fp"])

    text = whole_text(docs)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("text_md5"), text.alias("content"))
    return source.mapInArrow(batches, "doc_id long, text_md5 binary, fp long")


def _bits(fp: np.ndarray, first: int, bits: int) -> np.ndarray:
    return fp >> first & (1 << bits) - 1


def _keys(fp: np.ndarray, decode) -> np.ndarray:
    """Keys of all families, a row for each fingerprint; decode gives one or several codeword indices (-1: none)."""
    out = []
    decoded = {name: decode(_bits(fp, *place)).reshape(len(fp), -1) for name, place in SEGMENTS.items()}
    for family, (equal, other) in PAIRS.items():
        out.append((decoded[other], family, _bits(fp, *SEGMENTS[equal])))
    for family, (half_b, half_c) in HALVES.items():
        out.append((decoded["A"], family, _bits(fp, *half_b) << 9 | _bits(fp, *half_c)))
    return np.hstack([np.where(index >= 0, family << 40 | equal[:, None] << 12 | index, -1) for index, family, equal in out])


def _key_rows(distinct: DataFrame, decode) -> DataFrame:
    def batches(parts):
        for part in parts:
            fp = part.column("fp").to_numpy(zero_copy_only=False)
            keys = _keys(fp, decode)
            there = keys >= 0
            yield pa.RecordBatch.from_arrays([pa.array(keys[there]), pa.array(np.repeat(fp, there.sum(axis=1)))], ["key", "fp"])

    return distinct.mapInArrow(batches, "key long, fp long")


def _family():
    """The first family that is bound to find a pair within three bits, so each link is made once."""
    def differing(first, bits):
        mask = (1 << bits) - 1 << first
        return F.bit_count(F.col("x").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))

    a, b, c = (differing(*place) for place in SEGMENTS.values())
    low_b, low_c = differing(23, 12) == 0, differing(46, 9) == 0
    return (
        F.when((a == 0) & (b <= 1), 1).when(a == 0, 2).when((b == 0) & (a <= 1), 3).when(b == 0, 4)
        .when((c == 0) & (a <= 1), 5).when(c == 0, 6)
        .when(low_b & low_c, 7).when(low_b, 8).when(low_c, 9).otherwise(10)
    )


def links(distinct: DataFrame) -> DataFrame:
    """All pairs u < v of different fingerprints (column fp, each once) within three bits, each once."""
    homes = _key_rows(distinct, golay.nearest).withColumnRenamed("fp", "v")
    probes = _key_rows(distinct, golay.nearby).withColumnRenamed("fp", "u")
    x = F.col("u").bitwiseXOR(F.col("v"))
    # the conditions hold on the joined columns, so the join itself gives only verified links
    return (
        probes.join(homes, "key").filter((F.col("u") < F.col("v")) & (F.bit_count(x) <= MAX_BITS))
        .withColumn("x", x).filter(F.shiftright("key", 40) == _family()).select("u", "v")
    )


def near_groups(docs: DataFrame, shingle=3, seed=42) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_md5, fp (long), component_id, n_links, root (the component's smallest fingerprint).

    ``component_id`` is the smallest doc_id reachable over links (null only if the component has no
    doc_id), ``n_links`` the number of other fingerprints within three bits. Rows with equal
    fingerprints are one node; texts without words have fingerprint zero and are linked like any
    other. Null texts are empty. Repeated rows are all returned. An empty table gives no rows. Other
    columns of ``docs`` are not read.
    """
    rows = written(fingerprints(docs, shingle, seed), "fingerprints").withColumn("salt", salt_of("doc_id"))
    salted = rows.groupBy("fp", "salt").agg(F.min("doc_id").alias("least"))
    nodes = written(salted.groupBy("fp").agg(F.min("least").alias("least"), F.bit_or(salt_bit(F.col("salt"))).alias("salts")), "fingerprint-nodes")
    pairs = written(links(nodes.select("fp")), "fingerprint-links")
    roots = components(pairs)
    degrees = pairs.select(F.explode(F.array("u", "v")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))

    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(firsts, "root").join(degrees, "fp", "left").select(
        "fp", "root", "salts", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.join(one_row_per_salt(known), ["fp", "salt"]).select("doc_id", "text_md5", "fp", "component_id", "n_links", "root")


def one_per_group(docs: DataFrame, shingle=3, seed=42) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component the row with the smallest doc_id.

    If several rows have that doc_id, the one whose text has the smallest MD5 stays, once; of rows with equal
    doc_id and text but other columns, the one that reads least as JSON. Rows without doc_id stay only where their whole component has none.
    """
    groups = near_groups(docs, shingle, seed).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = groups.groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("text_md5").alias("text_md5")).drop("root")
    return one_of_each(docs, {"doc_id": F.col("doc_id").cast("long"), "text_md5": F.unhex(F.md5(whole_text(docs)))}, first)
