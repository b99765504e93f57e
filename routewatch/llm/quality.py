"""Document quality: statistics of whole texts, scored by histogram gradient-boosted trees.

The model is fitted on the driver on a bounded sample of labelled documents' statistics (at most
``TRAIN_ROWS`` labels); every document is scored in Arrow batches, by arrays a few kilobytes long.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .boosted_trees import Trees, train
from .shared import whole_text

#: Labels learned from: those with the smallest hashes of doc_id. The bound of the training sample.
TRAIN_ROWS = 20_000
SEED = 7
FEATURES = [
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digits", "blanks", "newlines", "stops", "marks",
    "symbols", "bars", "bangs", "high_bytes", "new_words", "root_words", "same_as_before", "new_pairs", "same_lines",
    "line_bytes", "short_words", "capital_words", "words_per_stop",
]


def _classes():
    kinds = np.zeros(256, np.uint8)
    for number, members in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "\n", ".", ",;:?'\"()-", "*#&%$@^~`<>=+_\\/{}[]", "|", "!"), 1):
        kinds[[ord(c) for c in members]] = number
    kinds[128:] = 10
    return kinds


_KIND = _classes()


def statistics(text: str) -> list[float]:
    """The features of one whole text. All are defined for an empty one."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(data))
    kinds = np.zeros(11)
    for at in range(0, len(data), 1 << 20):
        kinds += np.bincount(_KIND[data[at:at + (1 << 20)]], minlength=11)
    words = text.split()
    w = max(1, len(words))
    lengths = [len(x) for x in words] or [0]
    different = len(set(words))
    lines = text.split("\n")
    pairs = max(1, len(words) - 1)
    return [
        float(np.log1p(len(data))), float(np.log1p(len(words))), sum(lengths) / w, float(max(lengths)),
        kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n,
        kinds[7] / n, kinds[8] / n, kinds[9] / n, kinds[10] / n, different / w, different / w ** 0.5,
        sum(map(str.__eq__, words, words[1:])) / pairs, len(set(zip(words, words[1:]))) / pairs, 1 - len(set(lines)) / len(lines),
        float(np.log1p(len(data) / len(lines))), sum(x <= 3 for x in lengths) / w, sum(x[0].isupper() for x in words) / w,
        w / (1 + kinds[5]),
    ]


def fold(column="doc_id"):
    """crc32 of the doc_id as text, modulo 3; rows of remainder 1 are held out. A null doc_id is held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3, F.lit(1))


def fit(docs: DataFrame, labels: DataFrame, rows=TRAIN_ROWS, seed=SEED) -> Trees:
    """Trees from the documents that ``labels`` (doc_id, quality) marks, held-out rows excluded.

    At most ``rows`` labels are used, those with the smallest hashes of their doc_id. Null labels are
    left out; of several labels of a doc_id the smallest counts, of several texts that with the
    smallest statistics. Without a row of each class the model is the base rate.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marked = marked.filter("doc_id is not null and quality is not null").filter(fold() != 1).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # a bounded table: rows x 12 bytes
    sample = marked.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)

    def batches(parts):
        for part in parts:
            found = [statistics(t) for t in part.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("content"))
    found = texts.join(F.broadcast(sample), "doc_id").mapInArrow(batches, "doc_id long, quality int, x array<double>")
    got = found.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).orderBy("doc_id").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return train(x, got.column("quality").to_numpy().astype(float))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Null texts are scored as empty ones. Repeated rows are all returned, an empty table gives no rows.
    """
    def batches(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_scores(part.column("content"), model))], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("content"))
    return texts.mapInArrow(batches, "doc_id long, score double").select(
        "doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _scores(texts: pa.Array, model: Trees) -> np.ndarray:
    out = [model.scores(np.array([statistics(t or "") for t in texts.slice(at, 500).to_pylist()]).reshape(-1, len(FEATURES)))
           for at in range(0, len(texts), 500)]
    return np.concatenate(out) if out else np.zeros(0)


def accepted(docs: DataFrame, model: Trees, text="text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject (score >= 0.5)."""
    place = docs.columns.index(text)

    def batches(parts):
        for part in parts:
            yield part.filter(pa.array(_scores(part.column(place), model) >= 0.5))

    return docs.mapInArrow(batches, docs.schema)
