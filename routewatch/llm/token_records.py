"""Token ids in length-delimited record files with an offset index.

A record file is a row of frames: length of the data (8 bytes, little-endian), its masked CRC-32C (4),
the data (the sequence's ids as little-endian unsigned integers, of 16 bits if the vocabulary has at
most 65,536 ids, else of 32), the data's masked CRC-32C (4). This is the framing of TFRecord files. Beside each record file lies an index, a Parquet file with one
row per record (doc_id, offset, n_tokens), so that a reader can fetch records in any order.

Files are written in ascending doc_id order over all shards. A task writes under a name of its own and
reports it in the manifest, which is a written table: what failed or repeated attempts leave behind is
not in it, and later steps read the manifest alone.
"""

import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .byte_letters import LETTERS
from .crc32c import crc32c, masked
from .recent import Recent
from .shared import file_system, shared_folder, whole_text

END_ID = 1
#: Whole words and their letters kept per Python worker; those that drop out are encoded again.
KEPT_WORDS, KEPT_LETTERS, KEPT_MARKS = 150_000, 300_000, 10_000
#: A word of Latin letters and marks behind it: the vocabulary's pattern parts them, and lower-cases letters one by one.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*#&%$]*)")
FRAME = 16
MANIFEST = "shard long, records_file string, index_file string, n_records long, n_tokens long, n_bytes long, id_bytes int"


class WordEncoder:
    """Ids of whole texts by a vocabulary that drops white space, word by word.

    No token holds white space, and neither the vocabulary's normaliser nor its pattern looks across
    it, so a text's ids are those of its words in turn.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.id_bytes = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = "H" if self.id_bytes == 2 else "I"
        self.words = Recent(KEPT_WORDS, self._word)
        self.letters, self.marks = Recent(KEPT_LETTERS, self._letters), Recent(KEPT_MARKS, self._any)

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.letters[word.lower()]
        plain = PLAIN.fullmatch(word)
        return self.letters[plain[1].lower()] + self.marks[plain[2]] if plain else self._any(word)

    def _letters(self, letters: str) -> bytes:
        """One pre-token of lower-case letters: the vocabulary's merges alone."""
        written = letters if letters.isascii() else "".join(map(LETTERS.__getitem__, letters.encode("utf-8")))
        return self._packed([t.id for t in self.library.model.tokenize(written)])

    def _any(self, text: str) -> bytes:
        return self._packed(self.library.encode(text, add_special_tokens=False).ids)

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.kind}", *ids)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def frames(parts: list[bytes]) -> list[bytes]:
    """The parts as frames."""
    lengths = [struct.pack("<Q", len(p)) for p in parts]
    heads, tails = masked(crc32c(lengths)), masked(crc32c(parts))
    return [b"".join((n, struct.pack("<I", h), p, struct.pack("<I", t)))
            for n, h, p, t in zip(lengths, heads.tolist(), parts, tails.tolist())]


def unframed(data: bytes, offsets: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The data of the frames at the offsets; raises ValueError where a length or a checksum is wrong."""
    heads = [data[o:o + 8] for o in offsets.tolist()]
    parts = [data[o + 12:o + 12 + n] for o, n in zip(offsets.tolist(), sizes.tolist())]
    said = np.array([struct.unpack("<Q", h)[0] if len(h) == 8 else -1 for h in heads], np.int64)
    if (said != sizes).any() or [len(p) for p in parts] != sizes.tolist():
        raise ValueError("a frame's length is not the index's")
    sums = np.array([struct.unpack("<II", data[o + 8:o + 12] + data[o + 12 + n:o + FRAME + n])
                     for o, n in zip(offsets.tolist(), sizes.tolist())], np.uint32).reshape(-1, 2)
    if (masked(crc32c(heads)) != sums[:, 0]).any() or (masked(crc32c(parts)) != sums[:, 1]).any():
        raise ValueError("a frame's checksum is wrong")
    return parts


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def write_records(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id=END_ID) -> DataFrame:
    """Encode every whole text and write the shards; returns the manifest, one row per shard in doc_id order.

    Null texts are empty; an empty text is the record of the end id alone. Rows without doc_id come
    first, rows repeated with one doc_id stand side by side, each a record. An empty table gives an
    empty manifest. Other columns of ``docs`` are not read. ``folder`` is a URI that every executor
    can write to; the default is a new one in the shared folder.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-records")
    manifest = f"{folder}/manifest"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("content"))
    # the text breaks ties, so rows repeated with one doc_id can go to several shards
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("content")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _shard_writer(folder, vocabulary, end_id), MANIFEST).write.mode("overwrite").parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def _shard_writer(folder, vocabulary, end_id):
    def write(parts):
        words = encoder(vocabulary)
        encode, width, end = words.encode, words.id_bytes, end_id.to_bytes(words.id_bytes, "little")
        shard, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        files, root = file_system(folder)
        offset, ids, offsets, counts, out = 0, [], [], [], None
        for part in parts:
            if out is None and part.num_rows:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(f"{root}/shard-{shard:06d}-{name}.records")
            texts = part.column("content")
            for at in range(0, part.num_rows, 500):
                data = [encode(text) + end for text in texts.slice(at, 500).to_pylist()]
                out.write(b"".join(frames(data)))
                for d in data:
                    offsets.append(offset)
                    counts.append(len(d) // width)
                    offset += FRAME + len(d)
            ids.append(part.column("doc_id"))
        if out is not None:
            out.close()
            index = pa.table({"doc_id": pa.chunked_array(ids, pa.int64()), "offset": pa.array(offsets, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
            with files.open_output_stream(f"{root}/shard-{shard:06d}-{name}.index") as sink:
                pq.write_table(index, sink)
            stem = f"{folder}/shard-{shard:06d}-{name}"
            yield pa.RecordBatch.from_pylist([{
                "shard": shard, "records_file": f"{stem}.records", "index_file": f"{stem}.index",
                "n_records": len(offsets), "n_tokens": sum(counts), "n_bytes": offset, "id_bytes": width}], schema=_arrow(MANIFEST))

    return write


def _read_shards(parts):
    # Workers are used again: words kept for writing would fill their memory through all later stages.
    _ENCODERS.clear()
    for part in parts:
        for row in part.to_pylist():
            files, path = file_system(row["records_file"])
            _, index_path = file_system(row["index_file"])
            with files.open_input_file(index_path) as source:
                index = pq.read_table(source)
            offsets, counts, width = index["offset"].to_numpy(), index["n_tokens"].to_numpy(), row["id_bytes"]
            start = row["before"] + np.cumsum(counts) - counts
            with files.open_input_file(path) as source:
                for at in range(0, len(offsets), 500):
                    o, n = offsets[at:at + 500], counts[at:at + 500]
                    data = source.read_at(int(o[-1] - o[0] + FRAME + width * n[-1]), int(o[0]))
                    ids = unframed(data, o - o[0], width * n)
                    sums = [zlib.crc32(np.frombuffer(p, f"<u{width}").astype("<u4").tobytes()) for p in ids]
                    yield pa.RecordBatch.from_arrays([
                        index["doc_id"].slice(at, 500).combine_chunks(), pa.array(start[at:at + 500]), pa.array(n),
                        pa.array(sums, pa.int64()), pa.array(np.full(len(o), row["shard"], np.int64)), pa.array(o)],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset"])


def read_records(manifest: DataFrame) -> DataFrame:
    """One row per record, read back from the files: doc_id, start, n_tokens, ids_crc32, shard, offset.

    ``start`` counts the ids of all records before it, in the manifest's order. Lengths and checksums
    are verified; a damaged file raises.
    """
    spark: SparkSession = manifest.sparkSession
    shards = manifest.count()
    # one row per shard, so this window is small however large the files are
    starts = manifest.withColumn("before", F.coalesce(
        F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, offset long"
    if not shards:
        return spark.createDataFrame([], schema)
    return starts.repartition(min(shards, 10_000)).mapInArrow(_read_shards, schema)
