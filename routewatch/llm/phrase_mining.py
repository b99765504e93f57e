"""Phrase collocations by set-oriented mining: sorted occurrence relations, merge joins, group counts, semi joins.

R1 holds the word at each place of each piece, in order. R(k) joins R(k-1) with itself on equal piece and
adjacent place: two phrases of k-1 words that overlap make one of k. Its groups are counted over the corpus;
the frequent ones come back to R(k), and a semi join leaves only their occurrences before the next length.

Documents are dealt into chunks of a few megabytes. A relation lies in chunks, a row per document,
with the number of the group at each place (-1 where there is none: a piece ends, a group is rare).
Numbers are those of the chunk, so a merge join is one pass over adjacent places, and a
chunk's groups are counted before they move. Counts then go to buckets by the hash of the group,
as arrays; a bucket adds them up, numbers the frequent groups and sends these numbers to the chunks.
Groups are told apart by the numbers of their two parts, never by a hash.
"""

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .shared import discard, file_system, shared_folder, written

#: Bytes of text in a chunk, and occurrences of a bucket (a power of two): what a task holds at once.
CHUNK, BUCKET_BITS = 8 << 20, 20
#: Salts that rank a language's phrases before they meet.
RANK_SALTS = 32

#: Characters that end a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(ord(".") if c in ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


_WORDS = "kind int, chunk long, lang string, word binary, local int, n long, items array<int>"
_WORDS_SCHEMA = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("lang", pa.string()), ("word", pa.binary()), ("local", pa.int32()),
                           ("n", pa.int64()), ("items", pa.list_(pa.int32()))])


def _batch(schema, rows, **columns):
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _same(value, rows, kind):
    return pa.array(np.full(rows, value), kind)


def _lists(offsets, values, kind=pa.int32()):
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _words_of(texts):
    """Offsets of the documents, the words of all (a piece's end is ".") and the different ones."""
    plain = pa.array([t.translate(_PLAIN).replace(b".", b" . ") for t in texts], pa.binary())
    words = pc.split_pattern(plain, b" ")
    found = words.flatten().dictionary_encode()
    return words.offsets.to_numpy() - words.offsets[0].as_py(), found.indices.to_numpy(), found.dictionary


def _read(parts):
    """Chunks of documents: their words with counts (kind 0), and R1, a row per document (kind 1)."""
    at, next_chunk = TaskContext.get().partitionId(), 0
    for part in parts:
        texts, langs = part.column("content").to_pylist(), part.column("lang").to_pylist()
        ends = np.cumsum([len(t) for t in texts])
        for chosen in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends // CHUNK)) + 1):
            if not len(chosen):
                continue
            chunk, next_chunk, numbered = at << 32 | next_chunk, next_chunk + 1, 0
            by_lang = {}
            for i in chosen.tolist():
                by_lang.setdefault(langs[i], []).append(texts[i])
            for lang, own in by_lang.items():
                offsets, words, names = _words_of(own)
                special = pc.is_in(names, pa.array([b"", b"."], pa.binary())).to_numpy(zero_copy_only=False)
                empty = pc.equal(names, b"").to_numpy(zero_copy_only=False)
                number = np.where(special, -1, numbered + np.cumsum(~special) - 1).astype(np.int32)
                there = ~empty[words]
                items = number[words[there]]
                counts = np.bincount(words, minlength=len(names))[~special]
                n = len(counts)
                yield _batch(_WORDS_SCHEMA, n, kind=_same(0, n, pa.int32()), chunk=_same(chunk, n, pa.int64()), lang=pa.array([lang] * n, pa.string()),
                             word=names.filter(pa.array(~special)), local=pa.array(number[~special]), n=pa.array(counts, pa.int64()))
                n, kept = len(own), np.concatenate(([0], np.cumsum(there)))[offsets]
                yield _batch(_WORDS_SCHEMA, n, kind=_same(1, n, pa.int32()), chunk=_same(chunk, n, pa.int64()), items=_lists(kept, items))
                numbered += int((~special).sum())


_JOINED = "kind int, chunk long, bucket int, base int, a array<long>, b array<long>, n array<long>, items array<int>"
_JOINED_SCHEMA = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("base", pa.int32()), ("a", pa.list_(pa.int64())),
                            ("b", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("items", pa.list_(pa.int32()))])


def _bucket_of(a, b, buckets):
    """A bucket for each group, by its parts."""
    mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


class _Chunk:
    """One chunk's relation and the numbers of its frequent groups, gathered while its rows go past."""

    def __init__(self, chunk):
        self.chunk, self.locals, self.gids, self.items, self.sizes = chunk, [], [], [], []

    def add(self, part):
        kinds = part.column("kind").to_numpy()
        frequent = int((kinds == 0).sum())
        if frequent:
            self.locals.append(part.column("locals").slice(0, frequent).flatten().to_numpy())
            self.gids.append(part.column("gids").slice(0, frequent).flatten().to_numpy())
        items = part.column("items").slice(frequent)
        if len(items):
            self.items.append(items.flatten().to_numpy())
            self.sizes.append(np.diff(items.offsets.to_numpy()))

    def joined(self, buckets, keep):
        """The merge join: groups of this chunk by bucket (kind 0), and the relation they make (kind 1)."""
        if not self.items or not self.locals:
            return
        items, sizes = np.concatenate(self.items), np.concatenate(self.sizes)
        local, gids = np.concatenate(self.locals), np.concatenate(self.gids)
        gid = np.full(max(int(items.max(initial=-1)), int(local.max(initial=-1))) + 2, -1, np.int64)
        gid[local] = gids  # the semi join: rare groups stay -1, as does -1 itself, the last place
        common = gid[items] >= 0
        adjacent = common[:-1] & common[1:]
        ends = np.cumsum(sizes)
        adjacent[ends[(ends > 0) & (ends < len(items))] - 1] = False  # not over the end of a document
        at = np.flatnonzero(adjacent)
        if not len(at):
            return
        pairs, where, n = np.unique(items[at].astype(np.int64) << 32 | items[at + 1], return_inverse=True, return_counts=True)
        a, b = gid[pairs >> 32], gid[pairs & 0xFFFFFFFF]
        bucket = _bucket_of(a, b, buckets)
        order = np.lexsort((b, a, bucket))
        a, b, n, bucket = a[order], b[order], n[order], bucket[order]
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        offsets = np.append(starts, len(a))
        rows = len(starts)
        yield _batch(_JOINED_SCHEMA, rows, kind=_same(0, rows, pa.int32()), chunk=_same(self.chunk, rows, pa.int64()), bucket=pa.array(bucket[starts]),
                     base=pa.array(starts, pa.int32()), a=_lists(offsets, a, pa.int64()), b=_lists(offsets, b, pa.int64()), n=_lists(offsets, n, pa.int64()))
        if keep:
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            made = np.full(len(items), -1, np.int32)
            made[at] = rank[where.reshape(-1)]
            rows = len(sizes)
            for first in range(0, rows, 1000):
                own = sizes[first:first + 1000]
                begin = int(ends[first] - sizes[first])
                yield _batch(_JOINED_SCHEMA, len(own), kind=_same(1, len(own), pa.int32()), chunk=_same(self.chunk, len(own), pa.int64()),
                             items=_lists(np.concatenate(([0], np.cumsum(own))), made[begin:begin + int(own.sum())]))


def _runs(part, column):
    values = part.column(column).to_numpy()
    cuts = np.flatnonzero(np.diff(values)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), part.num_rows]):
        if b > a:
            yield values[a], part.slice(a, b - a)


def _join(buckets, keep):
    def batches(parts):
        now = None
        for part in parts:
            for chunk, rows in _runs(part, "chunk"):
                if now is None or chunk != now.chunk:
                    if now:
                        yield from now.joined(buckets, keep)
                    now = _Chunk(chunk)
                now.add(rows)
        if now:
            yield from now.joined(buckets, keep)

    return batches


_COUNTED = "kind int, gid long, a long, b long, f long, chunk long, locals array<int>, gids array<long>"
_COUNTED_SCHEMA = pa.schema([("kind", pa.int32()), ("gid", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("f", pa.int64()),
                             ("chunk", pa.int64()), ("locals", pa.list_(pa.int32())), ("gids", pa.list_(pa.int64()))])


def _counted(bucket, parts, buckets, least):
    """The frequent groups of a bucket (kind 0), numbered, and where each chunk has them (kind 1)."""
    flat = lambda name: np.concatenate([p.column(name).flatten().to_numpy() for p in parts])
    sizes = np.concatenate([np.diff(p.column("a").offsets.to_numpy()) for p in parts])
    chunks, base = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("chunk", "base"))
    a, b, n = flat("a"), flat("b"), flat("n")
    order = np.lexsort((b, a))
    new = np.concatenate(([True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)))
    group = np.cumsum(new) - 1
    f = np.add.reduceat(n[order], np.flatnonzero(new))
    frequent = f >= least
    number = np.where(frequent, (np.cumsum(frequent) - 1) * buckets + bucket, -1)
    first = order[np.flatnonzero(new)][frequent]
    rows = len(first)
    if not rows:
        return
    yield _batch(_COUNTED_SCHEMA, rows, kind=_same(0, rows, pa.int32()), gid=pa.array(number[frequent]), a=pa.array(a[first]), b=pa.array(b[first]), f=pa.array(f[frequent]))
    gid = np.empty(len(a), np.int64)
    gid[order] = number[group]
    local = np.arange(len(a)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(base, sizes)
    there = gid >= 0
    offsets = np.concatenate(([0], np.cumsum(there)))[np.concatenate(([0], np.cumsum(sizes)))]
    rows = len(sizes)
    yield _batch(_COUNTED_SCHEMA, rows, kind=_same(1, rows, pa.int32()), chunk=pa.array(chunks), locals=_lists(offsets, local[there]), gids=_lists(offsets, gid[there], pa.int64()))


def _count(buckets, least):
    def batches(parts):
        now, held = None, []
        for part in parts:
            for bucket, rows in _runs(part, "bucket"):
                if bucket != now:
                    if held:
                        yield from _counted(now, held, buckets, least)
                    now, held = bucket, []
                held.append(rows)
        if held:
            yield from _counted(now, held, buckets, least)

    return batches


def _by_kind(df: DataFrame, name: str) -> list[DataFrame]:
    """``df`` written out, a folder for each kind (0 and 1); one kind's table can go before the other's."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    files, at = file_system(path)
    schema, there = df.drop("kind").schema, {found.base_name for found in files.get_file_info(fs.FileSelector(at))}
    return [spark.read.schema(schema).parquet(f"{path}/kind={kind}") if f"kind={kind}" in there else spark.createDataFrame([], schema) for kind in (0, 1)]


def _drop(df: DataFrame):
    if df.inputFiles():
        discard(df)


def _first_groups(words: DataFrame, least: int) -> DataFrame:
    """gid, lang, word, f of the frequent words; gids are small numbers."""
    counted = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    made = written(counted.withColumn("m", F.monotonically_increasing_id()), "frequent-words")
    parts = 1 + (made.agg(F.max(F.shiftright("m", 33))).first()[0] or 0)
    return made.withColumn("gid", F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) * parts + F.shiftright("m", 33)).drop("m")


def phrases(docs: DataFrame, longest=3, least=10) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each language (lang, n), and the frequent phrases by length from one word on.

    A length's table has gid, lang, phrase, f, first and last (the phrases of one word less, by gid), and heads and
    tails: the counts of its beginnings and ends by their lengths. Null texts are empty, null languages ``und``.
    """
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary").alias("content"))
    words, relation = _by_kind(read.mapInArrow(_read, _WORDS), "words")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
    occurrences = totals.agg(F.sum("n")).first()[0] or 0
    buckets = 1 + (occurrences >> BUCKET_BITS)
    one = _first_groups(words, least)
    found = [one.select("gid", "lang", F.col("word").cast("string").alias("phrase"), "f", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"),
                        F.array("f").alias("heads"), F.array("f").alias("tails"))]
    numbers = words.join(one.select("lang", "word", "gid"), ["lang", "word"]).select("chunk", F.array("local").alias("locals"), F.array("gid").alias("gids"))
    relation = relation.select("chunk", "items")
    for length in range(2, longest + 1):
        met = numbers.withColumn("kind", F.lit(0)).unionByName(relation.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        met = met.select("chunk", "kind", "locals", "gids", "items").repartition("chunk").sortWithinPartitions("chunk", "kind")
        groups, made = _by_kind(met.mapInArrow(_join(buckets, length < longest), _JOINED), f"occurrences-{length}")
        _drop(relation)
        if length == 2:
            _drop(words)
        dealt = groups.select("bucket", "chunk", "base", "a", "b", "n").repartition("bucket").sortWithinPartitions("bucket", "chunk", "base")
        counted, numbers = _by_kind(dealt.mapInArrow(_count(buckets, least), _COUNTED), f"groups-{length}")
        _drop(groups)
        numbers, relation = numbers.select("chunk", "locals", "gids"), made.select("chunk", "items")
        before = found[-1]
        left = before.select(F.col("gid").alias("a"), "lang", F.col("phrase").alias("begin"), "heads")
        right = before.select(F.col("gid").alias("b"), F.substring_index("phrase", " ", -1).alias("end"), "tails")
        whole = counted.select("gid", "a", "b", "f").join(left, "a").join(right, "b")
        found.append(written(whole.select("gid", "lang", F.concat_ws(" ", "begin", "end").alias("phrase"), "f", "a", "b",
                                          F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails")), f"phrases-{length}"))
    return totals, found


def _scored(table: DataFrame, length: int) -> DataFrame:
    """lang, phrase, gid, a, l, r, score: by the cut with the lowest score, the first of equal ones."""
    above = (F.lit(1_000_000).cast("decimal(7,0)") * F.col("f").cast("decimal(15,0)") * F.col("f").cast("decimal(15,0)")).cast("decimal(38,0)")
    cuts = []
    for at in range(1, length):
        left, right = F.get("heads", F.lit(at - 1)), F.get("tails", F.lit(length - at - 1))
        below = (left.cast("decimal(19,0)") * right.cast("decimal(19,0)")).cast("decimal(38,0)")
        cuts.append(F.struct(F.call_function("div", above, below).alias("score"), F.lit(at).alias("at"), left.alias("l"), right.alias("r")))
    return table.withColumn("cut", F.array_min(F.array(*cuts))).select("gid", "lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, longest=3, least=10, share=50, first=2000) -> DataFrame:
    """The ``first`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, these into words at blanks and tabs.
    Candidates have 2 to ``longest`` words and occur ``least`` times or more, overlaps included. The score is
    floor(10^6 a^2 / (l r)), exact, for the cut that gives the lowest, the first of equal ones. A candidate
    inside a longer one that has ``share`` percent or more of its occurrences is left out; that longer one may be
    left out itself, and what holds for one of any length holds for one that is a word longer, so only those are
    looked at. Ties go to the higher a, then the lesser phrase in bytes. Null texts are empty, null languages ``und``; repeated
    rows count each time; an empty table gives no rows, and other columns are not read.
    """
    totals, found = phrases(docs, longest, least)
    kept = []
    for length in range(2, longest + 1):
        table = _scored(found[length - 1], length)
        if length < longest:
            longer = found[length]
            most = longer.select(F.col("a").alias("gid"), "f").unionByName(longer.select(F.col("b").alias("gid"), "f")).groupBy("gid").agg(F.max("f").alias("most"))
            table = table.join(most, "gid", "left").filter(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))).drop("most")
        kept.append(table.drop("gid"))
    rows = functools.reduce(DataFrame.unionByName, kept)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
