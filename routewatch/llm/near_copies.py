"""One document of each group of near copies: op10's groups, prefix-filter join of five-word shingles, exact similarity, components.

Two texts are near copies if the sets of their shingles have a Jaccard similarity of 0.8 or more. Such a
text shares at least 0.8 n of its n shingles, so under any order of all shingles the first
n - ceil(0.8 n) + 1 of both texts have one in common. The order puts shingles that are frequent in a
sample last, the most frequent at the end; a poor sample costs time, never a pair. Of the first shingle
that two texts share, at places i and j, no more follow than the smaller of the two rests: pairs for
which that is too few are no candidates there, and every near copy is one at its first.

op10's groups (fingerprints within three bits) come first: each of their sets is compared with one of its group,
as fingerprints link texts that are not similar, too. They lack most near copies, as their fingerprints are
further apart; the join finds these and compares only what is then left in different components.

For the join texts are hashed once. Their prefixes go to buckets by the shingle's hash, as arrays; a bucket keeps what
several texts share, a small part. Only components are asked for, so texts that share a shingle
are first compared with one of them, then, where that left several components, with those of other
components. Of each set there is a small sketch, how many of its hashes fall into each of 256 classes; two
sets share no more than the smaller counts add up to, which rules out nearly all pairs that are not
similar. The others are verified on whole texts: a text meets all that are compared with it in tasks that
hash it once.

Shingles, and sets as nodes, are told apart by 64-bit hashes.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components
from .decontamination import run_hashes, shingles
from .shared import discard, one_of_each, one_row_per_salt, salt_bit, salt_of, whole_text, written
from .simhash_dedup import near_groups

SHINGLE = 5
#: Similarity as a fraction.
PART, WHOLE = 4, 5
#: One text of so many is in the sample that finds frequent shingles; at most 2^LARGEST of these are kept.
SAMPLE, LARGEST = 32, 21
#: Texts hashed at once, bytes of text a bucket answers for (a power of two), and prefix shingles a bucket takes in at once.
TEXTS, BUCKET_BITS, SLAB = 1000, 24, 1 << 20
#: Classes of a sketch and the largest count it holds.
CLASSES, MOST = 256, (1 << 16) - 1

_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False


def shingle_set(text: str) -> np.ndarray:
    """Hashes of the text's shingles, sorted, each once. Words are op10's: cut at ASCII white space, only A-Z lower-cased."""
    return np.unique(shingles(run_hashes(text.encode("utf-8", "surrogatepass").lower(), _WORD), SHINGLE))


def node_of(hashes: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), 42)).view(np.int64)))


def sketch(hashes: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each class; ``MOST`` stands for so many or more."""
    counts = np.bincount((hashes >> np.uint64(24)).astype(np.int64) % CLASSES, minlength=CLASSES)
    return np.minimum(counts, MOST).astype("<u2").tobytes()


def prefix(hashes: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set that every near copy shares one of. ``frequent`` is sorted, ``rank`` its order."""
    many = len(hashes) + (-PART * len(hashes) // WHOLE) + 1
    if not len(frequent) or not len(hashes):
        return hashes[:many] if len(hashes) else hashes
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    late = frequent[at] == hashes
    last = hashes[late][np.argsort(rank[at[late]], kind="stable")]
    return np.concatenate((hashes[~late], last))[:many]


def _signed(hashes):
    return pa.array(np.ascontiguousarray(hashes).view(np.int64))


def _sampled_shingles(parts):
    for part in parts:
        for at in range(0, part.num_rows, TEXTS):
            sets = {node_of(s): s for s in (shingle_set(t.as_py()) for t in part.column("content").slice(at, TEXTS))}
            if sets:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(list(sets.values())))], ["h"])


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several sampled texts have, sorted, and their ranks, the rarest first."""
    found = written(texts.filter(F.pmod(F.xxhash64("text_md5"), F.lit(SAMPLE)) == 0).select("content").mapInArrow(_sampled_shingles, "h long"), "sampled-shingles")
    counts = found.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= max(3, (found.count() >> LARGEST) + 1)).toArrow()
    discard(found)
    hashes, df = (counts.column(c).to_numpy() for c in ("h", "df"))
    order = np.argsort(hashes.view(np.uint64))
    hashes, df = hashes.view(np.uint64)[order], df[order]
    rank = np.empty(len(df), np.int64)
    rank[np.lexsort((hashes, df))] = np.arange(len(df))
    return hashes, rank


_DEALT = "kind int, bucket int, doc_id long, text_md5 binary, node long, n long, sketch binary, h array<long>, nodes array<long>, at array<int>"
_DEALT_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("text_md5", pa.binary()), ("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()),
                           ("h", pa.list_(pa.int64())), ("nodes", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])


def _batch(schema, rows, **columns):
    """A batch with the given columns; of the others lists are empty (null ones cost Spark time for each row of a batch) and the rest null."""
    def without(kind):
        return pa.ListArray.from_arrays(np.zeros(rows + 1, np.int32), pa.nulls(0, kind.value_type)) if pa.types.is_list(kind) else pa.nulls(rows, kind)

    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else without(f.type) for f in schema], schema=schema)


def _same(value, rows):
    return pa.array(np.full(rows, value, np.int32))


def _dealt(buckets, frequent, rank):
    """Every row with its node (kind 0), and the prefixes of the batch's different nodes, by bucket (kind 1)."""
    def batches(parts):
        for part in parts:
            for at in range(0, part.num_rows, TEXTS):
                texts = part.slice(at, TEXTS)
                sets = [shingle_set(t.as_py()) for t in texts.column("content")]
                nodes = np.array([node_of(s) for s in sets], np.int64)
                many = len(nodes)
                yield _batch(_DEALT_SCHEMA, many, kind=_same(0, many), bucket=pa.array((nodes.view(np.uint64) % np.uint64(buckets)).astype(np.int32)),
                             doc_id=texts.column("doc_id"), text_md5=texts.column("text_md5"), node=pa.array(nodes), n=pa.array([len(s) for s in sets], pa.int64()),
                             sketch=pa.array([sketch(s) for s in sets], pa.binary()))
                nodes, first = np.unique(nodes, return_index=True)
                taken = [prefix(sets[i], frequent, rank) for i in first]
                sizes = np.array([len(t) for t in taken])
                h = np.concatenate(taken)
                place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                # the low bits: the high ones order the shingles of a prefix
                bucket = (h % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                offsets = pa.array(np.append(starts, len(h)), pa.int32())
                list_of = lambda values: pa.ListArray.from_arrays(offsets, values)
                yield _batch(_DEALT_SCHEMA, len(starts), kind=_same(1, len(starts)), bucket=pa.array(bucket[order][starts]), h=list_of(_signed(h[order])),
                             nodes=list_of(pa.array(np.repeat(nodes, sizes)[order])), at=list_of(pa.array(place[order], pa.int32())))

    return batches


_MET = "kind int, doc_id long, text_md5 binary, node long, n long, sketch binary, h long, at int"
_MET_SCHEMA = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("text_md5", pa.binary()), ("node", pa.int64()), ("n", pa.int64()),
                         ("sketch", pa.binary()), ("h", pa.int64()), ("at", pa.int32())])


class _Bucket:
    """The shingles of a bucket with the first node of each; gives the rows of those that a second node has."""

    def __init__(self):
        self.h = self.node = np.zeros(0, np.int64)
        self.at, self.met = np.zeros(0, np.int32), np.zeros(0, bool)
        self.held, self.size = [], 0

    def add(self, rows):
        self.held.append([rows.column(c).flatten().to_numpy() for c in ("h", "nodes", "at")])
        self.size += len(self.held[-1][0])
        if self.size >= SLAB:
            yield from self.flush()

    def flush(self):
        if not self.size:
            return
        h, node, at = (np.concatenate([*c]) for c in zip((self.h, self.node, self.at), *self.held))
        known = np.arange(len(h)) < len(self.h)  # rows that were here before, the first of their shingle
        self.held, self.size = [], 0
        order = np.lexsort((~known, h))
        h, node, at, known = h[order], node[order], at[order], known[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        group = np.cumsum(np.concatenate(([True], h[1:] != h[:-1]))) - 1
        met_before = np.zeros(len(h), bool)
        met_before[known] = self.met[np.argsort(self.h, kind="stable")] if len(self.h) else False
        other = node != node[first][group]
        met = np.maximum.reduceat(other, first) | met_before[first]
        # a new row goes out if its shingle has met another node; the first one goes out once, when that happens
        out = met[group] & ~known
        out[first] = met & ~met_before[first]
        self.h, self.node, self.at, self.met = h[first], node[first], at[first], met
        rows = int(out.sum())
        if rows:
            yield _batch(_MET_SCHEMA, rows, kind=_same(1, rows), h=pa.array(h[out]), node=pa.array(node[out]), at=pa.array(at[out]))


def _meeting(parts):
    bucket, number = _Bucket(), None
    for part in parts:
        kinds, buckets = part.column("kind").to_numpy(), part.column("bucket").to_numpy()
        cuts = np.flatnonzero((np.diff(kinds) != 0) | (np.diff(buckets) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), part.num_rows]):
            if a == b:
                continue
            rows = part.slice(a, b - a)
            if kinds[a] == 0:
                yield _batch(_MET_SCHEMA, b - a, kind=_same(0, b - a), **{c: rows.column(c) for c in ("doc_id", "text_md5", "node", "n", "sketch")})
                continue
            if buckets[a] != number:
                yield from bucket.flush()
                bucket, number = _Bucket(), buckets[a]
            yield from bucket.add(rows)
    yield from bucket.flush()


def _candidate(u: dict, v: dict):
    """Whether two different nodes of a shingle can be similar by their sizes and the shingle's places in them."""
    follow = F.least(u["n"] - u["at"], v["n"] - v["at"])  # with the shingle itself
    fits = (PART * u["n"] <= WHOLE * v["n"]) & (PART * v["n"] <= WHOLE * u["n"])
    return (u["root"] != v["root"]) & fits & ((PART + WHOLE) * follow >= PART * (u["n"] + v["n"]))


def _with_leads(rows: DataFrame) -> DataFrame:
    """Pairs lead, node, each once, of a shingle's lead and its other nodes."""
    names = ("node", "n", "at", "root")
    met = rows.filter(_candidate({c: F.col(f"lead.{c}") for c in names}, {c: F.col(c) for c in names}))
    return met.select(F.col("lead.node").alias("lead"), "node").distinct()


def _all_pairs(rows: DataFrame) -> DataFrame:
    """Pairs lead < node, each once, of nodes of one shingle in different components."""
    names = ("node", "n", "at", "root")
    u, v = (rows.select("h", *[F.col(c).alias(f"{c}_{end}") for c in names]) for end in "uv")
    met = u.join(v, "h").filter(F.col("node_u") < F.col("node_v")).filter(_candidate(*[{c: F.col(f"{c}_{end}") for c in names} for end in "uv"]))
    return met.select(F.col("node_u").alias("lead"), F.col("node_v").alias("node")).distinct()


def _shareable(parts):
    """Pairs whose sketches let them share enough."""
    for part in parts:
        u, v = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u2").reshape(-1, CLASSES) for c in ("sketch_u", "sketch_v"))
        most = np.minimum(u, v).sum(axis=1, dtype=np.int64)
        full = ((u == MOST) & (v == MOST)).any(axis=1)
        fits = full | ((PART + WHOLE) * most >= PART * (part.column("n_u").to_numpy() + part.column("n_v").to_numpy()))
        yield part.select(["lead", "node"]).filter(pa.array(fits))


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs lead, node that can be similar by their sketches; ``nodes`` has node, n, sketch."""
    for end, name in (("lead", "u"), ("node", "v")):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}")), end)
    return pairs.select("lead", "node", "n_u", "n_v", "sketch_u", "sketch_v").mapInArrow(_shareable, "lead long, node long")


def _verify(parts):
    """Pairs that are similar enough; the rows of a lead come before those that are compared with it."""
    lead, own = None, None
    for part in parts:
        found = []
        for number, kind, node, text in zip(*(part.column(c) for c in ("lead", "kind", "node", "content"))):
            if kind.as_py() == 0:
                lead, own = number.as_py(), shingle_set(text.as_py())
            else:
                other = shingle_set(text.as_py())
                shared = len(np.intersect1d(own, other, assume_unique=True))
                if (PART + WHOLE) * shared >= PART * (len(own) + len(other)):
                    found.append((lead, node.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["u", "v"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v of the pairs (lead, node) whose texts (node, content) are similar enough."""
    members = pairs.withColumn("salt", salt_of("node")).join(texts, "node").withColumn("kind", F.lit(1))
    leads = pairs.groupBy("lead").agg(F.bit_or(salt_bit(salt_of("node"))).alias("salts")).withColumn("node", F.col("lead")).join(texts, "node")
    rows = one_row_per_salt(leads).withColumn("kind", F.lit(0)).unionByName(members)
    rows = rows.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "kind")
    return rows.select("lead", "kind", "node", "content").mapInArrow(_verify, "u long, v long")


def _open(shared: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows of shingles that nodes of several components share, with their roots and the shingle's next lead.

    A shingle is led by the node that shares most shingles, of those that have not led it yet.
    """
    rows = shared.select("h", "node", "n", "at", "degree", "led")
    rooted = rows.withColumn("root", F.col("node")) if roots is None else rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = rooted.withColumn("salt", salt_of("node"))
    lead = F.min(F.when(~F.col("led"), F.struct((-F.col("degree")).alias("by"), F.xxhash64("node").alias("tie"), "node", "n", "at", "root"))).alias("lead")
    salted = rooted.groupBy("h", "salt").agg(F.min("root").alias("low"), F.max("root").alias("high"), lead)
    several = salted.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("lead").alias("lead"), F.bit_or(salt_bit(F.col("salt"))).alias("salts"))
    several = several.filter("low <> high").select("h", "lead", "salts")
    return written(rooted.join(one_row_per_salt(several), ["h", "salt"]), "open-shingles")


def fingerprint_pairs(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs lead, node, each once: of each of op10's groups the smallest node and the others. ``nodes`` has node and the text_md5 of one of its texts."""
    groups = near_groups(docs).select("text_md5", F.col("root").alias("group")).distinct()
    grouped = nodes.select("node", "text_md5").join(groups, "text_md5").select("group", "node").withColumn("salt", salt_of("node"))
    salted = grouped.groupBy("group", "salt").agg(F.min("node").alias("lead"), F.max("node").alias("high"))
    leads = salted.groupBy("group").agg(F.min("lead").alias("lead"), F.max("high").alias("high"), F.bit_or(salt_bit(F.col("salt"))).alias("salts"))
    leads = one_row_per_salt(leads.filter("lead <> high").drop("high"))
    return grouped.join(leads, ["group", "salt"]).filter("node <> lead").select("lead", "node")


def _near(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v of the pairs (lead, node) that are similar enough, written; ``texts`` has node, n, sketch and content."""
    possible = written(_possible(pairs, texts.drop("content")), "possible-pairs")
    found = written(verified(possible, texts.select("node", "content")), "near-copies")
    discard(possible)
    return found


def near_components(shared: DataFrame, texts: DataFrame, compared: DataFrame) -> DataFrame | None:
    """node, root of all nodes with a near copy, from the shingles that they share (h, node, n, at); None if there are none.

    ``texts`` has node, n, sketch and content of these nodes. The written pairs ``compared`` (lead, node) are compared
    first: no node is in two groups, the smallest node leads, so the similar ones are components as they are.
    """
    links, rounds, before = _near(compared, texts), 0, None
    roots = None if links.isEmpty() else links.select(F.col("v").alias("node"), F.col("u").alias("root"))
    degrees = shared.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    shared = shared.join(degrees, "node").withColumn("led", F.lit(False))
    while True:
        rows = _open(shared, roots)
        if rounds:
            discard(shared)  # the open rows before these
        left = rows.count()
        if not left:
            discard(rows)
            return roots
        # as long as comparing with one lead for each shingle closes a tenth of what is open, another round follows; then all that is left
        last = before is not None and 10 * left > 9 * before
        before, rounds = left, rounds + 1
        pairs = _all_pairs(rows) if last else _with_leads(rows)
        # in either direction
        either = compared.unionByName(compared.select(F.col("node").alias("lead"), F.col("lead").alias("node")))
        pairs = written(pairs.join(either, ["lead", "node"], "left_anti"), "compared")
        found = _near(pairs, texts)
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = components(links)
        if last:
            return roots
        shared = rows.withColumn("led", F.col("led") | F.coalesce(F.col("node") == F.col("lead.node"), F.lit(False)))
        compared = compared.unionByName(pairs)


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each group linked over near copies the row with the smallest doc_id.

    If several rows have that doc_id, the one whose text has the smallest MD5 stays, once; of rows with equal
    doc_id and text but other columns, the one that reads least as JSON. Rows without doc_id stay only where their
    whole group has none. A text of fewer words than five is one shingle; texts without words are copies of
    each other; null texts are empty. An empty table gives no rows.
    """
    text = whole_text(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("text_md5"), text.alias("content"))
    buckets = 1 + ((texts.agg(F.sum(F.octet_length("content"))).first()[0] or 0) >> BUCKET_BITS)
    dealt = texts.mapInArrow(_dealt(buckets, *frequent_shingles(texts)), _DEALT)
    met = written(dealt.repartition("bucket").sortWithinPartitions(F.col("kind").cast("long") * (1 << 32) + F.col("bucket")).mapInArrow(_meeting, _MET), "met-shingles")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5")).alias("first")
    firsts = written(met.filter("kind = 0").groupBy("node").agg(first, F.max("n").alias("n"), F.max("sketch").alias("sketch")).select("node", "n", "sketch", "first.*"), "node-firsts")
    shared = written(met.filter("kind = 1").select("h", "node", "at").distinct().join(firsts.select("node", "n"), "node"), "shared-shingles")
    chosen = firsts.join(shared.select("node").distinct(), "node").select("doc_id", "text_md5", "node", "n", "sketch")
    wanted = one_of_each(texts, {"doc_id": F.col("doc_id"), "text_md5": F.col("text_md5")}, chosen)
    wanted = written(wanted.select(*[F.col(f"__chosen_{c}").alias(c) for c in ("node", "n", "sketch")], "content"), "near-texts")
    discard(met)
    roots = near_components(shared, wanted, written(fingerprint_pairs(docs, firsts), "compared"))
    if roots is not None:
        firsts = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).groupBy("root").agg(first).select("first.*")
    return one_of_each(docs, {"doc_id": F.col("doc_id").cast("long"), "text_md5": F.unhex(F.md5(whole_text(docs)))}, firsts.select("doc_id", "text_md5"))
