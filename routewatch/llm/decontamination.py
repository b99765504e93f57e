"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A window of a text has as many words as a benchmark item (a shorter text is one window). Window and
item are compared by the multisets of their shingles of five words: similarity is the sum of smaller
counts over the sum of larger ones. Windows are fingerprinted by SimHash, found by an index of eight
blocks of eight bits, and verified exactly. Two fingerprints within 20 bits have a block within two
bits, so the index loses none of them.

Similarity s of a window with a shingles and an item with b takes s (a + b) / (1 + s) shared ones. Windows
that hold fewer shingles of any item cannot reach it and are not fingerprinted. Every text is hashed
whole for that, in numpy, without a Python step per word.
"""

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import whole_text

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 20, 8
#: Bytes of benchmark text that one pass over the documents takes; a larger benchmark takes several passes.
PASS_BYTES = 16 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: An odd factor and its inverse modulo 2^64: a word's hash is a difference of running sums, shifted back.
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_NEAR = _ONES[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= RADIUS // BLOCKS


_POWERS: dict[int, np.ndarray] = {}


def _powers(factor, n):
    """The first n powers; kept per Python worker, as long as its longest text."""
    known = _POWERS.get(int(factor))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), factor, np.uint64)
        known[0] = 1
        known = _POWERS[int(factor)] = np.multiply.accumulate(known)
    return known[:n]


def _mixed(x):
    """A finaliser that spreads every bit."""
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word. Words are lower-cased runs of ASCII letters and digits and of other letters' bytes."""
    return run_hashes(text.lower().encode("utf-8", "surrogatepass"), _WORD)


def run_hashes(text: bytes, is_word: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes for which ``is_word`` holds."""
    data = np.frombuffer(text, np.uint8)
    inside = np.concatenate(([False], is_word[data], [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_FACTOR, len(data)))))
    return _mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, size=SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of fewer words, the whole sequence."""
    size = min(size, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i, power in enumerate(_powers(_FACTOR, size)):
        out += words[i:i + len(out)] * power
    return _mixed(out)


def simhash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints (8 bytes each) of ranges of shingles, from running counts of their bits."""
    ones = running[ends] - running[starts]
    return np.packbits(2 * ones > (ends - starts)[:, None], axis=1, bitorder="little")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """Running counts of the 64 bits, one row more than hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.concatenate((np.zeros((1, 64), np.int64), np.cumsum(bits, axis=0, dtype=np.int64)))


def weighted_similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


@dataclass
class Sized:
    """The items of one size, with their index: near[block, byte, item] is whether the item's block is within reach of the byte."""

    items: list[int]
    counts: list[Counter]
    prints: np.ndarray
    near: np.ndarray


class ItemIndex:
    """The windows of texts that match items. Built from a bounded block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        sizes: dict[int, list] = {}
        seen: dict[int, list] = {}
        for item_id, text in items:
            words = word_hashes(text)
            if len(words):
                own = shingles(words)
                sizes.setdefault(len(words), []).append((item_id, own))
                seen.setdefault(min(SHINGLE, len(words)), []).append(own)
        self.sizes = {}
        for size, found in sorted(sizes.items()):
            prints = np.concatenate([simhash(bit_counts(h), np.array([0]), np.array([len(h)])) for _, h in found])
            self.sizes[size] = Sized([i for i, _ in found], [Counter(h.tolist()) for _, h in found], prints, _NEAR[:, prints].transpose(2, 0, 1))
        self.known = {k: np.unique(np.concatenate(v)) for k, v in seen.items()}
        self.bits = 22
        self.screen = {}
        for k, known in self.known.items():
            self.screen[k] = np.zeros(1 << self.bits, bool)
            self.screen[k][known >> np.uint64(64 - self.bits)] = True

    def _hits(self, hashes, size):
        """Places of shingles that some item has."""
        maybe = np.flatnonzero(self.screen[size][hashes >> np.uint64(64 - self.bits)])
        known = self.known[size]
        at = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
        return maybe[known[at] == hashes[maybe]]

    def matches(self, text: str) -> list[tuple[int, int, int, float]]:
        """(item_id, first word, words, similarity) of the best window of each matching item: the most similar, then the first."""
        words = word_hashes(text)
        best: dict[int, tuple] = {}
        if not len(words):
            return []
        for k in self.known:
            if k > len(words) and k < SHINGLE:
                continue
            hashes = shingles(words, k)
            if k == SHINGLE and len(words) < SHINGLE:
                continue  # a whole text of fewer words is no shingle of such an item
            hits = self._hits(hashes, k)
            if len(hits):
                self._windows(hashes, hits, k, len(words), best)
        return [(item, start, size, similarity) for item, (similarity, start, size) in best.items()]

    def _windows(self, hashes, hits, k, n_words, best):
        held = np.zeros(len(hashes) + 1, np.int64)
        held[hits + 1] = 1
        held = np.cumsum(held)
        for size, group in self.sizes.items():
            if min(SHINGLE, size) != k:
                continue
            own = size - k + 1
            many = min(own, len(hashes))
            starts = np.flatnonzero(held[many:] - held[:len(held) - many] >= SIMILARITY * (own + many) / (1 + SIMILARITY) - 1e-9)
            for at in range(0, len(starts), 1024):
                some = starts[at:at + 1024]
                # bits are counted in the stretches that the windows cover
                joined = np.flatnonzero(np.diff(some, prepend=some[0] - many - 1) > many)
                for first, last in zip(joined, [*joined[1:], len(some)]):
                    self._found(hashes, some[first:last], many, min(size, n_words), group, best)

    def _found(self, hashes, starts, many, n_words, group, best):
        low = int(starts[0])
        prints = simhash(bit_counts(hashes[low:int(starts[-1]) + many]), starts - low, starts - low + many)
        near = np.zeros((len(starts), len(group.items)), bool)
        for block in range(BLOCKS):
            near |= group.near[block][prints[:, block]]
        window, item = np.nonzero(near)
        close = _ONES[prints[window] ^ group.prints[item]].sum(axis=1) <= RADIUS
        for start, i in zip(starts[window[close]].tolist(), item[close].tolist()):
            similarity = weighted_similarity(Counter(hashes[start:start + many].tolist()), group.counts[i])
            so_far = best.get(group.items[i])
            if similarity >= SIMILARITY and (so_far is None or (-similarity, start) < (-so_far[0], so_far[1])):
                best[group.items[i]] = (similarity, start, n_words)


def indexes(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The items (item_id, text) in blocks of about ``PASS_BYTES``; null texts are left out, equal rows counted once."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("content")).dropna(subset=["content"]).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
    blocks = int(total // PASS_BYTES) + 1
    numbered = items.withColumn("block", F.pmod(F.xxhash64("content"), F.lit(blocks)))
    return [[tuple(r) for r in numbered.filter(F.col("block") == b).select("item_id", "content").orderBy("item_id", "content").collect()] for b in range(blocks)]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row and benchmark item that it holds: doc_id, item_id, start_word, n_words, similarity.

    The window is the item's best one in the text. Null and empty texts hold nothing, nor does any
    text hold an item without words. Items under five words match where their whole word sequence
    occurs. Repeated documents are each reported; rows repeated with one item_id are one item whose
    best match counts. If either table is empty there are no rows. Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("content"))
    schema = "doc_id long, item_id long, start_word long, n_words long, similarity double"
    parts = [texts.mapInArrow(_finder(block), schema) for block in indexes(benchmark)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _finder(block):
    def batches(parts):
        index = ItemIndex(block)
        for part in parts:
            rows = [(doc_id, *match) for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("content"))
                    for match in index.matches(text.as_py())]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([
                *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.float64())],
                ["doc_id", "item_id", "start_word", "n_words", "similarity"])

    return batches


def clean(docs: DataFrame, benchmark: DataFrame, text="text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item."""
    place = docs.columns.index(text)
    for block in indexes(benchmark):
        docs = docs.mapInArrow(_cleaner(block, place), docs.schema)
    return docs


def _cleaner(block, place):
    def batches(parts):
        index = ItemIndex(block)
        for part in parts:
            yield part.filter(pa.array([not (t.is_valid and index.matches(t.as_py())) for t in part.column(place)], pa.bool_()))

    return batches
