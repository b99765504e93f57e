"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair encodings.

A byte-pair encoding has two properties that make counts of prefixes cheap: without its last token it
is the encoding of a prefix, and a row of tokens is an encoding if each neighbouring pair is one. So
for every prefix exactly one token can be its last, and count[i] = count[i - len(last)] + 1. Counts
are stored as one signed byte per character (the change from the prefix before); their running sum
answers where to cut a text for a budget without encoding again.

Texts are cut where white space follows other characters. No token crosses such a place and no
rule of the vocabulary looks back over it, so the counts of the pieces add up.
"""

import json
import os
import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .byte_letters import BYTES
from .recent import Recent
from .shared import whole_text

#: Short pieces, answers about neighbours, and runs, kept per Python worker; those that drop out are made again.
KEPT_PIECES, KEPT_AFTER, KEPT = 400_000, 2_000_000, 20_000
#: Bytes up to which a run counts as short, texts taken together, and characters of prefixes given to the library at once.
SHORT, TEXTS, PREFIX_CHARS = 64, 1000, 4 << 20
#: White space before, then other characters; or white space at the end of the text.
PLAIN = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile(r"[^\S \n]")
ANY = regex.compile(r"\p{White_Space}*\P{White_Space}+|\p{White_Space}+")
SPLIT = regex.compile(r"(\p{White_Space}*)(\P{White_Space}*)")
#: Fixed value: the pre-tokeniser's pattern of the vocabulary, with white space by its Unicode property.
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Latin letters with one blank before them at most, and marks behind them: two pre-tokens, no special string.
SIMPLE = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*#&%$]*)")
CONTRACTION = re.compile(r"'(?:s|t|re|ve|m|ll|d)")


def _changes(counts: list[int]) -> bytes:
    """Counts as signed bytes, each the change from the one before; a token has fewer than 129 bytes, so they fit."""
    return bytes([b - a & 255 for a, b in zip([0, *counts], counts)])


def _total(changes: bytes) -> int:
    return sum(changes) - 256 * sum(b > 127 for b in changes)


#: The rank of a pair that is not merged.
NONE = 1 << 60


class After(dict):
    """Whether a byte string is the token next to ``token`` in the encoding of both, for strings asked for before."""

    def __init__(self, token: bytes, counter):
        self.token, self.counter = token, counter

    def __missing__(self, text):
        self.counter.asked += 1
        found = self[text] = text in self.counter.vocabulary and self.counter.follows(self.token, text)
        return found


class Afters(dict):
    """``After`` by token; that of the empty string holds for first tokens."""

    def __init__(self, counter):
        self.counter = counter

    def __missing__(self, token):
        found = self[token] = After(token, self.counter)
        return found


class PrefixCounter:
    """Counts for one byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        as_bytes = lambda word: bytes(BYTES[c] for c in word)
        self.vocabulary = {as_bytes(w) for w in spec["model"]["vocab"]}
        self.longest = max(map(len, self.vocabulary))
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[as_bytes(a), as_bytes(b)] = rank
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.pieces, self.runs = {}, Recent(KEPT, self._run_deltas)
        self.spines, self.automaton, self.afters, self.asked = {}, None, Afters(self), 0

    def _spines(self, token: bytes):
        """The parts of a token that lie at its left and at its right end while it is merged, from the token down, each with
        the rank of the merge that takes it up; None for a token that its own bytes do not give."""
        found = self.spines.get(token, 0)
        if found == 0:
            parts, left, right = [token[i:i + 1] for i in range(len(token))], [], []
            while len(parts) > 1:
                ranks = [self.ranks.get(p, NONE) for p in zip(parts, parts[1:])]
                first = min(ranks)
                if first == NONE:
                    break
                at = ranks.index(first)
                if at == 0:
                    left.append((parts[0], first))
                if at == len(parts) - 2:
                    right.append((parts[-1], first))
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            found = ([(token, NONE), *left[::-1]], [(token, NONE), *right[::-1]]) if len(parts) == 1 else None
            self.spines[token] = found
        return found

    def follows(self, first: bytes, second: bytes) -> bool:
        """Whether the bytes of two neighbouring tokens are encoded as these two.

        They are unless a merge over the border comes before those that take up its parts; of merges of
        equal rank the one to the left comes first.
        """
        before, after = first and self._spines(first), self._spines(second)
        if not before or not after:
            return not first and after is not None
        rank_of = self.ranks.get
        for x, until_x in before[1]:
            for y, until_y in after[0]:
                rank = rank_of((x, y))
                if rank is not None and rank < until_x and rank <= until_y:
                    return False
        return True

    def byte_counts(self, data: bytes) -> list[int]:
        """Tokens of every byte prefix of one pre-token, from the empty one on."""
        if len(data) <= SHORT:
            return [0, *accumulate(c - 256 if c > 127 else c for _, c in zip(data, self._short([data])[data]))]
        counts, last = [0], [self.afters[b""]]
        if self.automaton is None:  # of the vocabulary: gives the tokens that end at each place, and no others
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for token in self.vocabulary:
                self.automaton.add_word(token.decode("latin-1"), token)
            self.automaton.make_automaton()
        for end, token in self.automaton.iter(data.decode("latin-1")):
            if len(counts) == end + 1:  # not found yet
                start = end + 1 - len(token)
                if last[start][token]:
                    counts.append(counts[start] + 1)
                    last.append(self.afters[token])
        return counts

    def _run(self, run: str) -> list[int]:
        """Tokens of every character prefix of one pre-token, without the empty one."""
        counts = self.byte_counts(run.encode("utf-8"))
        return counts[1:] if run.isascii() else [counts[at] for at in accumulate(len(c.encode("utf-8")) for c in run)]

    def _run_deltas(self, run: str) -> bytes:
        return _changes(self._run(run))

    def _short(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """Changes from byte to byte of short runs, given in order: each takes over what it shares with the one before."""
        afters = self.afters
        out, counts, last, changes, before = {}, [0], [afters[b""]], bytearray(), b""
        for data in runs:
            shared = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                shared += 1
            del counts[shared + 1:], last[shared + 1:], changes[shared:]
            for end in range(shared + 1, len(data) + 1):
                for start in range(end - 1, -1, -1):  # most last tokens are short
                    token = data[start:end]
                    if last[start][token]:
                        break
                count = counts[start] + 1
                changes.append(count - counts[-1] & 255)
                counts.append(count)
                last.append(afters[token])
            before = data
            out[data] = bytes(changes)
        return out

    def _learn(self, pieces: set[str]):
        """Changes of the pieces that are words with marks: their short words are counted together."""
        simple = [(piece, *found.groups()) for piece in pieces if (found := SIMPLE.fullmatch(piece))]
        words = {word: word.encode("utf-8") for _, word, _ in simple}
        known = self._short(sorted(words.values()))
        changes = {}
        for word, data in words.items():
            found = known[data]
            if len(data) != len(word):  # from character to character
                per = []
                for change, byte in zip(found, data):
                    if byte & 192 == 128:
                        per[-1] = per[-1] + change & 255
                    else:
                        per.append(change)
                found = bytes(per)
            changes[word] = found
        for piece, word, marks in simple:
            self.pieces[piece] = changes[word] + self.runs[marks] if marks else changes[word]
        others = [p for p in pieces if p not in self.pieces]
        for piece, whole in zip(others, self._library_counts(others)):
            self.pieces[piece] = self._checked(piece, whole)

    def _checked(self, piece: str, whole: int) -> bytes:
        """The changes of ``counts`` from prefix to prefix; ``whole``, the library's count of the piece, holds."""
        changes = _changes(self.counts(piece))
        if _total(changes) != whole:
            counts, step = [], max(1, PREFIX_CHARS // len(piece))
            for at in range(0, len(piece), step):  # so many prefixes at a time
                counts += self._library_counts([piece[:i + 1] for i in range(at, min(at + step, len(piece)))])
            changes = _changes(counts)
        return changes

    def _library_counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ordinary(self, text: str) -> list[int]:
        """Tokens of every character prefix of a text without special tokens."""
        out, total = [], 0
        for block in SPLIT.finditer(text):
            space, word = block.groups()
            if space:
                out += [total + n for n in self._run(space)]  # a prefix that ends here has one run of white space
            if not word:
                total = out[-1] if out else 0
                continue
            lead = space[-1:] if space[-1:] == " " else ""  # one blank goes with the word
            for part in (space[:-1], "" if lead else space[-1:]):
                total += self._run(part)[-1] if part else 0
            for token in PRETOKEN.findall(lead + word):
                counts = self._run(token)
                if CONTRACTION.fullmatch(token):  # cut short, its letters are a word of their own
                    counts[:-1] = [1 + n for n in [0, *self._run(token[1:])]][:len(token) - 1]
                out += [total + n for n in counts[len(lead):]]
                total, lead = total + counts[-1], ""
        return out

    def counts(self, text: str) -> list[int]:
        """Tokens of every character prefix, without the empty one."""
        out, base, start = [], 0, 0
        for found in self.special.finditer(text) if self.special else ():
            out += [base + n for n in self._ordinary(text[start:found.end() - 1])]
            base += (self._ordinary(text[start:found.start()]) or [0])[-1] + 1
            out.append(base)
            start = found.end()
        return out + [base + n for n in self._ordinary(text[start:])]

    def deltas(self, text: str) -> bytes:
        """One signed byte per character: by how much its prefix has more tokens than the one before."""
        return next(self.all_deltas([text]))

    def all_deltas(self, texts: list[str]):
        """``deltas`` of several texts, one after the other; the words that none of them had before are counted together."""
        cut = [PLAIN.findall(t) if not OTHER_SPACE.search(t) else ANY.findall(t) for t in texts]
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.clear()
        if self.asked > KEPT_AFTER:
            self.afters.clear()
            self.asked = 0
        known = self.pieces
        self._learn({p for pieces in cut for p in pieces if p not in known and len(p) <= SHORT // 2})
        for pieces in cut:
            yield b"".join([known.get(p) or self._checked(p, self._library_counts([p])[0]) for p in pieces])


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One per Python worker and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def longest_prefix(deltas: bytes, limit: int) -> int:
    """Characters of the longest prefix with at most ``limit`` tokens, from stored counts alone."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64) <= limit)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, deltas (the counts of all prefixes).

    ``vocabulary`` is the path of a byte-level vocabulary file that every executor can read. Null
    texts are empty, with no tokens. Special strings in texts become special tokens, as the library
    does by default. Repeated rows are all returned, an empty table gives no rows, and other columns
    are not read.
    """
    def batches(parts):
        count = counter(vocabulary)
        for part in parts:
            for at in range(0, part.num_rows, TEXTS):
                rows = part.slice(at, TEXTS)
                texts = rows.column("content").to_pylist()
                found = list(count.all_deltas(texts))
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id"), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                    pa.array([int(np.frombuffer(d, np.int8).sum(dtype=np.int64)) for d in found], pa.int64()),
                    pa.array(found, pa.binary())], ["doc_id", "n_bytes", "n_tokens", "deltas"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("content"))
    return source.mapInArrow(batches, "doc_id long, n_bytes long, n_tokens long, deltas binary")


def cut_points(counted: DataFrame, limit: int) -> DataFrame:
    """doc_id and n_chars of the longest prefix within ``limit`` tokens, from ``prefix_counts`` without encoding."""
    def batches(parts):
        for part in parts:
            chars = [longest_prefix(d, limit) for d in part.column("deltas").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(chars, pa.int64())], ["doc_id", "n_chars"])

    return counted.select("doc_id", "deltas").mapInArrow(batches, "doc_id long, n_chars long")
