"""Top-k search, conversation repair and phrase mining: against plain versions of their definitions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from routewatch.llm import conversation_repair as cr
from routewatch.llm import phrase_mining, queries, topk_search
from routewatch.llm.shared import table

SF = "/root/testdata/sf0.001"


# -- conversation repair

def least_edits(codes):
    """Cost and audit by a plain table over all nodes, whole audits compared."""
    after = {cr.START: cr.USER, cr.SYSTEM: cr.USER, cr.USER: cr.ASSISTANT, cr.ASSISTANT: cr.USER}
    layer = {cr.START: (0, "")}
    for at in range(len(codes) + 1):
        for _ in range(4):  # inserts
            for q, (cost, audit) in list(layer.items()):
                new = (cost + 5, audit + "I")
                layer[after[q]] = min(layer.get(after[q], new), new)
        if at == len(codes):
            return min(layer[q] for q in (cr.START, cr.ASSISTANT) if q in layer)
        fault, letter = divmod(codes[at], 4)
        following = {}

        def put(q, cost, audit):
            following[q] = min(following.get(q, (cost, audit)), (cost, audit))

        for q, (cost, audit) in layer.items():
            put(q, cost + 2, audit + "D")
            if fault not in (cr.BLANK, cr.DUPLICATE):
                more = 5 if fault == cr.CUT else 0
                put(after[q], cost + 1 + more, audit + "R")
                if letter == 0 and q == cr.START:
                    put(cr.SYSTEM, cost + more, audit + "K")
                if (letter, after[q]) in ((1, cr.USER), (2, cr.ASSISTANT)):
                    put(after[q], cost + more, audit + "K")
        layer = following


@pytest.mark.parametrize("length", [0, 1, 2, 3, 5, 9, 30])
def test_both_searches_find_the_least_audit(length):
    r = random.Random(length)
    for _ in range(150):
        codes = bytes(4 * r.choice([0, 0, 0, 1, 2, 3]) + r.choice([0, 1, 1, 2, 2, 3]) for _ in range(length))
        assert cr.cheapest(codes) == least_edits(codes)


def test_segments_make_one_audit(monkeypatch):
    monkeypatch.setattr(cr, "SEGMENT", 7)
    r = random.Random(4)
    for length in (6, 7, 8, 14, 40, 75):
        for _ in range(25):
            codes = bytes(4 * r.choice([0, 0, 0, 1, 2, 3]) + r.choice([0, 1, 1, 2, 2, 3]) for _ in range(length))
            found = cr.Audits()
            for code in codes:
                found.add(code)
            assert found.result() == least_edits(codes)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        written = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(written.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [] if kind == 0 else [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows, conversations):
    out = {}
    for conv in set(conversations):
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        seen, codes, faults = set(), [], Counter()
        for _, _, role, text in turns:
            body = text.rstrip(" \t\n\v\f\r")
            fault = 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0
            seen.add((role, text))
            faults[fault] += 1
            codes.append(4 * fault + (cr.LETTERS.find(role[:1]) if role[:1] in ("s", "u", "a") else 3))
        known = [r[1] for r in turns if r[1] is not None]
        cost, audit = least_edits(codes)
        left, lines, state = iter(turns), [], ""
        for edit in audit:
            due = "user" if state in ("", "s", "a") else "assistant"
            role, text = (due, "") if edit == "I" else next(left)[2:]
            if edit == "D":
                continue
            role = due if edit == "R" else role
            lines.append(f"{role}:{text}")
            state = role[0]
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, faults[1], faults[2], faults[3], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONTRACT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_conversations_of_the_tables(spark, sf):
    rows = [tuple(r) for r in table(spark, f"/root/testdata/{sf}", "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_conversation_repair(spark, f"/root/testdata/{sf}")
    assert got.columns == CONTRACT
    found = {r[0]: tuple(r)[1:] for r in got.collect()}
    assert found == plain_repair(plain_damage(rows), [r[0] for r in rows])
    assert sum("R" in r[6] or "I" in r[6] for r in found.values()) > 3


def test_awkward_conversations(spark, monkeypatch):
    r = random.Random(8)
    texts = [None, "", " \t", "Yes.", "No", "Why? ", "line\nline!", "x" * 50_000 + ".", "é?\x0b"]
    rows = [(c, r.choice([None, t, t, t + 1]), r.choice(["user", "assistant", "system", None, "", "tool", "user"]), r.choice(texts))
            for c in (None, -1, 0, 1, 2, 3) for t in range(r.randint(1, 25))]
    rows += [(7, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(5000)]
    schema = "turn long, role string, text string, conv_id long, kind string, audit long, digest int, code string"
    turns = spark.createDataFrame([(t, role, text, c, "clash", 1, 2, "clash") for c, t, role, text in rows], schema).repartition(3)
    got = {x[0]: tuple(x)[1:] for x in cr.repair(cr.damaged(turns), turns).select(*CONTRACT).collect()}
    assert got == plain_repair(plain_damage(rows), [x[0] for x in rows])
    undamaged = {x[0]: tuple(x)[1:] for x in cr.repair(turns).select(*CONTRACT).collect()}
    assert undamaged == plain_repair([(c, t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows], [x[0] for x in rows])
    assert cr.repair(turns.limit(0)).count() == 0
    gone = cr.repair(turns.limit(0), turns.filter("conv_id = 1")).collect()
    assert [tuple(x) for x in gone] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# -- top-k search

def plain_top(rows, wanted, k):
    """Whole numbers of any size; ``wanted`` ids take the least of their vectors."""
    whole = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fine = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q in wanted:
        own = [math.floor(64 * float(x)) for x in min(v for i, v in fine if i == q)]
        score = lambda v: max(min(sum(a * b for a, b in zip(own, v)), (1 << 63) - 1), -1 << 63)
        scores = sorted((-score(v), i is None, i or 0) for i, v in whole if i != q)[:k]
        out[q] = [(rank, None if null else i, -s) for rank, (s, null, i) in enumerate(scores, 1)]
    return out


def as_lists(df):
    out = {}
    for row in sorted(df.collect(), key=lambda row: (row.query_id, row.rank)):
        out.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    return out


@pytest.mark.parametrize("bits,block", [(12, 128), (5, 4), (3, 8)])
def test_top_k_with_hot_and_awkward_vectors(spark, monkeypatch, bits, block):
    monkeypatch.setattr(topk_search, "RANGE_BITS", bits)
    monkeypatch.setattr(topk_search, "BLOCK", block)
    r = random.Random(bits)
    hot = [r.gauss(0, 1) for _ in range(6)]
    centre = [[r.gauss(0, 3) for _ in range(6)] for _ in range(5)]
    rows = [(i, hot if i % 3 == 0 else [x + r.gauss(0, 0.1) for x in centre[i % 5]]) for i in range(400)]
    rows += [(500, None), (501, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (502, [math.nan] * 6), (503, [math.inf] * 6), (504, []), (505, [2.0]),
             (None, hot), (None, [9.0] * 6), (40, hot), (41, centre[1]), (41, centre[1])]
    schema = "vec_id long, embedding array<double>, v string, range int, kind int, score long"
    df = spark.createDataFrame([(i, v, "clash", 1, 2, 3) for i, v in rows], schema).repartition(5)
    vectors = topk_search.vectors(df)
    got = as_lists(topk_search.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 7))
    wanted = sorted({i for i, v in rows if i is not None and i % 20 == 0 and v is not None})
    assert got == plain_top(rows, [i for i in wanted if i != 500], 7)
    empty = topk_search.vectors(df.limit(0))
    assert topk_search.top_k(empty, empty, 7).count() == 0
    assert topk_search.top_k(empty, vectors.filter("vec_id = 20"), 7).count() == 0


def test_large_components_are_exact(spark):
    r = random.Random(2)
    for scale in (1e3, 1e7, 1e9):
        rows = [(i, [r.uniform(-scale, scale) for _ in range(8)]) for i in range(60)]
        vectors = topk_search.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert as_lists(topk_search.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 5)) == plain_top(rows, [0, 20, 40], 5)


def test_bounds_spare_blocks():
    """Blocks whose bounds are below the k-th score are not scored, and nothing is lost."""
    import pyarrow as pa

    r = np.random.default_rng(1)
    centres = r.normal(0, 40, (16, 8))
    matrix = np.floor(np.repeat(centres, 128, axis=0) + r.normal(0, 1, (2048, 8)))
    index = topk_search.Range(pa.array(range(2048)), matrix)
    bounds = np.maximum(matrix[:50], 0) @ index.high.T + np.minimum(matrix[:50], 0) @ index.low.T
    rows, places, scores = index.best(np.arange(50), matrix[:50], np.full(50, -np.inf), 20)
    for q in range(50):
        all_scores = matrix @ matrix[q]
        order = [i for i in np.lexsort((np.arange(2048), -all_scores)) if i != q][:20]
        assert list(places[rows == q]) == order and list(scores[rows == q]) == list(all_scores[order].astype(int))
        assert (bounds[q] >= all_scores[order[-1]]).sum() < 16


# -- phrase mining

def plain_phrases(rows, longest, least, share, first):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if 2 <= len(p) and a >= least}
        covered = Counter()  # the most occurrences of a longer candidate around a phrase
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covered[p[i:i + k]] = max(covered[p[i:i + k]], a)
        kept = []
        for p, a in candidates.items():
            if 100 * covered[p] >= share * a:
                continue
            score, _, left, right = min((10 ** 6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("longest,least,share,first,chunk,bits", [(3, 10, 50, 2000, 8 << 20, 20), (3, 4, 50, 15, 900, 6), (5, 3, 80, 2000, 3000, 8), (2, 2, 50, 40, 200, 4)])
def test_phrases_of_awkward_texts(spark, monkeypatch, longest, least, share, first, chunk, bits):
    monkeypatch.setattr(phrase_mining, "CHUNK", chunk)
    monkeypatch.setattr(phrase_mining, "BUCKET_BITS", bits)
    r = random.Random(least)
    words = ["a", "the", "Ü", "é", "x1", "B", "c-d", "\x00", "'", "und", "zz", "日本"]
    phrase = "the quick Brown fox"
    texts = [" ".join(r.choice(words + [phrase, ".", ",\t", "\r\n", "!?", "  "]) for _ in range(r.randint(0, 80))) for _ in range(90)]
    texts += [None, "", "  ", ".", "....", "a " * 3000, "the quick brown fox\x0bjumps"] * 2
    rows = [(r.choice(["en", "de", None, "und", ""]), t) for t in texts]
    schema = "lang string, text string, doc_id long, chunk long, word string, kind string, gid long, salt int"
    df = spark.createDataFrame([(lang, t, 1, 2, "clash", "clash", 3, 4) for lang, t in rows], schema).repartition(4)
    got = phrase_mining.collocations(df, longest, least, share, first)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, longest, least, share, first)
    assert phrase_mining.collocations(df.limit(0), longest, least, share, first).count() == 0


def test_phrases_of_the_tables(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("lang", "text").collect()]
    assert sorted(map(tuple, queries.op13_phrase_mining(spark, SF).collect())) == plain_phrases(rows, 3, 10, 50, 2000)


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000
    row = [(1, "en", "a b", big, 2, 3, [big + 1, big], [big + 5, big])]
    got = phrase_mining._scored(spark.createDataFrame(row, "gid long, lang string, phrase string, f long, a long, b long, heads array<long>, tails array<long>"), 2).collect()
    assert [(r.l, r.r, r.score) for r in got] == [(big + 1, big + 5, 10 ** 6 * big * big // ((big + 1) * (big + 5)))]


# -- token counts

def test_long_texts_without_blanks_are_counted_in_line():
    """A megabyte without blanks: cut points against the library, without a table of all prefixes."""
    import public_tokenizers
    from routewatch.llm import token_counts

    counter = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(5)
    for alphabet in ("abcdefgh", "aé日", "a1b2.", "-"):
        text = "".join(r.choice(alphabet) for _ in range(1_000_000 // len(alphabet.encode())))
        deltas = counter.deltas(text)
        assert len(deltas) == len(text)
        counts = np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)
        for at in (1, 2, 50, 777, len(text) // 3, len(text)):
            assert counts[at - 1] == len(counter.library.encode(text[:at], add_special_tokens=False).ids)


def test_pairs_of_tokens_by_their_spines():
    """Whether two tokens stay apart: against the merges of their bytes."""
    import public_tokenizers
    from routewatch.llm import token_counts

    counter = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))

    def merged(data):
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [counter.ranks.get(p, token_counts.NONE) for p in zip(parts, parts[1:])]
            if min(ranks) == token_counts.NONE:
                break
            at = ranks.index(min(ranks))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    r = random.Random(6)
    words = sorted(counter.vocabulary)
    short = [w for w in words if len(w) <= 3]
    for _ in range(20_000):
        a, b = r.choice(r.choice((words, short))), r.choice(r.choice((words, short)))
        assert counter.follows(a, b) == (merged(a + b) == [a, b]), (a, b)
    for a in (b"a", b"aa", b"  ", b"\n\n", b"===="):
        for n in range(1, 9):
            assert counter.follows(a, a[:1] * n) == (merged(a + a[:1] * n) == [a, a[:1] * n])
            assert counter.follows(b"", a[:1] * n) == (merged(a[:1] * n) == [a[:1] * n])


# -- stages of the pipeline

def test_stages_take_clashing_columns_and_repeated_rows(spark):
    """Extra columns named like the stages' own, and rows of one doc_id and text under two languages: one stays, the least as JSON."""
    from routewatch.llm import mixing, near_copies

    schema = "doc_id long, text string, lang string, source string, n_chars long, times int, node long, root string, lead int, sketch string"
    rows = [(1, "one two three four five six", "fr", "web", 1, 7, 8, "x", 9, "y"), (1, "one two three four five six", "de", "web", 1, 7, 8, "x", 9, "y"),
            (2, "quite another text than that one", None, None, None, None, None, None, None, None), (None, None, "en", "web", 0, 1, 1, "", 1, "")]
    df = spark.createDataFrame(rows, schema).repartition(3)
    kept = near_copies.one_per_group(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.lang) for r in kept.collect()) == [(0, "en"), (1, "de"), (2, None)]
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    assert {(r.doc_id, r.lang, r.times) for r in mixed.collect()} <= {(r[0], r[2], r[5]) for r in rows}
