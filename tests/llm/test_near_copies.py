"""Near copies of the pipeline: against a plain comparison of all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from test_llm_operators import SCHEMA, awkward

import corpus_pipeline
from routewatch.llm import near_copies
from routewatch.llm.shared import table


def plain_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(texts):
    """A root for each text, linked over similarities of 0.8 or more, from all pairs whose sizes allow it."""
    sets = [plain_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order, similar = sorted(range(len(sets)), key=lambda i: len(sets[i])), 0
    for a, i in enumerate(order):
        for j in order[a + 1:]:
            if 4 * len(sets[j]) > 5 * len(sets[i]):
                break
            shared = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                similar += sets[i] != sets[j]
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))], similar


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.randrange(10_000)}"
    return " ".join(words)


def with_near_copies():
    """Awkward rows, chains of edits, one large group on both sides of 0.8, and texts that share most of a frequent passage."""
    r = random.Random(11)
    new = lambda n: [f"w{r.randrange(10_000)}" for _ in range(n)]
    rows = awkward()
    large, passage = new(150), new(60)
    texts = [edited(r, large, r.randint(0, 4)) for _ in range(120)]
    texts += [" ".join(passage + new(r.randint(8, 30))) for _ in range(60)]
    for _ in range(25):
        chain = new(r.randint(5, 200))
        for _ in range(4):
            texts.append(" ".join(chain))
            chain = edited(r, chain, r.randint(0, 3)).split()
    return rows + [(1000 + i, t, "en", "src0", len(t), "clash", 1, 2, "clash", 3, "clash") for i, t in enumerate(r.sample(texts, len(texts)))]


def stays(rows, groups):
    return {g: min((row[0] for row, k in zip(rows, groups) if k == g and row[0] is not None), default=None) for g in set(groups)}


def test_one_per_group_is_that_of_all_pairs(spark):
    rows = with_near_copies()
    groups, similar = plain_groups([row[1] for row in rows])
    got = near_copies.one_per_group(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == spark.createDataFrame([], SCHEMA).columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(stays(rows, groups).values()) and similar > 500
    assert near_copies.one_per_group(spark.createDataFrame([], SCHEMA)).count() == 0


def test_prefixes_of_near_copies_meet_whatever_is_frequent():
    r = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(r.integers(0, 1 << 63, r.integers(1, 80)).astype(np.uint64))
        b = np.unique(np.concatenate((a[r.random(len(a)) < 0.95], r.integers(0, 1 << 63, r.integers(0, 4)).astype(np.uint64))))
        frequent = a[r.random(len(a)) < r.random()]
        rank = r.permutation(len(frequent))
        shared = len(np.intersect1d(a, b))
        if 5 * shared >= 4 * (len(a) + len(b) - shared):
            assert len(np.intersect1d(near_copies.prefix(a, frequent, rank), near_copies.prefix(b, frequent, rank)))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_stage_leaves_no_near_copies(spark, sf):
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    rows = [tuple(r) for r in docs.collect()]
    groups, _ = plain_groups([row[1] for row in rows])
    kept = corpus_pipeline.one_of_each_group(spark, docs, f"/root/testdata/{sf}")
    assert Counter(r.doc_id for r in kept.collect()) == Counter(stays(rows, groups).values())
