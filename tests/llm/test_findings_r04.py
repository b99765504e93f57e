"""the pipeline's near-dedup gets its first pairs from op10's groups, checks them, and finds what they lack."""

import random

from test_near_copies import plain_set, stays

import corpus_pipeline
from routewatch.llm import near_copies, simhash_dedup


def bits_apart(a, b):
    return ((simhash_dedup.fingerprint_of(a) ^ simhash_dedup.fingerprint_of(b)) & (1 << 64) - 1).bit_count()


def similar(a, b):
    a, b = plain_set(a), plain_set(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def test_near_dedup_goes_by_way_of_op10(spark, monkeypatch):
    r = random.Random(4)
    new = lambda n: [f"w{r.randrange(10_000)}" for _ in range(n)]

    def copies(n, edits, is_wanted):
        while True:
            a = new(n)
            b = list(a)
            for at in r.sample(range(n), edits):
                b[at] = "edited"
            if is_wanted(" ".join(a), " ".join(b)):
                return " ".join(a), " ".join(b)

    close = copies(400, 1, lambda a, b: similar(a, b) and bits_apart(a, b) <= 3)
    far = copies(200, 3, lambda a, b: similar(a, b) and bits_apart(a, b) > 3)
    unlike = ("la la la", "la la la la la")  # the same shingles of three words, others of five
    assert bits_apart(*unlike) <= 3 and not similar(*unlike)
    texts = [*close, *far, *unlike, close[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)

    grouped, first = [], []
    groups, linked = simhash_dedup.near_groups, near_copies.near_components
    monkeypatch.setattr(near_copies, "near_groups", lambda rows: grouped.append(rows.count()) or groups(rows))
    monkeypatch.setattr(near_copies, "near_components", lambda shared, wanted, pairs: first.extend(pairs.collect()) or linked(shared, wanted, pairs))
    kept = corpus_pipeline.one_of_each_group(spark, docs, None)
    node = {t: near_copies.node_of(near_copies.shingle_set(t)) for t in texts}
    assert {row.doc_id for row in kept.collect()} == set(stays(list(enumerate(texts)), [0, 0, 2, 2, 4, 5, 0]).values()) == {0, 2, 4, 5}
    assert grouped == [len(texts)]  # every row, repeated texts too
    assert sorted((p.lead, p.node) for p in first) == sorted(tuple(sorted(node[t] for t in pair)) for pair in (close, unlike))
