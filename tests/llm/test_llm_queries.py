"""The registered queries on the driver's tables: against their SQL, their contracts by plain Python, and the pipeline by stages."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from routewatch.llm import queries
from routewatch.llm.shared import table

SF = "/root/testdata/sf0.001"


def of_duckdb(sql):
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    found = con.sql(sql)
    return list(found.columns), found.fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    columns, want = of_duckdb(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_a_row_per_document(spark, name):
    """Queries that report on every row of their table do so, with the contract's columns first."""
    first = {"op2": ["doc_id", "start", "n_tokens", "ids_crc32"], "op3": ["doc_id", "held_out", "score", "predicted"],
             "op5": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], "op7": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
             "op8": ["doc_id", "n_bytes", "n_tokens", "over_limit"], "op10": ["doc_id", "fingerprint", "component_id"]}
    columns = first.get(name.split("_")[0])
    if columns:
        got = queries.QUERIES[name](spark, SF)
        assert got.columns[:len(columns)] == columns
        source, key = ("pages", "page_id") if name.startswith("op7") else ("documents", "doc_id")
        assert Counter(r[0] for r in got.select(key).collect()) == Counter(r[0] for r in table(spark, SF, source).select(key).collect())


def test_held_out_quality(spark):
    scored = {r.doc_id: r for r in queries.op3_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = [r for r in table(spark, "/root/testdata/sf0.01", "labels").collect() if scored[r.doc_id].held_out]
    assert np.mean([scored[r.doc_id].predicted == r.quality for r in labels]) > 0.95


def test_warc_contract(spark):
    pages = table(spark, SF, "pages").collect()
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        first.setdefault(p.html or "", p.page_id)
    want = {p.page_id: (len((p.html or "").encode()), base64.b32encode(hashlib.sha1((p.html or "").encode()).digest()).decode(), first[p.html or ""]) for p in pages}
    for r in queries.op7_warc(spark, SF).collect():
        size, digest, origin = want[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (size, digest)
        assert (r.record_type, r.refers_to) == (("response", None) if origin == r.page_id else ("revisit", origin))


def test_pipeline_by_stages(spark, tmp_path):
    """Each stage on what the one before kept, against plain versions where there are such."""
    from test_llm_operators import plain_matches
    from test_near_copies import plain_groups, stays

    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(f"{tmp_path}/{number}")
        kept.append(spark.read.parquet(f"{tmp_path}/{number}"))
        if number < 4:
            assert kept[-1].columns == columns
    rows = [[tuple(r) for r in k.collect()] for k in kept]
    quality = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert {r[0] for r in rows[0]} - {r[0] for r in rows[1]} >= {d for d, q in quality.items() if q == 0 and zlib.crc32(str(d).encode()) % 3 != 1}
    clean = {d for d, q in quality.items() if q == 1}  # the held-out ones are judged by a model of some 60 labels here
    assert len(clean & {r[0] for r in rows[1]}) > 0.95 * len(clean)
    groups, _ = plain_groups([r[1] for r in rows[1]])
    assert Counter(r[0] for r in rows[2]) == Counter(stays(rows[1], groups).values())
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    hit = {k[0] for k in plain_matches(rows[2], items)}
    assert Counter(r[0] for r in rows[3]) == Counter({r[0] for r in rows[2]} - hit)
    taken = Counter(r.doc_id for r in corpus_pipeline.mixing.mix(kept[3]).collect())
    assert Counter(r[0] for r in rows[4]) == taken
    library = corpus_pipeline.token_records.encoder(public_tokenizers.path("word_bpe_49k.json")).library
    ids = lambda t: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
    assert Counter((r[0], r[3]) for r in rows[5]) == Counter((r[0], zlib.crc32(ids(r[1]))) for r in rows[4])
    assert corpus_pipeline.run(spark, SF).count() == len(rows[5])


def test_the_names_of_sources_match_no_other(spark):
    assert all(re.fullmatch(r"op\d+_\w+", name) for name in queries.QUERIES) and len(queries.QUERIES) == 13
