"""Cases of the findings of round 3."""

import tempfile

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from routewatch import catalog
from routewatch.llm import token_records
from routewatch.operators import scan
from routewatch.plans import incidents as IN
from routewatch.plans import summary as SU
from routewatch.session import cut
from routewatch.streaming import live


def test_active_classes_over_a_thousand(spark):
    """the registered query gives exact counts, the report rounded ones."""
    per_class = spark.createDataFrame([(9, 3858), (2, 17), (4, 0)], "classification int, prefix_count long")
    active = SU.active_classes(per_class)
    assert [tuple(r) for r in active.collect()] == [(9, 3858, "3.9k"), (2, 17, "17")]
    assert [tuple(r) for r in catalog.exact_text(active).collect()] == [(9, 3858, "3858"), (2, 17, "17")]


EVENTS = ("update_id long, ts long, prefix string, asn long, incident_id string, classification int, old_classification int, incident_start_time long, "
          "lat double, lon double, city string, country string, leak_detail struct<leak_type:int,leaker_asn:bigint,victim_asn:bigint>, "
          "anomaly_details struct<num_peers:bigint>")


def test_outage_check_comes_after_updates_of_its_second(spark, few_partitions):
    """in the second of an outage check the update is the transition, in batch and stream."""
    row = lambda i, ts, p, new, old: (i, ts, p, 7, "x", new, old, ts, 0.0, 0.0, None, None, None, None)
    rows = [row(None, 100, "1.0.0.0/8", 4, 0), row(5, 100, "1.0.0.0/8", 0, 4), row(3, 100, "2.0.0.0/8", 4, 0), row(None, 100, "3.0.0.0/8", 4, 0)]
    events = spark.createDataFrame(rows, EVENTS)
    want = [("1.0.0.0/8", 5, 0, 4), ("2.0.0.0/8", 3, 4, 0), ("3.0.0.0/8", None, 4, 0)]
    assert sorted(tuple(r) for r in IN.transitions(events).select("prefix", "update_id", "new_state", "old_state").collect()) == want
    root = tempfile.mkdtemp(prefix="routewatch-check-")
    events.coalesce(1).write.parquet(f"{root}/in/0")
    for i in (1, 2):  # a second is closed once the watermark has passed it
        spark.createDataFrame([row(99, 50_000, "end", 4, 0)], EVENTS).coalesce(1).write.parquet(f"{root}/in/{i}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{root}/in")
    q = live.start_transitions(stream, root, f"{root}/c", availableNow=True)
    q.awaitTermination(180)
    assert q.exception() is None
    got = spark.read.parquet(f"{root}/transitions").filter(F.col("prefix") != "end")
    assert sorted(tuple(r) for r in got.select("prefix", "update_id", "new_state", "old_state").collect()) == want


def test_words_in_any_case_and_with_marks_keep_their_ids():
    """op2: words of plain letters take a short way to the same ids, also after they dropped out."""
    words = ["Data", "data", "DATA,", "a1", "", "na\u00efve", "x" * 40, "don't", "end.", "\u4e2d"]
    encoder = token_records.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for memory in (encoder.words, encoder.letters, encoder.marks):
        memory.kept = 2
    for text in (*words, " ".join(words), " ".join(reversed(words))):
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_words_kept_for_writing_go_before_records_are_read():
    """pipeline: workers are used again, so an encoder left in one fills its memory through all later stages."""
    token_records.encoder(public_tokenizers.path("word_bpe_49k.json")).encode("some words")
    assert list(token_records._read_shards([])) == [] and not token_records._ENCODERS


def test_slices_of_a_hot_prefix_are_smaller_than_a_whole_one(spark, few_partitions):
    """80 rows of 20 minutes, hot over 64, are cut at 8 rows or two minutes, not into two pieces."""
    rows = spark.range(80).select(F.lit("p").alias("prefix"), (F.col("id") * 15).alias("ts"))
    assert [tuple(r) for r in scan.find_hot(rows, target_rows=64).collect()] == [("p", 120)]
    assert [tuple(r) for r in scan.find_hot(rows, target_rows=64, slice_rows=64).collect()] == [("p", 960)]


def test_generated_methods_stay_within_what_hotspot_compiles(spark):
    """a session without a limit of its own gets HotSpot's with the first table written out."""
    limit, before = "spark.sql.codegen.hugeMethodLimit", spark.conf.get("spark.sql.codegen.hugeMethodLimit", None)
    try:
        spark.conf.unset(limit)
        cut(spark.range(1))
        assert spark.conf.get(limit) == "8000"
        spark.conf.set(limit, "65535")
        cut(spark.range(1))
        assert spark.conf.get(limit) == "65535"
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)
