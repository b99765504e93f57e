"""From raw documents to token records: reject, deduplicate, decontaminate, mix, write.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written as
Parquet before the next one reads it. All but the last return the columns of ``documents``.
"""

import public_tokenizers

from routewatch.llm import decontamination, mixing, near_copies, quality, token_records
from routewatch.llm.shared import shared_folder, table

VOCABULARY = "word_bpe_49k.json"


def accept(spark, docs, sf_dir):
    """Documents that the quality model, learned from these documents' labels, does not reject."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark, docs, sf_dir):
    """One document of each group linked over a similarity of 0.8 of five-word shingles: op10's groups, checked, and what they lack."""
    return near_copies.one_per_group(docs)


def without_benchmark(spark, docs, sf_dir):
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark, docs, sf_dir):
    """Documents as often as the target weights take them."""
    return mixing.mixed(docs)


def records(spark, docs, sf_dir):
    """Token records, written and read back."""
    return token_records.read_records(token_records.write_records(docs, public_tokenizers.path(VOCABULARY)))


STAGES = [("quality classifier", accept), ("near-dedup", one_of_each_group), ("benchmark decontamination", without_benchmark),
          ("mixing to target weights", mixed), ("token-ID output", records)]


def run(spark, sf_dir):
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            path = shared_folder(spark, f"pipeline-{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


#: SQL has no boosted trees, fingerprints or tokenizers; the stages are tested against plain versions.
ORACLE_SQL = None
