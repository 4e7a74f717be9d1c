"""The corpus pipeline: each stage takes the documents that the one before it kept.

Every stage but the last returns the columns of the table it is given, whatever
they are called; the last returns ``doc_id``, ``source``, ``ids`` and ``exact``.

Defined cases.  Null texts: not toxic, one group with empty texts in the
deduplication (fingerprint zero), no secrets, size 0, which the mix doesn't take.
Empty texts likewise.  Null ids: kept last among equals in a group; they hash as
"null" in the mix.  Null sources: an owner and a source of their own.  Very long
texts: worked on whole, in bounded memory.  Ties: of a group the smallest id
stays, of equal ids the first address.  Repeated rows: one stays.  Labels without a
document, null or contradictory: left out, or the larger counts.  An empty table,
or no labels: an empty result, or no document is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import mixing, secrets, sentencepieces, simhash, toxicity
from quarry.runtime import materialize, ship, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on the labels of ``docs``, rejects go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are replaced; every document stays."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document; ``exact`` tells that decoding gave the text back."""
    return sentencepieces.with_round_trip(docs.select("doc_id", "source", "text"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("secrets", secret_scan),
    ("mixing", source_mix),
    ("sentencepiece", encode_pieces),
]

#: Classifiers, components and lattices have no SQL form; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each but the last is written and read again."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
