"""The inverted index as relations.

``tf(doc_id, term, tf, max_tf)`` needs one shuffle: the documents themselves
are dealt out by id before they are cut into terms, so that counting and the
maximum per document happen where the document is (run lengths of a sorted array
inside the row need no shuffle, but five times the time).  ``terms(term, df, idf,
min_doc)`` sums counts made on the map side.  ``postings`` joins both on the
term, which Spark splits where a term is in a large share of all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import DEFAULT, Profile
from quarry.operators import ranges

WEIGHTS = ("raw", "norm", "half")
WEIGHT_NAMES = {"raw": "raw frequency", "norm": "log normalization", "half": "double normalization 0.5"}


def occurrences(docs: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """``(doc_id, term)``, a row for each occurrence of an indexed term."""
    if profile.stem:  # filtered and stemmed inside the row
        return docs.select("doc_id", F.explode(profile.terms(F.col("text"))).alias("term"))
    tokens = docs.select("doc_id", F.explode(profile.array(F.col("text"))).alias("term"))
    kept = profile.keeps(F.col("term"))
    return tokens if kept is None else tokens.filter(kept)


def term_frequency(docs: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """``(doc_id, term, tf)``: indexed terms of each document and their counts."""
    return occurrences(docs, profile).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def with_max(tf: DataFrame) -> DataFrame:
    return tf.withColumn("max_tf", F.max("tf").over(Window.partitionBy("doc_id")))


def by_document(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Documents dealt out by id, texts and all: smaller than their terms."""
    return docs.repartition(partitions, "doc_id") if partitions else docs.repartition("doc_id")


def weights(tf: DataFrame) -> DataFrame:
    """The three weights of a term in a document, before scaling."""
    return tf.select(
        "doc_id", "term", "tf",
        F.col("tf").cast("double").alias("w_raw"),
        (1 + F.log(F.col("tf").cast("double"))).alias("w_norm"),
        (0.5 + 0.5 * F.col("tf") / F.col("max_tf")).alias("w_half"),
    )


def document_frequency(tf: DataFrame) -> DataFrame:
    """``(term, df, min_doc)``"""
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.min("doc_id").alias("min_doc"))


def with_idf(terms: DataFrame, documents: int) -> DataFrame:
    """``terms`` with ``idf``, the log of documents by document frequency, unsmoothed."""
    return terms.withColumn("idf", F.log(F.lit(float(documents)) / F.col("df")))


def postings(weighted: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, doc_id, tf, w_raw, w_norm, w_half)``, weights scaled by idf."""
    scaled = weighted.join(terms.select("term", "idf"), "term")
    return scaled.select("term", "doc_id", "tf", *[(F.col(f"w_{w}") * F.col("idf")).alias(f"w_{w}") for w in WEIGHTS])


def lookup(postings: DataFrame, *terms: str) -> DataFrame:
    """The postings of some terms; reaches the scan as a pushed filter."""
    return postings.filter(F.col("term").isin(*terms))


def doc_tokens(docs: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """``(doc_id, n_tokens)``: all tokens, before filters. No shuffle."""
    return docs.select("doc_id", F.size(profile.array(F.col("text"))).cast("long").alias("n_tokens"))


def deltas(postings: DataFrame) -> DataFrame:
    """``(term, doc_id, delta)``: each id less the one before it in its list.
    Lists are cut into ranges of ids, so a term of every document is no task of its own."""
    last = ranges.running(postings.select("term", "doc_id"), {"last": F.col("doc_id")}, [F.col("doc_id")], ["term"], largest=True, before=True)
    return last.select("term", "doc_id", (F.col("doc_id") - F.coalesce("last", F.lit(0))).alias("delta"))


def undelta(rows: DataFrame, position: str = "pos") -> DataFrame:
    """``(term, doc_id)`` back from ``(term, pos, delta)``."""
    return ranges.running(rows, {"doc_id": F.col("delta")}, [F.col(position)], ["term"]).select("term", "doc_id")
