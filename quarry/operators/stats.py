"""Corpus statistics: vocabulary growth, trie shape, sizes.

Heaps' law.  The vocabulary of the first m documents is the number of terms
whose first document is among them; tokens are summed the same way.  Documents
are ranked by id first (``ranges``), so ids may have gaps.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalar import varint_bytes
from quarry.operators import ranges


def _edges(tokens: DataFrame, grid: DataFrame, cuts: list[int]) -> DataFrame:
    """One row: ``edges``, an array of each cut with the id of the document of
    that rank, null if all documents are before the cut."""
    ranks = ranges.numbered(tokens.select(F.col("doc_id").cast("long").alias("id")), "place", [F.col("id")])
    ranks = ranks.select("id", (F.col("place") - 1).alias("cut")).filter(F.col("cut").isin(cuts))
    return grid.join(ranks, "cut", "left").agg(F.collect_list(F.struct("cut", "id")).alias("edges"))


def _prefixes(tokens: DataFrame, terms: DataFrame, cuts: list[int]) -> DataFrame:
    """``(i, cut, tokens, vocabulary)`` of the documents with a rank under each cut."""
    spark = tokens.sparkSession
    grid = spark.createDataFrame([(i, c) for i, c in enumerate(cuts)], "i long, cut long")
    edges = F.broadcast(_edges(tokens, grid.select("cut").distinct(), cuts))

    def at(df: DataFrame, doc: str, value, name: str) -> DataFrame:
        # a row is counted once, at the first cut above it; a running sum over the few cuts follows
        above = F.filter("edges", lambda e: e["id"].isNull() | (e["id"] > F.col(doc)))
        first = F.array_min(F.transform(above, lambda e: e["cut"]))
        return df.crossJoin(edges).groupBy(first.alias("cut")).agg(value.alias(name)).filter("cut is not null")

    new_tokens = at(tokens, "doc_id", F.sum("n_tokens"), "t")
    new_terms = at(terms, "min_doc", F.count("*"), "v")
    distinct = grid.groupBy("cut").agg(F.min("i").alias("first"))
    upto = Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)  # a row a cut
    sums = (
        distinct.join(new_tokens, "cut", "left").join(new_terms, "cut", "left")
        .select("cut", F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("tokens"), F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("vocabulary"))
    )
    return grid.join(sums, "cut").select("i", "cut", "tokens", "vocabulary")


def heaps_curve(tokens: DataFrame, terms: DataFrame, documents: int, samples: int = 100) -> DataFrame:
    """``(i, tokens, vocabulary)`` of the first i * documents / samples documents."""
    return _prefixes(tokens, terms, [i * documents // samples for i in range(samples)]).select("i", "tokens", "vocabulary")


def corpus_stats(tokens: DataFrame, terms: DataFrame, documents: int, name: str = "documents") -> DataFrame:
    """``(corpus, documents, vocabulary, tokens, b, k)``, with Heaps' law
    fitted through the whole corpus and its first half."""
    rows = _prefixes(tokens, terms, [documents // 2, documents])
    half = lambda c: F.max(F.when(F.col("i") == 0, F.col(c)))
    whole = lambda c: F.max(F.when(F.col("i") == 1, F.col(c)))
    sums = rows.agg(half("tokens").alias("t0"), whole("tokens").alias("t1"), half("vocabulary").alias("v0"), whole("vocabulary").alias("v1"))
    d = lambda c: F.col(c).cast("double")
    b = (F.log(d("v1")) - F.log(d("v0"))) / (F.log(d("t1")) - F.log(d("t0")))
    return sums.withColumn("b", b).select(
        F.lit(name).alias("corpus"), F.lit(documents).cast("long").alias("documents"), F.col("v1").alias("vocabulary"),
        F.col("t1").alias("tokens"), F.round("b", 6).alias("b"), F.round(d("v1") / F.pow(d("t1"), F.col("b")), 6).alias("k"),
    )


def radix_fanout(terms: DataFrame) -> DataFrame:
    """``(edges, inner_nodes, mean_children)`` of the radix tree over the terms'
    bytes.  Its nodes are the root, the terms, and the prefixes after which two
    different bytes follow."""
    coded = terms.select(F.hex(F.encode("term", "UTF-8")).alias("h"))
    nexts = (
        coded.select("h", F.explode(F.sequence(F.lit(0), (F.length("h") / 2 - 1).cast("int"))).alias("n"))
        .select(F.expr("substring(h, 1, 2 * n)").alias("prefix"), F.expr("substring(h, 2 * n + 1, 2)").alias("byte"))
        .groupBy("prefix").agg(F.count_distinct("byte").alias("next"))
    )
    known = coded.select(F.col("h").alias("prefix")).distinct().withColumn("is_term", F.lit(1))
    nodes = nexts.join(known, "prefix", "full").filter("is_term = 1 or next >= 2 or prefix = ''")
    edges = F.count(F.when(F.col("prefix") != "", 1))
    inner = F.count("next")
    return nodes.agg(edges.alias("edges"), inner.alias("inner_nodes"), F.round(edges / inner, 6).alias("mean_children"))


def corpus_bytes(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("documents"), F.sum(F.octet_length("text")).alias("bytes"))


def encoded_size(deltas: DataFrame) -> DataFrame:
    """``(term, bytes)`` of each list's ids in the index encoding."""
    return deltas.groupBy("term").agg(F.sum(varint_bytes(F.col("delta"))).alias("bytes"))


@dataclass
class Perf:
    """Times of a build, in seconds, and sizes of what it wrote, in bytes."""

    name: str = ""
    times: dict[str, float] = field(default_factory=dict)
    index_bytes: int = 0
    titles_bytes: int = 0
    initial_bytes: int = 0

    def timed(self, step: str, action):
        began = time.perf_counter()
        out = action()
        self.times[step] = self.times.get(step, 0.0) + time.perf_counter() - began
        return out

    @property
    def total_bytes(self) -> int:
        return self.index_bytes + self.titles_bytes

    @property
    def row(self) -> dict:
        ratio = self.total_bytes / self.initial_bytes if self.initial_bytes else 0.0
        return {
            "name": self.name, **self.times, "total": sum(self.times.values()), "index_bytes": self.index_bytes,
            "titles_bytes": self.titles_bytes, "total_bytes": self.total_bytes, "initial_bytes": self.initial_bytes, "ratio": ratio,
        }
