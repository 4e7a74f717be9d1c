"""Ranked retrieval: a document's score is the sum of its weights over the
query's words, each as often as the query has it.  There is no query weight and
no length normalisation.  A document that holds a word is ranked even if its
score is 0; ties go by id."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.stem import stem
from quarry.functions.text import DEFAULT, Profile
from quarry.operators import ranges
from quarry.operators.index import WEIGHTS

_TOKEN = re.compile(r"[^\W_]+")
DIGITS = 6
#: Pages that end above this place are cut off by a top-k.
TOP = 10_000


def weight_of(name: str | None) -> str:
    """Unknown names mean the raw weight."""
    return name if name in WEIGHTS else "raw"


def query_terms(query: str, profile: Profile = DEFAULT) -> dict[str, int]:
    """The terms of a query and how often it has each."""
    words = _TOKEN.findall(query.lower() if profile.lowercase else query)
    words = [w for w in words if w not in profile.stop]
    return Counter(stem(w) if profile.stem and len(w.encode()) > 3 else w for w in words)


def vector_search(postings: DataFrame, query: str, weight: str | None = None, profile: Profile = DEFAULT) -> DataFrame:
    """``(doc_id, score)``, unsorted. Reads one weight of the query's terms only."""
    terms = query_terms(query, profile)
    if not terms:
        return postings.select("doc_id", F.lit(0.0).alias("score")).filter(F.lit(False))
    often = F.coalesce(*[F.when(F.col("term") == t, F.lit(n)) for t, n in terms.items()])
    hits = postings.filter(F.col("term").isin(*terms))
    return hits.groupBy("doc_id").agg(F.round(F.sum(often * F.col(f"w_{weight_of(weight)}")), DIGITS).alias("score"))


def ranked(hits: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """``hits`` with ``rank`` from 1: of all, or of a page.  A page near the top
    is a top-k without a full sort; all ranks, and pages far down, come from
    ranges of scores (``ranges``)."""
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    if limit is not None and offset + limit <= TOP:
        top = hits.orderBy(*order).limit(offset + limit)  # at most TOP rows
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).filter(F.col("rank") > offset)
    found = ranges.numbered(hits, "rank", order)
    return found if limit is None else found.filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def topic_terms(topics: DataFrame, tokens: Column) -> DataFrame:
    """``(qid, term, qtf)`` of a table ``(qid, ...)`` and the array of each topic's tokens."""
    return topics.select("qid", F.explode(tokens).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def scores(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """``(qid, doc_id, raw, norm, half)``: all topics under all weights in one plan."""
    sums = [F.round(F.sum(F.col("qtf") * F.col(f"w_{w}")), DIGITS).alias(w) for w in WEIGHTS]
    return postings.join(terms, "term").groupBy("qid", "doc_id").agg(*sums)


def by_weight(scores: DataFrame) -> DataFrame:
    """The same with a row a weight: ``(qid, weight, doc_id, score)``."""
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), F.col(w).alias("score")) for w in WEIGHTS]))
    return scores.select("qid", "doc_id", each.alias("s")).select("qid", "s.weight", "doc_id", "s.score")


def vector_batch(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """``(qid, weight, doc_id, score)`` of all topics under all weights."""
    return by_weight(scores(postings, terms))
