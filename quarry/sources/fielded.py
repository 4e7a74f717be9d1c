r"""Collections in one text file: a record begins at a line ``.I n``; a line with
``.T``, ``.W``, ``.K``, ``.B`` or ``.A`` opens a field; other markers open
fields that are passed over.

A marker counts at the start of a line only.  ``first_sentence_only`` keeps of
each field what stands before its first period, as an index that takes every
period for a marker does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The markers and their fields.
FIELDS = {"T": "title", "W": "summary", "K": "keywords", "B": "publication", "A": "authors"}
INDEXED = ("title", "summary", "keywords")


def records(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, body)``: ids from 0 in file order are the records' numbers less 1."""
    raw = spark.read.option("lineSep", "\n.I ").text(path)
    body = F.regexp_replace("value", r"^\.I ", "")
    return raw.select(
        (F.regexp_extract(body, r"^\s*(\d+)", 1).try_cast("long") - 1).alias("doc_id"),
        F.regexp_replace(body, r"^\s*\d*[^\n]*", "").alias("body"),
    ).filter("doc_id is not null")


def scan_fielded(spark: SparkSession, path: str, first_sentence_only: bool = False) -> DataFrame:
    """``(doc_id, seq, field, text)``, a row for each field of each record."""
    part = F.col("part")
    name = F.create_map(*[F.lit(x) for pair in FIELDS.items() for x in pair])
    text = F.trim(F.regexp_replace(F.regexp_replace(part, r"^\.[A-Z][ \t]*", ""), r"\s+", " "))
    if first_sentence_only:
        text = F.trim(F.regexp_extract(text, r"^[^.]*", 0))
    return (
        records(spark, path)
        .select("doc_id", F.posexplode(F.split("body", r"\n(?=\.[A-Z]\s)")).alias("seq", "part"))
        .filter(part.rlike(r"^\.[A-Z]\s"))
        .select(
            "doc_id", F.col("seq").cast("long"), F.coalesce(name[F.substring(part, 2, 1)], F.lit("other")).alias("field"), text.alias("text")
        )
    )


def documents(fields: DataFrame, first_id: int = 0) -> DataFrame:
    """``(doc_id, title, summary, keywords, publication, authors, text)``: the
    stored record, and in ``text`` what is indexed of it."""
    one = lambda f: F.coalesce(F.max(F.when(F.col("field") == f, F.col("text"))), F.lit("")).alias(f)
    stored = fields.groupBy("doc_id").agg(*[one(f) for f in FIELDS.values()])
    return stored.withColumn("text", F.concat_ws("\n", *INDEXED)).withColumn("doc_id", F.col("doc_id") + first_id)


def display_title(title: Column) -> Column:
    """A title as its tokens, one space between them."""
    from quarry.functions.text import fielded_tokens

    return F.array_join(fielded_tokens(title), " ")


def fetch(docs: DataFrame, doc_id: int) -> DataFrame:
    """The stored record; no row if there is none."""
    return docs.filter(F.col("doc_id") == doc_id)
