"""Topics, judgments and stop words from their text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def topics(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, text)``: the ``.W`` body of each record; lines end in a space."""
    raw = spark.read.option("lineSep", "\n.I ").text(path)
    body = F.regexp_replace("value", r"^\.I ", "")
    wanted = F.regexp_extract(body, r"(?s)\n\.W[^\n]*\n(.*?)(?=\n\.[A-Z]|$)", 1)
    lines = F.filter(F.split(wanted, "\n"), lambda x: ~x.startswith("."))
    return raw.select(
        F.regexp_extract(body, r"^\s*(\d+)", 1).try_cast("long").alias("qid"),
        F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit(" "))), "").alias("text"),
    ).filter("qid is not null")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, doc_id)``; documents count from 1 in the file, from 0 here."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(
        F.try_element_at(parts, F.lit(1)).try_cast("long").alias("qid"), (F.try_element_at(parts, F.lit(2)).try_cast("long") - 1).alias("doc_id")
    ).filter("qid is not null and doc_id is not null")


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """``(term)``, each once."""
    return spark.read.text(path).select(F.trim("value").alias("term")).filter("term <> ''").distinct()
