"""Trees of pre-tokenised pages: ``root/<n>/<host_path>``, one page a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import path_tokens, space_tokens
from quarry.operators import ranges


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(title, text)`` of every page; the title is its last two path parts."""
    files = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(root)
    return files.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1).alias("title"), F.col("value").alias("text")
    )


def page_tokens(pages: DataFrame) -> DataFrame:
    """``(title, pos, term)``: words of the name, then of the page."""
    words = F.concat(path_tokens(F.col("title")), space_tokens(F.col("text")))
    return pages.select("title", F.posexplode(words).alias("pos", "term")).withColumn("pos", F.col("pos").cast("long"))


def numbered(pages: DataFrame) -> DataFrame:
    """``pages`` with ``doc_id``: places in the order of the titles, from 0."""
    return ranges.numbered(pages, "doc_id", [F.col("title")]).withColumn("doc_id", F.col("doc_id") - 1)


def title_of_url(url: Column, shelf: str = "0") -> Column:
    """The file name under which a page with this address is stored."""
    bare = F.regexp_replace(url, r"^[a-z]+://", "")
    return F.concat(F.lit(shelf + "/"), F.translate(bare, "/", "_"))


def strip_tags(html: Column) -> Column:
    """A page's text: scripts and styles go, tags become spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.regexp_replace(bare, r"<[^>]*>", " ")


def from_html(pages: DataFrame) -> DataFrame:
    """``(doc_id, title, text)`` of a table ``(page_id, url, html)``."""
    return pages.select(F.col("page_id").alias("doc_id"), title_of_url(F.col("url")).alias("title"), strip_tags(F.col("html")).alias("text"))
