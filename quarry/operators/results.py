"""Result lists: metadata, pages, counts, links, latencies."""

from __future__ import annotations

from urllib.parse import urlencode

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import ranges
from quarry.runtime import column

PAGE = 20


def offset_of(text: str | int | None, size: int) -> int:
    """Where a page begins; what is no number, not positive or past the end means the first page."""
    try:
        offset = int(text)
    except (TypeError, ValueError):
        return 0
    return offset if 0 < offset < size else 0


def projected(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """``hits`` with ``title`` and ``url``; the hits decide which documents are read."""
    return hits.join(docs.select("doc_id", "title", "url"), "doc_id")


def page(hits: DataFrame, docs: DataFrame, offset: int = 0, size: int = PAGE, scored: bool = True) -> DataFrame:
    """A page of results, ``(rank, doc_id, title, url[, score])``: by score, or
    by id for Boolean hits. A page of hits, then a join of these few rows."""
    from quarry.operators.vector import ranked

    if scored:
        top = ranked(hits, size, offset)
    else:
        top = ranked(hits.withColumn("score", F.lit(0.0)), size, offset).drop("score")
    columns = ["rank", "doc_id", "title", "url", *(["score"] if scored else [])]
    # at most `size` rows: broadcast, so that the document table isn't shuffled
    return docs.select("doc_id", "title", "url").join(F.broadcast(top), "doc_id").select(*columns)


def count(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("hits"))


def links(query: str, kind: str, corpus: str, weight: str | None, offset: int, total: int, size: int = PAGE) -> tuple[str, str]:
    """Addresses of the page before and after, empty where there is none."""

    def to(at: int) -> str:
        parts = {"query": query, "type": kind, "corpus": corpus, "offset": at}
        return "?" + urlencode(parts | ({"weight": weight} if weight else {}))

    return to(max(0, offset - size)) if offset > 0 else "", to(offset + size) if offset + size < total else ""


def latency_percentiles(log: DataFrame, value: str = "value", by: str | None = None, at=(0.5, 0.9, 0.95, 0.99), exact: bool = False) -> DataFrame:
    """``([by,] n, p50, ...)`` of a latency log.  Approximate quantiles keep a
    bounded sketch a group; exact ones interpolate between the two values at a
    quantile's place, which are found over ranges, not in one task a group."""
    names = [f"p{round(p * 100)}" for p in at]
    group = [by] if by else []
    if not exact:
        columns = [F.round(F.percentile_approx(column(value), p), 6).alias(c) for p, c in zip(at, names)]
        return log.groupBy(*map(column, group)).agg(F.count(column(value)).alias("n"), *columns)
    rows = log.select(*[column(c).alias("by") for c in group], column(value).cast("double").alias("v"))
    sizes = rows.groupBy(*["by"] * len(group)).agg(F.count("v").alias("n"))
    placed = ranges.numbered(rows.filter(F.col("v").isNotNull()), "place", [F.col("v")], ["by"] * len(group))
    wanted = sizes.select("*", *[(F.lit(p) * (F.col("n") - 1)).alias(c) for p, c in zip(at, names)])  # a row a group
    same = F.lit(True)
    if by:
        wanted = wanted.withColumnRenamed("by", "group")
        same = F.col("by").eqNullSafe(F.col("group"))
    met = same & F.array_contains(F.array(*[f(c) for c in names for f in (F.floor, F.ceil)]), F.col("place") - 1)
    found = wanted.join(placed, met, "left")
    low = lambda c: F.max(F.when(F.col("place") - 1 == F.floor(c), F.col("v")))
    high = lambda c: F.max(F.when(F.col("place") - 1 == F.ceil(c), F.col("v")))
    between = [F.round(low(c) + (high(c) - low(c)) * (F.max(c) - F.floor(F.max(c))), 6).alias(c) for c in names]
    out = found.groupBy(*["group"] * len(group)).agg(F.max("n").alias("n"), *between)
    return out.withColumnRenamed("group", by) if by else out
