"""Live latency quantiles of a stream of queries, per corpus and time window.

The state of a window is one bounded sketch a corpus; a window is emitted once
the watermark has passed it, so late rows within ``late`` still count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_percentiles(
    log: DataFrame, time: str = "ts", value: str = "value", by: str = "event_type",
    window: str = "5 minutes", late: str = "10 minutes", at=(0.5, 0.9, 0.95, 0.99),
) -> DataFrame:
    """``(window_start, by, n, p50, p90, p95, p99)``; works on batches as well."""
    found = (
        log.withWatermark(time, late).groupBy(F.window(time, window), by)
        .agg(F.count(value).alias("n"), F.percentile_approx(value, F.array(*map(F.lit, at)), F.lit(10_000)).alias("p"))
    )
    points = [F.get("p", k).alias(f"p{round(p * 100)}") for k, p in enumerate(at)]
    return found.select(F.col("window.start").alias("window_start"), by, "n", *points)
