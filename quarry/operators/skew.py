"""Joins on keys of which a few may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000


def joined(rows: DataFrame, values: DataFrame, key: str, n: str, total: int, share: int = SHARE) -> DataFrame:
    """The inner join of ``rows`` with ``values``, one row a ``key``, whose column
    ``n`` tells how many of all ``total`` rows hold the key (it is dropped).

    A key with more than one in ``share`` of the rows is heavy: there are fewer
    than ``share`` of these whatever the size, so they are broadcast, and no row of
    theirs is shuffled.  The others are dealt out by key; none is large."""
    heavy = values.filter(F.col(n) * share > F.lit(total)).drop(n)
    light = values.filter(F.col(n) * share <= F.lit(total)).drop(n)
    hot = rows.join(F.broadcast(heavy), key)
    return hot.unionByName(rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key))
