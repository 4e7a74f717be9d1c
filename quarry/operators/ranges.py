"""Running totals in a global order, with no task that sees all rows.

Rows are range-partitioned, and the partitions are frozen in a table, so that a
lost executor can't move a row to another one.  A window works inside each
partition; what comes before a partition is added from a table that has a row or
two a partition.  A key that holds most rows is spread over as many partitions
as its rows need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.runtime import column, fresh, materialize

ROWS_EACH = 1 << 20


def parts_for(df: DataFrame, rows: int) -> int:
    """As many partitions as the session asks for, more if they would be too large."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_EACH))


def running(
    df: DataFrame, totals: dict[str, Column], order: Sequence[Column], by: Sequence[str] = (),
    largest: bool = False, before: bool = False, rows: int | None = None,
) -> DataFrame:
    """``df`` with a column for each of ``totals``: its sum (``largest``: its
    maximum) over the rows up to this one in ``order``, begun anew for every value
    of the columns ``by``; ``before`` leaves this row out.  A maximum of no rows is
    null, a sum of none 0.  ``rows``, if known, sets the number of partitions."""
    keys = [column(c) for c in by]
    taken = [*df.columns, *totals]

    def name(like: str) -> str:
        taken.append(fresh(taken, like))
        return taken[-1]

    part, first, last = name("part"), name("first"), name("last")
    count = parts_for(df, rows or 0)
    dealt = df.repartitionByRange(count, *keys, *order) if keys or order else df
    ranged = materialize(dealt.withColumn(part, F.spark_partition_id()), "ranges")
    fold = F.max if largest else F.sum
    carried = {c: name(f"{c}_carried") for c in totals}
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sums = ranged.groupBy(part, *keys).agg(*[fold(v).alias(c) for c, v in totals.items()])
    if keys:
        # only a partition's first and last groups can go on in another one
        ends = sums.groupBy(part).agg(F.min(F.struct(*keys)).alias(first), F.max(F.struct(*keys)).alias(last))
        sums = sums.join(F.broadcast(ends), part).filter(F.struct(*keys).eqNullSafe(F.col(first)) | F.struct(*keys).eqNullSafe(F.col(last)))
    names = {c: name("of") for c in (part, *by)}
    carry = sums.select(
        *[column(c).alias(n) for c, n in names.items()], *[fold(c).over(earlier).alias(carried[c]) for c in totals]
    ).filter(F.coalesce(*[F.col(c).isNotNull() for c in carried.values()]))
    inside = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    same = [column(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    met = same[0]
    for s in same[1:]:
        met = met & s
    found = ranged.withColumns({c: fold(v).over(inside) for c, v in totals.items()}).join(F.broadcast(carry), met, "left")
    zero = lambda c: F.coalesce(column(c), F.lit(0))
    both = {c: F.greatest(column(c), column(k)) if largest else zero(c) + zero(k) for c, k in carried.items()}
    return found.select(*map(column, df.columns), *[v.alias(c) for c, v in both.items()])


def numbered(df: DataFrame, name: str, order: Sequence[Column], by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """``df`` with ``name``: the place of a row, from 1."""
    return running(df, {name: F.lit(1).cast("long")}, order, by, rows=rows)
