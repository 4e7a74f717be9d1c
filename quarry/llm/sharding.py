"""Contiguous shards of equal bytes by global prefix sums.

Documents are range-partitioned by id and the partitioning is frozen in a
table, so that a lost executor can't move a row to another partition.  Each
partition is summed; the running sums of these few totals give every partition
its global offset; a window inside each partition gives every document its
global byte position.  The line of bytes is cut at equal targets, and a
document belongs to the shard that holds its middle, so a shard misses the
equal share by one document's size at most.

Everything is DataFrame code without user functions.  Ties on the id are broken
by text checksum, size and input order, so a repeated id (null included, which
sorts first) is spread over partitions like any other rows.

Defined cases: a null text has no bytes but its overhead, and the checksum of
the empty text; repeated rows take places of their own; with fewer documents
than shards some shards stay empty; an empty table gives an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ranges import parts_for
from quarry.runtime import column, materialize

SHARDS = 40
OVERHEAD = 16


def shard(
    docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id_col``, ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each shard)."""
    content = F.coalesce(column(text), F.lit(""))
    slim = docs.select(
        column(id_col).alias("id"),
        (F.octet_length(content) + overhead).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )
    parts = parts_for(docs, docs.count())
    order = [F.col("id").asc_nulls_first(), F.col("text_crc32"), F.col("size"), F.col("tie")]
    ranged = materialize(
        slim.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "shard-ranges"
    )
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    over_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # one row a partition
    offsets = totals.select(
        "part",
        (F.sum("bytes").over(over_parts) - F.col("bytes")).alias("bytes_before"),
        (F.sum("rows").over(over_parts) - F.col("rows")).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy(F.lit(1))).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.withColumn("end", F.sum("size").over(running))
        .withColumn("nth", F.row_number().over(inside))
        .join(offsets, "part")
        .withColumn("doubled", 2 * (F.col("bytes_before") + F.col("end")) - F.col("size"))
        # by the middle of the document, in whole numbers: floor(middle * shards / all_bytes)
        .withColumn("shard", F.expr(f"int(least({shards - 1}, (cast(doubled as decimal(38,0)) * {shards}) div (2 * all_bytes)))"))
        .withColumn("place", F.col("rows_before") + F.col("nth") - 1)
    )
    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))  # a row a shard
    return placed.join(starts, "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("place") - F.col("start")).alias("slot")
    )


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


ORACLE = """
WITH bytes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    [('0x' || substring(hex(encode(coalesce(text, ''))), i::BIGINT, 2))::BIGINT
      FOR i IN range(1, 2 * octet_length(encode(coalesce(text, ''))), 2)] AS b
  FROM documents),
crc AS (  -- the table of the polynomial by its rule, then byte by byte
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), LAMBDA c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM bytes, (SELECT [list_reduce(list_prepend(n::BIGINT, range(8)), LAMBDA c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)
    FOR n IN range(256)] AS t)),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS till,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS place, sum(size) OVER () AS every FROM crc),
cut AS (SELECT *, least(39, ((2 * till - size)::HUGEINT * 40) // (2 * every::HUGEINT))::INT AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
  (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM cut
"""
