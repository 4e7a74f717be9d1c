"""Mixing sources to target weights by capped water-filling.

Weights.  Sources, ordered by code point with null last, take the weights
5, 2, 1 in turn.  They share ``share`` times the size of all documents; no
source gets more than ``max_epochs`` times its own size, and what a clamped
source leaves is dealt out again by weight until none is above its cap.  The
fixed point is closed-form: with the sources sorted by cap / weight, the first
k are clamped, where k is the least number for which the next source's share
of the rest stays under its cap.

Sampling.  A source with target / size = w + f takes every document w times
and the fraction f of its words once more: documents are ordered by a seeded
hash and taken whole while the middle of a document lies inside that fraction,
so that a source misses its target by half a document at most.  Running sizes
come from ranges of (source, hash), whose number follows that of the documents,
so a hot source is spread over many tasks; so are the sources themselves, by
cap / weight.

Everything is DataFrame code without user functions.

Defined cases: a null text has size 0 and takes nothing; a null source is a
source of its own, last; a null id hashes as the text "null"; repeated rows are
documents of their own; if all sizes are 0, all targets are 0; an empty table
gives an empty result; further columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.rows import addressed, everything, matched
from quarry.operators import ranges, skew
from quarry.runtime import column, fresh, materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 42
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """The number of words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, ...)``, a row for each source, to the same with
    ``target``.  Sources may be many (hosts): their order and the running sums over
    them come from ranges; four numbers come to the driver."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        ranges.numbered(sizes, "place", [F.col("source").asc_nulls_last()])
        .withColumn("weight", F.get(cycle, F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")))
        .withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    filled = materialize(
        ranges.running(ranked, {"caps": F.col("cap"), "closed": F.col("weight")}, [F.col("ratio"), F.col("place")], before=True), "mix-filled"
    )
    total, heavy = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = float(total or 0) * share
    rest, open_ = F.lit(budget) - F.col("caps"), F.lit(heavy or 0.0) - F.col("closed")
    # a source and those after it share `rest`: it stays open if its cap holds its share
    fits = rest * F.col("weight") <= F.col("cap") * open_
    first = filled.filter(fits).agg(F.min(F.struct("ratio", "place", rest.alias("rest"), open_.alias("open"))).alias("o")).first()["o"]
    if first is None:  # no source at all, or the caps hold less than the budget
        target = F.col("cap")
    else:
        clamped = F.struct("ratio", "place") < F.struct(F.lit(first.ratio).alias("ratio"), F.lit(first.place).cast("long").alias("place"))
        target = F.when(clamped, F.col("cap")).otherwise(F.lit(first.rest) * F.col("weight") / F.lit(first.open))
    return filled.select(*sizes.columns, target.alias("target"))


def mix(
    docs: DataFrame, size: Column, id_col: str = "doc_id", source: str = "source",
    weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """``doc`` (a struct with all columns of ``docs``), ``size``,
    ``source_size``, ``target`` and ``repeats``: how often the mix takes it."""
    sized = docs.select(
        F.struct(*everything(docs)).alias("doc"),
        column(source).alias("source"),
        F.coalesce(F.concat(F.lit("="), column(source).cast("string")), F.lit("")).alias("key"),  # never null
        size.alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column(id_col).cast("string"), F.lit("null"))).cast("binary")).alias("order"),
    )
    sizes = sized.groupBy("source", "key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = materialize(source_targets(sizes, weights, share, max_epochs).drop("source"), "mix-targets")
    rows = targets.agg(F.sum("n")).first()[0] or 0
    # a hot source's documents stay where they are; its running sizes go over as many ranges as it needs
    planned = skew.joined(sized.drop("source"), targets, "key", "n", rows)
    placed = ranges.running(planned, {"end": F.col("size")}, [F.col("order"), F.col("size")], ["key"], rows=rows).withColumn(
        "whole", F.when(F.col("source_size") == 0, 0.0).otherwise(F.floor(F.col("target") / F.col("source_size")))
    )
    middle = F.col("end") - F.col("size") / 2
    extra = (middle < F.col("target") - F.col("whole") * F.col("source_size")) & (F.col("size") > 0)
    repeats = F.col("whole").cast("long") + F.when(extra, 1).otherwise(0)
    return placed.select(
        "doc", "size", "source_size", "target", F.when(F.col("size") > 0, repeats).otherwise(0).cast("long").alias("repeats")
    )


def repeated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it.
    Texts move once, when they meet their number of repeats."""
    rows, key = addressed(docs)
    slim = rows.select(column(key).alias("address"), column(id_col).alias("id"), column(source).alias("source"), word_count(column(text)).alias("size"))
    slim = materialize(slim, "mix-sizes")
    often = fresh([*docs.columns, key], "repeats")
    taken = mix(slim, F.col("size"), "id", **options).filter("repeats > 0").select(F.col("doc.address").alias(key), F.col("repeats").alias(often))
    copies = F.explode(F.sequence(F.lit(1), F.col(often).cast("int"))).alias(often)
    return matched(rows, taken, key).select(*everything(docs), copies).drop(often)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return mix(slim, F.col("size")).select(
        F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken")
    )


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    md5('42:' || coalesce(doc_id::VARCHAR, 'null')) AS ord
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
    row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) AS place
  FROM sizes),
weighted AS (
  SELECT *, [5.0, 2.0, 1.0][((place - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight FROM ranked),
total AS (SELECT sum(source_size)::DOUBLE * 1.5 AS budget, sum(weight) AS weights FROM weighted),
filled AS (
  SELECT w.*,
    budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    weights - coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
  FROM weighted w, total),
first_open AS (SELECT rest, open, cap / weight AS ratio, place FROM filled WHERE rest * weight <= cap * open ORDER BY ratio, place LIMIT 1),
targets AS (
  SELECT f.source, f.source_size,
    CASE WHEN (f.cap / f.weight, f.place) < (o.ratio, o.place) THEN f.cap ELSE o.rest * f.weight / o.open END AS target
  FROM filled f, first_open o),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size = 0 THEN 0 ELSE floor(t.target / t.source_size) END AS whole,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size / 2.0::DOUBLE AS middle
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0
    ELSE size * (whole + CASE WHEN middle < target - whole * source_size THEN 1 ELSE 0 END)::BIGINT END::BIGINT AS taken
FROM placed
"""
