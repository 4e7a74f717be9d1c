"""Evaluation against judgments: hits, precision and recall, curves, a mean score.

The interpolated precision at recall x is the largest precision at a recall
above x.  A point of recall r serves the samples i / 256 below r, so it is put
into the bucket of the last of them; a running maximum from the right over a
topic's buckets, each of which serves the samples down to the next one, gives its
curve.  Topics with under two points have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import ranges
from quarry.operators.vector import by_weight
from quarry.runtime import materialize

SAMPLES = 256
BANDS = 16  # of scores, an octave
BROADCAST_ROWS = 200_000


def hits(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """The judged documents in a ranking ``(qid, weight, doc_id, score)``, or
    ``(qid, doc_id, raw, norm, half)``, with ``rank`` and the number ``answers`` of
    the topic's judged documents.

    Only judged documents get a rank.  Hits are counted by bands of scores; those
    in a band with a judged document are numbered within it, over ranges
    (``ranges``), and the counts of the bands above are added.  So no task sorts a
    topic's hits, of which there may be as many as documents.  Topics without a
    judgment are left out before they are scored, if ``ranking`` is a plan."""
    judged = materialize(qrels.distinct(), "qrels")
    # few judgments meet the hits where these are; more are dealt out with them
    few = F.broadcast if judged.count() <= BROADCAST_ROWS else (lambda df: df)
    answers = judged.groupBy("qid").agg(F.count("*").alias("answers"))
    ranking = materialize(ranking.join(few(answers.select("qid")), "qid", "left_semi"), "ranking")  # read three times

    def scored(rows: DataFrame) -> DataFrame:
        rows = rows if "weight" in rows.columns else by_weight(rows)
        return rows.withColumn("band", F.floor(F.log2(1 + F.greatest("score", F.lit(0.0))) * BANDS).cast("int"))

    mine = materialize(scored(ranking.join(few(judged), ["qid", "doc_id"])), "judged")
    bands = ["qid", "weight", "band"]
    above = Window.partitionBy("qid", "weight").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = scored(ranking).groupBy(*bands).agg(F.count("*").alias("n"))
    counts = counts.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
    near = materialize(scored(ranking).join(few(mine.select(*bands).distinct()), bands, "left_semi"), "near")
    places = ranges.numbered(near, "place", [F.col("score").desc(), F.col("doc_id")], bands)
    return (
        places.join(few(judged), ["qid", "doc_id"], "left_semi")
        .join(counts, bands).withColumn("rank", F.col("above") + F.col("place"))
        .join(answers, "qid").select("qid", "doc_id", "weight", "score", "rank", "answers")
    )


def points(found: DataFrame) -> DataFrame:
    """``(qid, weight, rank, k, recall, precision)`` at every hit."""
    k = F.row_number().over(Window.partitionBy("qid", "weight").orderBy("rank")).cast("long")
    return found.withColumn("k", k).select(
        "qid", "weight", "rank", "k", (F.col("k") / F.col("answers")).alias("recall"), (F.col("k") / F.col("rank")).alias("precision")
    )


def valid(pts: DataFrame) -> DataFrame:
    """``(qid, weight)`` with at least two points."""
    return pts.groupBy("qid", "weight").agg(F.count("*").alias("n")).filter("n >= 2").select("qid", "weight")


def curves(pts: DataFrame) -> DataFrame:
    """``(qid, weight, i, precision)`` for i from 0 to 255 of every valid topic.
    One shuffle, by topic and weight, serves the counts, the buckets and the maxima."""
    topic = Window.partitionBy("qid", "weight")
    down = topic.orderBy(F.col("i").desc())
    bucket = (F.ceil(F.col("recall") * SAMPLES) - 1).cast("long")
    best = (
        pts.withColumn("n", F.count("*").over(topic)).filter("n >= 2").withColumn("i", F.least(bucket, F.lit(SAMPLES - 1)))
        .groupBy("qid", "weight", "i").agg(F.max("precision").alias("best"))
    )
    steps = best.select(
        "qid", "weight", F.col("i").alias("upto"), (F.coalesce(F.lead("i").over(down), F.lit(-1)) + 1).alias("begin"),
        # the samples above the last bucket are its row's too, with nothing found there
        F.when(F.row_number().over(down) == 1, F.lit(SAMPLES - 1)).otherwise(F.col("i")).cast("long").alias("end"),
        F.max("best").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("best"),
    )
    samples = steps.select("*", F.explode(F.sequence(F.col("begin"), F.col("end"))).alias("i"))
    return samples.select("qid", "weight", "i", F.when(F.col("i") <= F.col("upto"), F.col("best")).otherwise(0.0).alias("precision"))


def average(curve: DataFrame) -> DataFrame:
    """``(weight, i, precision)``: the mean curve over the valid topics."""
    return curve.groupBy("weight", "i").agg(F.avg("precision").alias("precision"))


def score(mean_curve: DataFrame) -> DataFrame:
    """``(weight, map)``: the mean of the average curve's samples. Not the usual
    mean average precision, which ``average_precision`` gives."""
    return mean_curve.groupBy("weight").agg(F.avg("precision").alias("map"))


def average_precision(found: DataFrame) -> DataFrame:
    """``(weight, ap)``: the textbook mean over the topics that have a hit."""
    pts = points(found).join(found.select("qid", "answers").distinct(), "qid")
    each = pts.groupBy("qid", "weight").agg((F.sum("precision") / F.max("answers")).alias("ap"))
    return each.groupBy("weight").agg(F.avg("ap").alias("ap"))


def report_of(pts: DataFrame) -> DataFrame:
    """``(weight, topics, points, map)``"""
    sizes = pts.groupBy("qid", "weight").agg(F.count("*").alias("n")).filter("n >= 2")
    sizes = sizes.groupBy("weight").agg(F.count("*").alias("topics"), F.sum("n").alias("points"))
    return sizes.join(F.broadcast(score(average(curves(pts)))), "weight")  # a row a weight


def report(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """``(weight, topics, points, map)``; the points are made once."""
    return report_of(materialize(points(hits(ranking, qrels)), "points"))
