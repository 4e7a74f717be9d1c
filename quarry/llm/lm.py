"""Language-model scoring by subword lattices.

Model.  A text is its lower-cased words and an end.  A word, with a marker in
front, is generated piece by piece, and the model's probability of it is summed
over all its cuts by a forward recursion in log space; a text's is the product
over its words and the end's.  The pieces and their prior probabilities are an
existing vocabulary's.  The scores are adapted to the training documents by
expectation steps: the scores weight all cuts of every training word, each
piece's expected number is added to ``PRIOR`` observations shared out by the
existing scores, and the sums, normalised with the end, are the next scores.
Steps end when the training words' log probability gains less than ``TOLERANCE``
of itself, after ``MOST_STEPS`` at the latest; each is one pass over the table of
distinct words.  ``prior_score`` is the score under the existing scores as they
are (the end at one a training document), so that the adaptation can be told
apart.

Base.  A unigram word model with add-one smoothing over the same training
documents.

Plan.  Words are counted in the map tasks and summed over the corpus; the table
of distinct words gets its lattice scores once a word, not once an occurrence.
The most frequent words, at most ``FREQUENT`` of them, go to all tasks; what a
document has of other words is joined with the table.  That only routes words:
every count and score is the same whichever way it comes.

Defined cases: a null text is empty and consists of its end; a null id is in
training; repeated rows count as often as they appear; without training
documents all counts are 0 and the existing scores stand; very long texts are
scored whole; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import contents, slices, word_blocks
from quarry.llm.subword import MARK, expected, load, log_sums, model_path
from quarry.runtime import column, materialize

FREQUENT = 200_000
PRIOR = 10_000.0
#: Below this gain the score of held-out documents of sf0.1 changes by under 0.001 log10 a token.
TOLERANCE = 5e-3
MOST_STEPS = 8
FLUSH = 400_000
FIXED = 1 << 32  # expected numbers are summed as whole multiples of 1 / FIXED, in any order alike


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of ``docs(held, text)``: the training documents' counts,
    0 for other words; a null word stands for the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, other, ends = Counter(), set(), 0

        def flush() -> pa.RecordBatch:
            extra = [w for w in other if w not in train]
            words = pa.array([*train, *extra, None], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array([*train.values(), *[0] * len(extra), ends], pa.int64())], ["word", "n"])

        for batch in (p for b in batches for p in slices(b, 1)):
            for data, held in zip(contents(batch, 1), batch.column(0).to_pylist()):
                for words in word_blocks((data or b"").lower()):
                    (other if held else train).update(words)
                    if len(train) + len(other) > FLUSH:
                        yield flush()
                        train, other, ends = Counter(), set(), 0
                ends += not held
        yield flush()

    return docs.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def adapt(words: DataFrame, ends: int, model: str | None = None, prior: float = PRIOR, tolerance: float = TOLERANCE, most: int = MOST_STEPS) -> tuple[np.ndarray, float, int]:
    """Log probabilities of the pieces and of the end, and the number of
    expectation steps over ``words(word, n)`` that were taken.  What comes to the
    driver in a step is a number a piece."""
    spark = words.sparkSession
    v = load(model or model_path(spark))
    v.trie  # noqa: B018
    vocabulary = spark.sparkContext.broadcast(v)
    usable = np.isfinite(v.scores)
    share = np.where(usable, np.exp(np.where(usable, v.scores, 0)), 0)
    share /= share.sum()
    scores, end, before = v.scores, math.log(0.5), None
    for step in range(1, most + 1):
        current = spark.sparkContext.broadcast(scores)

        def run(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            total, log = np.zeros(len(current.value)), 0.0
            for part in (p for b in batches if b.num_rows for p in slices(b, 0)):
                found, z = expected(_marked(part), vocabulary.value, current.value, part.column(1).to_numpy(zero_copy_only=False).astype(float))
                total += found
                log += z
            seen = np.flatnonzero(total)
            numbers = np.append(np.rint(total[seen] * FIXED), round(log * FIXED / 1000)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1).astype(np.int32)), pa.array(numbers)], ["piece", "n"])

        rows = words.filter("n > 0").mapInArrow(run, "piece int, n bigint").groupBy("piece").agg(F.sum(F.col("n").cast("decimal(28,0)")).alias("n"))
        rows = rows.toArrow()
        found = dict(zip(rows.column("piece").to_pylist(), map(float, rows.column("n").to_pylist())))
        log = found.pop(-1, 0) * 1000 / FIXED
        counts = prior * share
        if found:
            np.add.at(counts, np.array(list(found)), np.array(list(found.values())) / FIXED)
        total = counts.sum() + ends + 1
        with np.errstate(divide="ignore"):
            scores, end = np.log(counts / total), math.log((ends + 1) / total)
        if not found or (before is not None and log - before < tolerance * abs(before)):
            break
        before = log
    return scores, end, step


def _marked(batch: pa.RecordBatch) -> list[bytes]:
    return [MARK + w for w in contents(batch, 0)]


def word_scores(words: DataFrame, pieces: np.ndarray, model: str | None = None) -> DataFrame:
    """``words`` with ``z`` and ``prior``: each word's log10 probability under
    the adapted and under the existing scores, summed over all cuts."""
    v = load(model or model_path(words.sparkSession))
    shared = words.sparkSession.sparkContext.broadcast((v, pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, adapted = shared.value
        for part in (p for b in batches if b.num_rows for p in slices(b, 0)):
            both = log_sums(_marked(part), vocabulary, [adapted, vocabulary.scores])
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(z / math.log(10)) for z in both)], ["word", "n", "z", "prior"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, z double, prior double")


def _frequent(words: DataFrame, most: int) -> pa.Table:
    """At most ``most`` of the most frequent words: all from a count on that a
    histogram over powers of 2 ** (1/8) shows to be few enough."""
    level = F.floor(8 * F.log2(F.col("n"))).cast("int")
    kept, least = 0, None
    for row in words.filter("n > 0").groupBy(level.alias("level")).count().orderBy(F.col("level").desc()).collect():
        if (kept := kept + row["count"]) > most:
            break
        least = row["level"]
    return words.filter(F.lit(False) if least is None else level >= least).toArrow()


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score`` and ``prior_score`` of every document."""
    slim = docs.select(column(id_col).alias("id"), held_out(column(id_col)).alias("held"), column(text).alias("text"))
    counts = materialize(count_words(slim.select("held", "text")), "lm-counts")
    words = counts.filter("word is not null")
    totals = counts.agg(
        F.sum("n"), F.sum(F.when(F.col("word").isNotNull() & (F.col("n") > 0), 1)), F.sum(F.when(F.col("word").isNull(), F.col("n")))
    ).first()
    n_all, distinct, ends = (int(x or 0) for x in totals)
    distinct += ends > 0
    pieces, end, _ = adapt(words, ends, model)
    table = materialize(word_scores(words, pieces, model), "lm-words")

    def base(count):
        return np.log10((count + 1) / (n_all + distinct + 1))

    top = _frequent(table, frequent)
    known = dict(zip(top.column("word").cast(pa.binary()).to_pylist(), range(top.num_rows)))
    n = np.append(top.column("n").to_numpy(), 0)
    values = np.column_stack([n > 0, base(n), np.append(top.column("z").to_numpy(), 0), np.append(top.column("prior").to_numpy(), 0)])
    values[-1] = 0  # words that are not among these
    shared = docs.sparkSession.sparkContext.broadcast((known, values))
    end_prior = math.log10((ends + 1) / (n_all + 1)) if n_all else math.log10(0.5)
    end_row = (float(ends > 0), float(base(ends)), end / math.log(10), end_prior)
    id_type = dict(slim.dtypes)["id"]
    names = ["id", "held", "n_tokens", "known", "base", "z", "prior", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rows = shared.value
        get = index.get
        nowhere = len(rows) - 1
        for batch in batches:
            for part in slices(batch, 2, 1 << 21):
                sums, n_tokens, rare, often, ends_at = np.zeros((part.num_rows, 4)), [], [], [], [0]
                for i, data in enumerate(contents(part, 2)):
                    others, n = Counter(), 1
                    for found in word_blocks((data or b"").lower()):
                        at = np.array([get(w, nowhere) for w in found], np.int64)
                        sums[i] += rows[at].sum(axis=0)
                        n += len(found)
                        others.update([found[k] for k in np.flatnonzero(at == nowhere)])
                    sums[i] += end_row
                    n_tokens.append(n)
                    rare += others
                    often += others.values()
                    ends_at.append(len(rare))
                words = pa.array(rare, pa.binary()).cast(pa.string())
                rest = pa.StructArray.from_arrays([words, pa.array(often, pa.int32())], ["word", "tf"])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(n_tokens, pa.int64()), pa.array(np.rint(sums[:, 0]).astype(np.int64)),
                        *(pa.array(sums[:, k]) for k in (1, 2, 3)), pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), rest),
                    ],
                    names,
                )

    schema = (
        f"id {id_type}, held boolean, n_tokens bigint, known bigint, base double, z double, prior double,"
        " rest array<struct<word:string,tf:int>>"
    )
    scored = slim.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    scored = materialize(scored, "lm-scored")
    rare = scored.select("row", F.explode("rest").alias("r")).select("row", "r.*")
    tf = F.col("tf")
    joined = rare.join(table, "word").select(
        "row",
        F.when(F.col("n") > 0, tf).otherwise(0).cast("long").alias("known"),
        (tf * F.log10((F.col("n") + 1) / F.lit(float(n_all + distinct + 1)))).alias("base"),
        (tf * F.col("z")).alias("z"),
        (tf * F.col("prior")).alias("prior"),
    )
    sums = ["known", "base", "z", "prior"]
    own = scored.select("row", "id", "held", "n_tokens", *sums)
    joined = joined.groupBy("row").agg(*[F.sum(c).alias(c) for c in sums])
    both = own.unionByName(joined, allowMissingColumns=True).groupBy("row").agg(
        F.max("id").alias("id"), F.max("held").alias("held"), F.max("n_tokens").alias("n_tokens"), *[F.sum(c).alias(c) for c in sums]
    )
    return both.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", F.col("known").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("z").alias("score"),
        F.col("prior").alias("prior_score"),
    )


def op6_lm(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
