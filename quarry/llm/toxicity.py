"""Toxicity by a classifier chain.

Categories are predicted in order.  The model of a category is linear in the
presence of hashed words and in the probabilities that the chain gave to the
categories before it.  In training those probabilities are out-of-fold: each
labelled document gets them from models that have not seen it, so that a later
model learns how far an earlier one can be trusted.  A word has to keep its
evidence by itself: of the hashed words a model uses the ``features`` with the
highest chi-square on its training rows.

Bounds.  The models are fitted on the driver on at most ``train_rows`` labelled
documents, those with the smallest hash of their id, one row an id; what is
collected of each is its set of hashed words, of more than ``train_words`` those
with the smallest hashes (262 MB at most by default).  Scoring runs over all
words of all documents with a broadcast of ``2 ** bits`` weights a category,
whatever the corpus.  The order of the input changes nothing.

Defined cases: a null text counts as empty; labels that are null, contradictory
(one id with two labels: the larger counts) or without a document are handled
or left out; of documents with one id that with the smallest hash of its text is
learned from; with fewer than two classes in a category its probability is the
share seen (0 without labels); repeated rows are scored alike; an empty table
gives an empty result; further columns are kept, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quarry.llm.batches import contents, slices
from quarry.llm.rows import everything, mapped
from quarry.runtime import column, fresh, materialize

BITS = 20
FEATURES = 128
FOLDS = 5
TRAIN_ROWS = 8000
TRAIN_WORDS = 8192
THRESHOLD = 0.5

#: ASCII letters to lower case, bytes of other letters as they are, all else to a space.
_LETTERS = bytes(
    b | 32 if chr(b).isalpha() and b < 128 else (b if b >= 128 else 32) for b in range(256)
)


def hashed_words(data: bytes, bits: int = BITS) -> np.ndarray:
    """The distinct hashed words of a UTF-8 text, sorted."""
    words = set(data.translate(_LETTERS).split())
    hashes = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & np.uint32((1 << bits) - 1)
    return np.unique(hashes).astype(np.int32)


@dataclass
class Linear:
    """A logistic model over selected hashed words and earlier probabilities."""

    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def logits(self, sums: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return sums + earlier @ self.earlier + self.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _select(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, size: int, features: int) -> np.ndarray:
    """The words with the highest chi-square between presence and class."""
    n, positive = len(y), y.sum()
    df = np.bincount(cols, minlength=size).astype(float)
    both = np.bincount(cols, weights=y[rows], minlength=size)
    expected = df * positive / n
    spread = expected * (1 - positive / n) * (1 - df / n)
    chi = np.where((df >= 3) & (spread > 0), (both - expected) ** 2 / np.maximum(spread, 1e-9), 0)
    best = np.argsort(-chi, kind="stable")[:features]
    return np.sort(best[chi[best] > 0])


def fit_linear(docs: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, bits: int = BITS, features: int = FEATURES, l2: float = 1e-4, steps: int = 400) -> Linear:
    """Logistic regression with L2, by accelerated gradient descent."""
    n, positive = len(y), float(y.sum()) if len(y) else 0.0
    share = (positive + 0.5) / (n + 1) if n else 0.0
    if not n or positive in (0, n):
        share = positive / n if n else 0.0
        return Linear(np.empty(0, np.int64), np.empty(0), np.zeros(earlier.shape[1]), float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))))
    rows = np.repeat(np.arange(n), [len(d) for d in docs])
    cols = np.concatenate(docs) if len(rows) else np.empty(0, np.int32)
    words = _select(rows, cols, y, 1 << bits, features)
    place = np.full(1 << bits, -1, np.int32)
    place[words] = np.arange(len(words))
    use = place[cols] >= 0
    x = np.zeros((n, len(words) + earlier.shape[1]), np.float32)
    x[rows[use], place[cols[use]]] = 1
    x[:, len(words) :] = earlier
    w = np.zeros(x.shape[1], np.float32)
    v, bias, vb = w.copy(), float(np.log(share / (1 - share))), 0.0
    # the curvature's bound, by power iteration, gives the step
    u = np.ones(x.shape[1], np.float32)
    for _ in range(12):
        u = x.T @ (x @ u)
        u /= max(float(np.linalg.norm(u)), 1e-12)
    rate = 1 / (0.25 * (float(u @ (x.T @ (x @ u))) / n + 1) + l2)
    for k in range(steps):
        m = k / (k + 3)
        look, lb = w + m * v, bias + m * vb
        error = (_sigmoid(x @ look + lb) - y).astype(np.float32)
        new, nb = look - rate * (x.T @ error / n + l2 * look), lb - rate * float(error.mean())
        v, w, vb, bias = new - w, new, nb - bias, nb
    return Linear(words, w[: len(words)].astype(float), w[len(words) :].astype(float), bias)


def _score(model: Linear, docs: list[np.ndarray], earlier: np.ndarray, bits: int) -> np.ndarray:
    table = np.zeros(1 << bits)
    table[model.words] = model.weights
    sums = np.array([table[d].sum() for d in docs]) if docs else np.empty(0)
    return _sigmoid(model.logits(sums, earlier))


def fit_chain(docs: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, bits: int = BITS, features: int = FEATURES, n_folds: int = FOLDS, **options) -> list[Linear]:
    """A model for each column of ``labels``; earlier columns feed later ones out of
    fold. ``options`` are those of ``fit_linear``."""
    chain, earlier = [], np.zeros((len(docs), 0))
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        chain.append(fit_linear(docs, earlier, y, bits, features, **options))
        if c + 1 == labels.shape[1]:
            break
        out = np.zeros(len(docs))
        for f in range(n_folds):
            held = folds == f
            if held.any():
                kept = [d for d, h in zip(docs, held) if not h]
                model = fit_linear(kept, earlier[~held], y[~held], bits, features, **options)
                out[held] = _score(model, [d for d, h in zip(docs, held) if h], earlier[held], bits)
        earlier = np.column_stack([earlier, out])
    return chain


def chosen(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str, text: str, train_rows: int) -> DataFrame:
    """``(id, order, text, y0, y1, ...)``, one row an id: at most ``train_rows``
    labelled documents, those with the smallest hash of their id.  Of the rows with
    one id that with the smallest hash of its text is taken.  Which these are is
    decided on ids and hashes; only their texts move, once an id."""
    marked = (
        labels.select(column(id_col).alias("id"), *[c.cast("int").alias(f"y{k}") for k, c in enumerate(categories.values())])
        .na.drop().groupBy("id").agg(*[F.max(f"y{k}").alias(f"y{k}") for k in range(len(categories))])
        .withColumn("order", F.xxhash64("id"))
    )
    texts = docs.select(column(id_col).alias("id"), F.coalesce(column(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    first = texts.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("hash").alias("hash"))
    picked = materialize(first.join(marked, "id").orderBy("order", "id").limit(train_rows), "toxicity-picked")
    # at most `train_rows` rows of some numbers; equal texts become one before they are dealt out
    return texts.join(F.broadcast(picked), ["id", "hash"]).groupBy(*picked.columns).agg(F.min("text").alias("text")).drop("hash")


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS, bits: int = BITS, features: int = FEATURES, train_words: int = TRAIN_WORDS) -> list[Linear]:
    """Fit the chain for ``categories`` (name to a boolean column of ``labels``)
    on at most ``train_rows`` labelled documents of at most ``train_words`` words each."""
    rows = chosen(docs, labels, categories, id_col, text, train_rows)
    n = len(categories)
    ys = [f"y{k}" for k in range(n)]
    at = rows.columns.index("text")
    schema = f"id {dict(rows.dtypes)['id']}, order bigint, words array<int>, " + ", ".join(f"{y} int" for y in ys)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in slices(batch, at)):
            col = lambda name: b.column(b.schema.get_field_index(name))  # noqa: E731, B023
            found = [hashed_words(t, bits)[:train_words] for t in contents(b, at)]
            yield pa.RecordBatch.from_arrays(
                [col("id"), col("order"), pa.array(found, pa.list_(pa.int32())), *map(col, ys)], ["id", "order", "words", *ys]
            )

    got = rows.mapInArrow(words_of, schema).toArrow().combine_chunks().sort_by([("order", "ascending"), ("id", "ascending")])
    words = got.column("words").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    docs_ = np.split(words.flatten().to_numpy(), np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))[:-1]) if got.num_rows else []
    y = np.column_stack([got.column(c).to_numpy() for c in ys]) if got.num_rows else np.zeros((0, n))
    folds = (got.column("order").to_numpy().astype(np.int64) >> 7) % FOLDS if got.num_rows else np.zeros(0, int)
    return fit_chain(docs_, y, folds, bits, features)


def predict(docs: DataFrame, chain: list[Linear], names: list[str], text: str = "text", bits: int = BITS) -> DataFrame:
    """``docs`` with a probability column for each of ``names``, in chain order."""
    table = np.zeros((1 << bits, len(chain)), np.float32)
    for c, model in enumerate(chain):
        table[model.words, c] = model.weights
    shared = docs.sparkSession.sparkContext.broadcast((table, [(m.earlier, m.bias) for m in chain]))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        weights, tails = shared.value
        for batch in (p for b in batches for p in slices(b, at)):
            sums = np.zeros((batch.num_rows, len(tails)))
            for i, t in enumerate(contents(batch, at)):
                if t:
                    sums[i] = weights[hashed_words(t, bits)].sum(axis=0, dtype=np.float64)
            p = np.zeros((batch.num_rows, 0))
            for c, (earlier, bias) in enumerate(tails):
                p = np.column_stack([p, _sigmoid(sums[:, c] + p @ earlier + bias)])
            yield batch, [pa.array(p[:, c]) for c in range(len(tails))]

    return mapped(docs, dict.fromkeys(names, DoubleType()), run)


def categories() -> dict[str, Column]:
    """The chain over the label table: poor text first, toxicity after it."""
    return {"p_low_quality": F.col("quality") == 0, "p_toxic": F.col("toxic") == 1}


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chain = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), categories())
    scored = predict(docs, chain, list(categories()))
    return scored.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= THRESHOLD).alias("toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those predicted toxic."""
    names = [fresh(docs.columns, n) for n in categories()]
    scored = predict(docs, train(docs, labels, categories()), names)
    return scored.filter(F.col(names[-1]) < threshold).select(*everything(docs))
