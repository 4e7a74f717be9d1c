"""SentencePiece encoding and decoding.

Encoding.  A space becomes a marker, one marker goes in front, and the text is
cut into chunks that no piece reaches out of (a run of markers with what
follows it, or a line break).  Each distinct chunk is cut by a unigram Viterbi
over a double-array trie, many chunks at once; a character that is no piece
becomes its byte pieces.  A task keeps the cuts of recent chunks, up to
``CACHE`` of them.

Decoding.  Pieces and byte pieces are joined to bytes, markers become spaces,
and the marker in front goes.  Decoding gives every text back exactly, literal
marker characters included (they are written as bytes).

Defined cases: a null text has null ids and decodes to null; an empty text has
no pieces; very long texts are cut whole, a section at a time, and so are very
long words (``subword``); ids that the vocabulary doesn't have raise an error,
control pieces decode to nothing; repeated rows are repeated; an empty table
gives an empty result; further columns are kept, one that is called like an
output as ``<name>_input``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType

from quarry.llm.batches import contents, slices
from quarry.llm.rows import mapped
from quarry.llm.subword import BATCH_BYTES, SECTION, Vocabulary, check_vocabulary, chunks, cut, load, model_path, sections

CACHE = 1 << 18
CACHE_BYTES = 1 << 25


class Encoder:
    """Texts to ids, with the cuts of recent chunks kept, up to ``CACHE`` chunks and ``CACHE_BYTES``."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.cuts, self.held = vocabulary, {}, 0

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        short = [t if len(t) <= SECTION else b"" for t in texts]
        ids = self._encode([chunks(t) if t else [] for t in short])
        return [i if len(t) <= SECTION else self._long(t) for i, t in zip(ids, texts)]

    def _long(self, text: bytes) -> np.ndarray:
        """A long text, a section at a time."""
        return np.concatenate([self._encode([chunks(part, head=k == 0)])[0] for k, part in enumerate(sections(text))])

    def _encode(self, split: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.cuts) > CACHE or self.held > CACHE_BYTES:
            self.cuts, self.held = {}, 0
        new, size = [], 0
        for chunk in dict.fromkeys(c for cs in split for c in cs if c not in self.cuts):
            new.append(chunk)
            size += len(chunk)
            if size > BATCH_BYTES:
                self._cut(new)
                new, size = [], 0
        if new:
            self._cut(new)
        get = self.cuts.__getitem__
        return [np.frombuffer(b"".join(map(get, cs)), np.int32) for cs in split]

    def _cut(self, new: list[bytes]) -> None:
        for chunk, ids in zip(new, cut(new, self.v)):
            self.cuts[chunk] = ids.tobytes()
            self.held += len(chunk) + ids.nbytes


def decode(ids: np.ndarray, shown: list[bytes]) -> bytes:
    parts = [b"".join(map(shown.__getitem__, ids[i : i + SECTION].tolist())) for i in range(0, len(ids), SECTION)]
    out = b"".join(parts)
    return out[1:] if out[:1] == b" " else out


def _shown(v: Vocabulary) -> list[bytes]:
    """What each id decodes to; control pieces to nothing."""
    real = {*v.normal.tolist(), *v.byte_ids.tolist()}
    return [s if i in real else b"" for i, s in enumerate(v.shown)]


def _lists(ids: list[np.ndarray], texts: list[bytes | None]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
    values = np.concatenate(ids) if ids else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([t is None for t in texts], pa.bool_()))


def _shared(spark: SparkSession, model: str | None):
    v = load(model or model_path(spark))
    check_vocabulary(v)
    v.trie  # noqa: B018  built once, here
    return spark.sparkContext.broadcast((v, _shown(v)))


def encode(docs: DataFrame, text: str = "text", out: str = "ids", model: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text`` in a column ``out``."""
    shared, at = _shared(docs.sparkSession, model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        encoder = Encoder(shared.value[0])
        for part in (p for b in batches for p in slices(b, at)):
            texts = contents(part, at)
            yield part, [_lists(encoder.encode([t or b"" for t in texts]), texts)]

    return mapped(docs, {out: ArrayType(IntegerType())}, run)


def decoded(rows: DataFrame, ids: str = "ids", out: str = "decoded", model: str | None = None) -> DataFrame:
    """``rows`` with the text that ``ids`` stand for in a column ``out``."""
    shared, at = _shared(rows.sparkSession, model), rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        shown = shared.value[1]
        for batch in batches:
            lists = batch.column(at)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            texts = [
                decode(values[a:b], shown).decode("utf-8", "replace") if ok else None
                for a, b, ok in zip(offsets, offsets[1:], valid)
            ]
            yield batch, [pa.array(texts, pa.string())]

    return mapped(rows, {out: StringType()}, run)


def with_round_trip(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """``docs`` without ``text``, with ``ids`` and ``exact``: whether decoding
    the ids gave the text back. Both ways in one pass over the texts."""
    shared, at = _shared(docs.sparkSession, model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        vocabulary, shown = shared.value
        encoder = Encoder(vocabulary)
        for part in (p for b in batches for p in slices(b, at)):
            texts = contents(part, at)
            ids = encoder.encode([t or b"" for t in texts])
            exact = [decode(i, shown) == (t or b"") for i, t in zip(ids, texts)]
            yield part, [_lists(ids, texts), pa.array(exact, pa.bool_())]

    return mapped(docs, {"ids": ArrayType(IntegerType()), "exact": BooleanType()}, run, without=at)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_round_trip(docs).select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids", "exact")
