"""Media columns: texts as progressive JPEG files, and RGB tensors from such files.

A text's bytes, filled up with 255 to a positive multiple of 576, are stored
losslessly as coefficients of a progressive 4:2:0 file (``jpeg.py``), the
format's unit, since its samples are not lossless.  Reading gathers the scans
into coefficient arrays, takes the payload from them, inverse-transforms them,
repeats chroma to full resolution, and gives the RGB tensor, which is stored in
a column, and its features.  A slice of texts is coded and read together.

Defined cases: a null text counts as empty (one block of fill); a null or broken
file raises an error in ``decode_media`` unless ``skip_broken`` is set, which
gives nulls; equal texts give equal files and features; repeated rows are
repeated; an empty table gives an empty result; further columns are kept, one
that is called like an output as ``<name>_input``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, IntegerType, StringType

from quarry.llm import jpeg
from quarry.llm.batches import contents, slices
from quarry.llm.rows import mapped
from quarry.runtime import column

UNIT = 576
SLICE = 1 << 20
BROKEN = (ValueError, IndexError, KeyError, StopIteration, struct.error)
TENSOR = (pa.int32(), pa.int32(), pa.binary(), pa.string())
FILL = b"\xff"


def payload_of(data: bytes) -> bytes:
    return data + FILL * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def features(rgb: np.ndarray) -> str:
    """Size, channel means, contrast, and a 64-bit average hash of the brightness."""
    h, w, _ = rgb.shape
    means = rgb.reshape(-1, 3).mean(axis=0, dtype=np.float64)
    green = rgb[:, :, 1]
    rows = np.add.reduceat(green, np.arange(8) * h // 8, axis=0, dtype=np.int64)
    cells = np.add.reduceat(rows, np.arange(8) * w // 8, axis=1)
    share = np.outer(np.diff(np.append(np.arange(8) * h // 8, h)), np.diff(np.append(np.arange(8) * w // 8, w)))
    bright = (cells * (h * w) > share * int(cells.sum())).reshape(-1)
    code = np.packbits(bright).tobytes().hex()
    histogram = np.bincount(green.reshape(-1), minlength=256)
    extremes = (int(histogram[0]) + int(histogram[255])) / green.size
    return f"{w}x{h} rgb={means[0]:.1f},{means[1]:.1f},{means[2]:.1f} clipped={extremes:.3f} ahash={code}"


def encode_media(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """``docs`` with the file of each text in a column ``out``."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for part in (p for b in batches for p in slices(b, at, SLICE)):
            files = jpeg.encode_many([payload_of(v or b"") for v in contents(part, at)])
            yield part, [pa.array(files, pa.binary())]

    return mapped(docs, {out: BinaryType()}, run)


def _images(files: list[bytes | None], skip_broken: bool) -> list[jpeg.Image | None]:
    """The images of some files; one by one if there is a broken one among them."""
    try:
        return jpeg.decode_many([f or b"" for f in files])
    except BROKEN:
        if not skip_broken:
            raise
    found = []
    for f in files:
        try:
            found.append(jpeg.decode(f or b""))
        except BROKEN:
            found.append(None)
    return found


def decode_media(rows: DataFrame, media: str = "media", skip_broken: bool = False) -> DataFrame:
    """``rows`` with ``width``, ``height``, ``rgb`` (height * width * 3 bytes in
    rows) and ``feature`` of each file in the column ``media``."""
    at = rows.columns.index(media)
    types = {"width": IntegerType(), "height": IntegerType(), "rgb": BinaryType(), "feature": StringType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for part in (p for b in batches for p in slices(b, at, SLICE)):
            found = []
            for image in _images(contents(part, at), skip_broken):
                rgb = None if image is None else jpeg.pixels(image)
                found.append((None,) * 4 if rgb is None else (rgb.shape[1], rgb.shape[0], rgb.tobytes(), features(rgb)))
            yield part, [pa.array([f[k] for f in found], t) for k, t in enumerate(TENSOR)]

    return mapped(rows, types, run)


def stored(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each text: it is stored as a file, the file is read back, and
    what is told, its tensor included, is of the bytes and pixels that were read."""
    slim = docs.select(column(id_col).alias("id"), column(text).alias("text"))
    kinds = {
        "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
        "media_bytes": pa.int64(), "media_sha256": pa.string(), "width": pa.int32(), "height": pa.int32(), "rgb": pa.binary(),
        "feature": pa.string(),
    }
    spelled = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    schema = f"id {dict(slim.dtypes)['id']}, " + ", ".join(f"{c} {spelled[t]}" for c, t in kinds.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in slices(b, 1, SLICE)):
            texts = [value or b"" for value in contents(batch, 1)]
            files = jpeg.encode_many([payload_of(t) for t in texts])
            found = []
            for data, media, image in zip(texts, files, jpeg.decode_many(files)):
                payload, rgb = jpeg.read_payload(image), jpeg.pixels(image)
                found.append(
                    (
                        len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
                        len(media), hashlib.sha256(media).hexdigest(), rgb.shape[1], rgb.shape[0], rgb.tobytes(), features(rgb),
                    )
                )
            columns = [pa.array(c, t) for c, t in zip(zip(*found), kinds.values())] if found else [pa.array([], t) for t in kinds.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *kinds])

    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op7_media(spark, sf_dir: str) -> DataFrame:
    return stored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
