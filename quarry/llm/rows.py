"""Names for rows, so that a decision made on a few columns finds its row again,
and names for columns, so that none of a table's own is lost or mistaken.

Every operator here takes tables with any columns: names are taken literally
(dots and all), what is added inside has a name that no column has, and a column
that is called like one of an operator's outputs is kept as ``<name>_input``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from quarry.runtime import column, fresh, materialize


def everything(docs: DataFrame) -> list[F.Column]:
    return [column(c) for c in docs.columns]


def roomed(docs: DataFrame, *outputs: str) -> DataFrame:
    """``docs`` with columns that are called like an output under another name."""
    low = {o.lower() for o in outputs}
    if not any(c.lower() in low for c in docs.columns):
        return docs
    names: list[str] = []
    for c in docs.columns:
        taken = c.lower() in low
        names.append(fresh([*docs.columns, *names, *outputs], f"{c}_input") if taken else c)
    return docs.toDF(*names)


def mapped(docs: DataFrame, added: dict[str, DataType], function: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]], without: int | None = None) -> DataFrame:
    """``docs`` with the columns ``added``: ``function`` takes record batches and
    yields parts of them, each with the arrays to be added.  The column at ``without``
    goes.  Columns have plain names on the way, so that theirs may be anything."""
    docs = roomed(docs, *added)
    fields = docs.schema.fields
    kept = [i for i in range(len(fields)) if i != without]
    names = [*[f"c{i}" for i in kept], *[f"a{k}" for k in range(len(added))]]
    types = [*[fields[i].dataType for i in kept], *added.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, columns in function(batches):
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], *columns], names)

    plain = docs.toDF(*[f"c{i}" for i in range(len(fields))])
    out = plain.mapInArrow(run, StructType([StructField(n, t) for n, t in zip(names, types)]))
    return out.toDF(*[fields[i].name for i in kept], *added)


def addressed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a text column, and its name: a row's file and its place in
    it.  It is the same in every scan, unlike a number given while reading.  A
    frame that isn't read from files is written first."""
    key = fresh(docs.columns, "address")
    try:
        return _with_key(docs, key), key
    except AnalysisException:
        return _with_key(materialize(docs, "rows"), key), key


def _with_key(docs: DataFrame, key: str) -> DataFrame:
    place = docs.metadataColumn("_metadata")
    return docs.withColumn(key, F.concat_ws(":", F.xxhash64(place["file_path"]), place["row_index"]))


def matched(docs: DataFrame, keyed: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join addressed rows with what was decided about them. Both sides grow with
    the corpus, so both are dealt out by key whatever their size here."""
    return docs.join(keyed.hint("merge"), key, how)
