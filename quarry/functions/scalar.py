"""Addresses, sizes and durations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_url(doc_id: Column, prefix: str = "/doc/") -> Column:
    return F.concat(F.lit(prefix), doc_id.cast("string"))


def path_url(title: Column) -> Column:
    """A file name `n/host_path` back to its address."""
    return F.concat(F.lit("https://"), F.translate(F.substring(title, 3, 1 << 30), "_", "/"))


def varint_bytes(n: Column) -> Column:
    """Bytes of a whole number in the index encoding: one up to 127, else a
    length byte and the significant bytes."""
    return F.when(n <= 127, 1).otherwise(1 + F.ceil(F.length(F.hex(n)) / 2)).cast("long")


def milliseconds(seconds: Column) -> Column:
    """A duration cut to whole milliseconds."""
    return F.floor(seconds * 1000) / 1000


def human_bytes(n: Column) -> Column:
    """A size in SI units, one decimal below ten of a unit."""
    units = ["B", "kB", "MB", "GB", "TB", "PB", "EB"]
    power = F.least(F.lit(6), F.floor(F.log10(F.greatest(n, F.lit(1)).cast("double")) / 3 + 1e-12)).cast("int")
    value = n / F.pow(F.lit(1000.0), power)
    unit = F.element_at(F.array(*map(F.lit, units)), power + 1)
    shown = F.when((power == 0) | (F.round(value, 1) >= 10), F.format_string("%.0f", value)).otherwise(F.format_string("%.1f", value))
    return F.concat(shown, F.lit(" "), unit)
