"""Tokenisers and filters, as column expressions.

Two classes of tokens exist.  Query tokens are runs of Unicode letters and
numbers.  Fielded tokens also hold apostrophes, hyphens and slashes and take
decimal digits only, so `EL/1` or `fault-tolerant` is one fielded token that no
query can name; the fielded profile keeps that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.stem import stem_array

QUERY_TOKEN = r"[\p{L}\p{N}]+"
FIELDED_TOKEN = r"[\p{L}\p{Nd}'/-]+"
STOP_SAMPLE = ("the", "of", "and", "to", "in", "is", "for", "with", "on", "by", "de", "la", "le", "et", "der", "die", "und", "el", "en")


def query_tokens(text: Column) -> Column:
    """The letter-or-number runs of a text, in order."""
    return F.regexp_extract_all(text, F.lit(QUERY_TOKEN), F.lit(0))


def fielded_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FIELDED_TOKEN), F.lit(0))


def space_tokens(text: Column) -> Column:
    """Space-separated words of a pre-tokenised page; one final line break is no part of the last."""
    return F.filter(F.split(F.regexp_replace(text, "\n$", ""), " +"), lambda w: w != "")


def path_tokens(title: Column) -> Column:
    """Words of a page's file name; the part before the first underscore (the host) is none."""
    parts = F.split(title, "_")
    return F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda w: w != "")


def long_enough(term: Column, least: int = 3) -> Column:
    """Terms under three bytes (not characters) are not indexed in the fielded profile."""
    return F.octet_length(term) >= least


@dataclass(frozen=True)
class Profile:
    """How a corpus is cut into terms.

    ``stop`` words go before stemming.  ``drop_short`` drops terms of one or two
    bytes.  ``lowercase`` is off only to reproduce an index without case folding.
    """

    name: str = "default"
    fielded: bool = False
    lowercase: bool = True
    drop_short: bool = False
    stop: tuple[str, ...] = ()
    stem: bool = False

    def array(self, text: Column) -> Column:
        text = F.lower(text) if self.lowercase else text
        return fielded_tokens(text) if self.fielded else query_tokens(text)

    def keeps(self, term: Column) -> Column | None:
        """The condition under which a token is indexed, None if all are."""
        kept = long_enough(term) if self.drop_short else None
        if self.stop:
            free = ~term.isin(*self.stop)
            kept = free if kept is None else kept & free
        return kept

    def terms(self, text: Column) -> Column:
        """The indexed terms of a text, in order: filtered, then stemmed."""
        found = self.array(text)
        if self.keeps(F.lit("")) is not None:
            found = F.filter(found, self.keeps)
        return stem_array()(found) if self.stem else found

    def tokens(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``(doc_id, pos, term)`` of all tokens, before filters."""
        return docs.select("doc_id", F.posexplode(self.array(F.col(text))).alias("pos", "term")).withColumn(
            "pos", F.col("pos").cast("long")
        )


DEFAULT = Profile()
FIELDED = Profile("fielded", fielded=True, drop_short=True, stop=STOP_SAMPLE, stem=True)
