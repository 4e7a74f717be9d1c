r"""Quality rules: a threshold table compiled into one Spark projection.

Signals.  Lengths, symbols, repeated lines and words in repeated windows are
built from string and array functions.  Words of a text that lie in 5-word
windows found twice or more: each window becomes a 64-bit hash; if all hashes
of the text differ the answer is 0, else the hashes are sorted with their
positions, neighbours of equal hash are the repeats, and their windows' union
is summed from the sorted positions.  The chance that two different windows of
one text share a hash is under n*n / 2**65.

Rules.  A row of ``RULES`` names a signal, the bounds it must keep within, and
the number of words from which it applies (a ratio says little about a very
short text).  The table is compiled into one boolean expression for each rule
and one conjunction, evaluated without user functions.

Defined cases: a null text has no words and fails the base rules; very long
texts are handled whole; repeated rows are judged alike; an empty table gives
an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.rows import everything

WINDOW = 5
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "".join(map(chr, range(65, 91)))
#: ASCII digits and punctuation.
NOT_LETTERS = "".join(c for c in map(chr, range(33, 127)) if not c.isalpha())

#: Frequent function words of four languages.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "are", "by", "this", "be", "at", "a"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "dans", "pour", "au", "sur", "par", "avec"],
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "ist", "auf", "für", "ein", "eine", "nicht", "im", "des"],
    "es": ["el", "la", "los", "las", "de", "y", "en", "que", "un", "una", "por", "con", "para", "se", "del", "es", "al"],
}


@dataclass(frozen=True)
class Rule:
    name: str
    signal: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The threshold table.
RULES = (
    Rule("word_length", "mean_word", low=2.0, high=14.0, from_words=10),
    Rule("symbols_per_word", "symbol_ratio", high=0.25),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("bullet_lines", "bullet_ratio", high=0.9),
    Rule("cut_lines", "ellipsis_ratio", high=0.3),
    Rule("stop_words", "stop_ratio", low=0.01, from_words=80),
    Rule("letters", "letter_ratio", low=0.5),
    Rule("shouting", "shout_ratio", high=0.3),
)


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as a struct ``doc``, with counts and ratios of ``text`` beside it.

    Arrays that lambdas look into are columns of a projection of their own and
    used more than once there, so the optimizer doesn't move them into the lambda."""
    whole = docs.select(
        F.struct(*everything(docs)).alias("doc"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"),
    )
    trimmed = F.btrim("body", F.lit(SPACES))
    split = whole.select(
        "doc",
        "body",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN)).alias("words"),
        F.filter(F.split("body", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("lines"),
        F.translate("body", SPACES, "").alias("packed"),
    )
    without = lambda c, drop: F.length(c) - F.length(F.translate(c, drop, ""))
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    n = F.size("words")
    windows = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), n - (WINDOW - 1)),
            lambda i: F.xxhash64(*[F.element_at("words", i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        "doc",
        n.cast("long").alias("n_words"),
        F.length("packed").cast("long").alias("word_chars"),
        without("packed", SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•", "‣", "–"))).alias("bullets"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("ellipses"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(stop))).alias("stops"),
        (F.length("packed") - without("packed", NOT_LETTERS)).alias("letters"),
        without("packed", CAPITALS).alias("capitals"),
        windows.alias("windows"),
    )
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    placed = counted.withColumn(
        "placed",
        F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("windows")
    here = lambda k: F.get("placed", k)["h"]
    shared = F.transform(
        "placed",
        lambda p, k: F.when((p["h"] == here(k - 1)) | (p["h"] == here(k + 1)), p["i"]),
    )
    found = placed.withColumn("found", F.array_sort(F.filter(shared, lambda i: i.isNotNull()))).drop("placed")
    gap = F.zip_with(
        "found", F.slice("found", F.lit(2), F.size("found")),
        lambda here, after: F.least(F.lit(WINDOW), F.coalesce(after - here, F.lit(WINDOW))),
    )
    covered = F.when(F.size("found") > 0, F.aggregate(gap, F.lit(0), lambda a, b: a + b)).otherwise(0)
    ratio = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    return found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).select(
        "doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ratio("word_chars", "n_words").alias("mean_word"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("bullets", "n_lines").alias("bullet_ratio"),
        ratio("ellipses", "n_lines").alias("ellipsis_ratio"),
        ratio("stops", "n_words").alias("stop_ratio"),
        ratio("letters", "word_chars").alias("letter_ratio"),
        ratio("capitals", "word_chars").alias("shout_ratio"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one expression: an array of the names of the broken rules."""
    broken = []
    for rule in rules:
        value, bad = F.col(rule.signal), F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        broken.append(F.when((F.col("n_words") >= rule.from_words) & bad, F.lit(rule.name)))
    return F.array_compact(F.array(*broken))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``signals`` with ``base_failed``, ``broken`` (names of rules) and ``kept``."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = signals(docs, text).withColumn("base_failed", failed).withColumn("broken", verdict(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.array_join("broken", ",").alias("broken"),
    )


def oracle() -> str:
    """The same table in DuckDB SQL; the rules are compiled from ``RULES`` here too."""
    stop = ", ".join("'" + w + "'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))
    checks = []
    for r in RULES:
        bad = " OR ".join(
            [f"{r.signal} < {r.low}"] * (r.low is not None) + [f"{r.signal} > {r.high}"] * (r.high is not None)
        )
        checks.append(f"CASE WHEN n_words >= {r.from_words} AND ({bad}) THEN '{r.name}' END")
    return rf"""
WITH base AS (
  SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS body,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS packed
  FROM documents),
windows AS (
  SELECT row, i, array_to_string(words[i:i + 4], ' ') AS w
  FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM base)),
twice AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, w) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT row, count(DISTINCT p)::BIGINT AS n FROM (SELECT row, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY row),
counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(packed)::BIGINT AS word_chars,
    length(regexp_replace(packed, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
    len(list_filter(lines, lambda x: ltrim(x, ' ')[1] IN ('-', '*', '•', '‣', '–'))) AS bullets,
    len(list_filter(lines, lambda x: suffix(rtrim(x, ' '), '...') OR suffix(rtrim(x, ' '), '…'))) AS ellipses,
    len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS stops,
    length(regexp_replace(packed, '[\x21-\x40\x5B-\x60\x7B-\x7E]+', '', 'g')) AS letters,
    length(regexp_replace(packed, '[^A-Z]+', '', 'g')) AS capitals,
    coalesce(n, 0) AS n_repeat_words
  FROM base LEFT JOIN repeated USING (row)),
ratios AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word, n_symbols / greatest(n_words, 1) AS symbol_ratio,
    n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, bullets / greatest(n_lines, 1) AS bullet_ratio,
    ellipses / greatest(n_lines, 1) AS ellipsis_ratio, stops / greatest(n_words, 1) AS stop_ratio,
    letters / greatest(word_chars, 1) AS letter_ratio, capitals / greatest(word_chars, 1) AS shout_ratio
  FROM counted),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    list_filter([{", ".join(checks)}], lambda x: x IS NOT NULL) AS rules
  FROM ratios)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND len(rules) = 0 AS kept, coalesce(array_to_string(rules, ','), '') AS broken
FROM judged
"""
