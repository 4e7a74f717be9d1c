"""The English Snowball stemmer ("Porter2"), from its published description.

Stems are computed inside the row, once for each distinct token of a batch and
mostly once a worker: no join on the token, which a frequent word would make
uneven.  Only tokens of more than three bytes are stemmed.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_BEFORE = "cdeghkmnrt"

#: Words with stems of their own, words that stay, and words that stay after step 1a.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
INVARIANT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}

#: Suffixes of steps 2 to 4, longest match first within a step.
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble",
    "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful",
    "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": "",
}
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]

_REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")


def _regions(word: str) -> tuple[int, int]:
    """Where the two regions begin."""
    head = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if head:
        r1 = len(head)
    else:
        m = _REGION.search(word)
        r1 = m.end() if m else len(word)
    m = _REGION.search(word, r1)
    return r1, m.end() if m else len(word)


def _ends_short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + "wxY"


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in SPECIAL:
        return SPECIAL[word]
    if word in INVARIANT:
        return word
    word = re.sub(f"(^|[{VOWELS}])y", r"\1Y", word)
    r1, r2 = _regions(word)

    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break

    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        word = word[:-1]
    if word in AFTER_1A:
        return word

    # 1b
    for end in ("eedly", "eed"):
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                word = word[: -len(end)] + "ee"
            break
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if word.endswith(end):
                if _has_vowel(word[: -len(end)]):
                    word = word[: -len(end)]
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif word.endswith(DOUBLES):
                        word = word[:-1]
                    elif r1 >= len(word) and _ends_short(word):
                        word += "e"
                break

    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    # 2
    for end, to in STEP2.items():
        if word.endswith(end):
            at = len(word) - len(end)
            fits = at >= r1 and (end != "ogi" or word[at - 1] == "l") and (end != "li" or word[at - 1] in LI_BEFORE)
            if fits:
                word = word[:at] + to
            break

    # 3
    for end, to in STEP3.items():
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= r1 and (end != "ative" or at >= r2):
                word = word[:at] + to
            break

    # 4
    for end in STEP4:
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= r2 and (end != "ion" or word[at - 1] in "st"):
                word = word[:at]
            break

    # 5
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _ends_short(word[:-1])):
            word = word[:-1]
    elif word.endswith("l") and len(word) - 1 >= r2 and word[-2] == "l":
        word = word[:-1]
    return word.replace("Y", "y")


@functools.lru_cache(maxsize=1 << 18)
def term(token: str) -> str:
    """A token's stem, if it is long enough to have one."""
    return stem(token) if len(token.encode()) > 3 else token


def _stems(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in words:
        yield batch.map(term)


def stem_vocabulary(tokens: DataFrame) -> DataFrame:
    """``(token, term)`` for every distinct ``term`` of ``tokens``."""
    return tokens.select(F.col("term").alias("token")).distinct().withColumn(
        "term", F.pandas_udf(_stems, "string")("token")
    )


def _stem_lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for lists in batches:
        words = lists.flatten().dictionary_encode()
        stems = pa.array([term(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        yield pa.ListArray.from_arrays(offsets, stems, mask=lists.is_null())


def stem_array():
    """A function on columns: arrays of tokens to arrays of their stems."""
    return F.arrow_udf(_stem_lists, "array<string>")
