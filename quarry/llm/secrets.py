r"""Secret scans with corpus-wide ownership frequency.

Scan.  Each text is searched for base patterns (assignments, access keys, hex
runs) and for further kinds: private key blocks, signed web tokens, passwords in
addresses, tokens with a service's prefix, and opaque tokens.  Cheap byte tests decide which texts are
given to the regular expressions at all; each is a necessary condition.

Ownership.  Candidate values are hashed, without what only stands beside them
(``identity``), so that one credential has one hash in whatever place it is
found.  For each hash the distinct repositories and owners that hold it are
counted over the whole corpus, of all rows (``all_repositories``,
``all_owners``) and, for the verdict, without copies.  Equal
texts are copies of one document and count as one repository, that of the copy
with the smallest repository (nulls last), then the smallest owner (null first).
With ``copies_once``, as in the query, they also count as that copy's owner only;
without it every owner of a copy counts.  Sums are made by hash and text, by
hash, owner and repository, by hash and owner, then by hash, so that a value
copied into a third of all documents is summed where it is read.  A value held by ``copied_owners``
owners or more, or by ``copied_repositories`` repositories or more whoever owns
them, is a widely copied example; any other is owner-specific and, unless it
looks like a placeholder, live.  Base spans stay whatever their verdict; a
candidate of a further kind is added only if it is live, so that ownership
decides what is added, and only outside the base spans.  Texts that
differ in a byte are two repositories: near copies are not recognised here.

Defined cases: a null text counts as empty; a null owner is an owner, a null
repository a repository; very long texts are searched whole; repeated rows are
repeated in the result and count as one repository; an empty table gives an
empty result; further columns are ignored by ``find_secrets`` and kept by
``redact``, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import contents, slices
from quarry.llm.rows import addressed
from quarry.operators import skew
from quarry.runtime import column, fresh, materialize

COPIED_OWNERS = 3
#: Of values in few sources none has over 4 different texts in the check tables, widely copied ones have 29 or more.
COPIED_REPOSITORIES = 10
#: Random letters and digits change their kind at 0.62 of places, words in camel case at about 0.3.
OPAQUE_CHANGES = 0.4
KINDS = ("assign", "access", "hex", "key", "jwt", "url", "vendor", "token")
BASE_KINDS = 3
COUNTS = ("repositories", "owners", "all_repositories", "all_owners")


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The words that name a secret.
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KEY_BEGIN = re.compile("-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
KEY_END = re.compile("-----END [A-Z ]{0,40}PRIVATE KEY-----")
DOTTED = re.compile(r"[A-Za-z0-9_.-]{26,}")
URL_PASSWORD = re.compile(r"://[^\s/:@]{1,256}:([^\s/@]{6,256})@")
#: What the tokens of some services begin with, and the signs that follow.
VENDOR_TOKENS = {
    "ghp_": "[A-Za-z0-9]{36}", "gho_": "[A-Za-z0-9]{36}", "ghs_": "[A-Za-z0-9]{36}", "github_pat_": "[A-Za-z0-9_]{40,}",
    "glpat-": "[A-Za-z0-9_-]{20,}", "xoxb-": "[A-Za-z0-9-]{20,}", "xoxp-": "[A-Za-z0-9-]{20,}", "sk_live_": "[A-Za-z0-9]{16,}",
    "rk_live_": "[A-Za-z0-9]{16,}", "AIza": "[A-Za-z0-9_-]{35}", "npm_": "[A-Za-z0-9]{36}", "hf_": "[A-Za-z0-9]{30,}",
}
VENDOR = re.compile("(?<![A-Za-z0-9_-])(?:" + "|".join(re.escape(k) + v for k, v in VENDOR_TOKENS.items()) + ")")
_VENDOR_BYTES = tuple(k.encode() for k in VENDOR_TOKENS)
_ADDED_BYTES = (b"PRIVATE KEY-----", b"eyJ", b"://", *_VENDOR_BYTES)
#: Digits 1, upper case 2, lower case 3.
_SIGN_KINDS = bytes(1 if 48 <= b < 58 else 2 if 65 <= b < 91 else 3 for b in range(256))
_NO_SIGNS = b"+/_=-"

_KEY_BYTES = tuple(k.encode() for k in KEYS)
_HEX_MAP = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_TOKEN_MAP = bytes(120 if b < 128 and (chr(b).isalnum() or chr(b) in "+/_=-") else 32 for b in range(256))
_HEX_RUN, _TOKEN_RUN = b"x" * 32, b"x" * 20
#: Parts of values that stand for a secret instead of being one.
PLACEHOLDERS = ("example", "changeme", "placeholder", "dummy", "your", "xxxx", "1234567", "abcdef", "0000000")


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def live_looking(value: str) -> bool:
    """Whether a value is neither a placeholder nor too regular to be a credential."""
    low = value.lower()
    return entropy(value) >= 2.5 and not any(p in low for p in PLACEHOLDERS)


def identity(kind: int, value: str) -> str:
    """The credential in a value whose signs include dots and equal signs: without
    a sentence's dot or padding at its end, and without a name before it."""
    if KINDS[kind] not in ("assign", "token"):
        return value
    bare = value.rstrip(".=")
    last = bare.rpartition("=")[2]
    return last if len(last) >= 8 else bare or value


def _opaque(value: str) -> bool:
    """Whether a value has 4 digits or changes between upper case, lower case and
    digits as often as no words written together do, and is not a number."""
    kinds = np.frombuffer(value.encode().translate(_SIGN_KINDS, _NO_SIGNS), np.uint8)
    digits = np.count_nonzero(kinds == 1)
    if digits == len(value) or entropy(value) < 3.0:
        return False
    return digits >= 4 or np.count_nonzero(kinds[1:] != kinds[:-1]) >= OPAQUE_CHANGES * (len(value) - 1)


def _key_blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """Private keys between their two marker lines."""
    ends = [m.span() for m in KEY_END.finditer(text)]
    begins = [m.start() for m in KEY_BEGIN.finditer(text)]
    for k, start in enumerate(begins):
        e = bisect_left(ends, (start, 0))
        if e < len(ends) and (k + 1 == len(begins) or ends[e][0] < begins[k + 1]):
            yield start, ends[e][1], text[start : ends[e][1]]


def _web_tokens(text: str) -> Iterator[tuple[int, int, str]]:
    """Three parts with dots between, the first two of which begin an encoded JSON object."""
    for m in DOTTED.finditer(text):
        parts, at, k = m[0].split("."), m.start(), 0
        starts = [at := at + len(p) + 1 for p in parts]
        starts = [m.start(), *starts]
        while k + 2 < len(parts):
            head, body, sign = parts[k : k + 3]
            if head.startswith("eyJ") and body.startswith("eyJ") and min(len(head), len(body), len(sign)) >= 8:
                end = starts[k + 2] + len(sign)
                yield starts[k], end, text[starts[k] : end]
                k += 3
            else:
                k += 1


def _added(text: str, data: bytes, tokens: bool) -> Iterator[tuple[int, int, int, str]]:
    """Candidates of the kinds beyond the base, by kind."""
    if b"PRIVATE KEY-----" in data:
        yield from ((3, *x) for x in _key_blocks(text))
    if b"eyJ" in data:
        yield from ((4, *x) for x in _web_tokens(text))
    if b"://" in data:
        yield from ((5, *m.span(1), m[1]) for m in URL_PASSWORD.finditer(text))
    if any(x in data for x in _VENDOR_BYTES):
        yield from ((6, *m.span(), m[0]) for m in VENDOR.finditer(text))
    if tokens:
        yield from ((7, *m.span(), m[0]) for m in TOKEN.finditer(text) if _opaque(m[0]))


class _Inside:
    """Whether a span lies inside one of some others."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [s for s, _ in spans]
        self.ends = list(accumulate((e for _, e in spans), max))

    def __contains__(self, span: tuple[int, int]) -> bool:
        k = bisect_right(self.starts, span[0])
        return k > 0 and self.ends[k - 1] >= span[1]


def scan_text(data: bytes) -> list[tuple[int, int, int, str]]:
    """``(kind, start, end, value)`` of all candidates in a UTF-8 text, by start and
    kind.  A candidate beyond the base that lies inside a base span, or inside a
    candidate of an earlier added kind, is none."""
    low, found = data.lower(), []
    assign, access = any(k in low for k in _KEY_BYTES), b"AKIA" in data
    hexes, tokens = _HEX_RUN in data.translate(_HEX_MAP), _TOKEN_RUN in data.translate(_TOKEN_MAP)
    if not (assign or access or hexes or tokens or any(x in data for x in _ADDED_BYTES)):
        return found
    text = data.decode("utf-8", "replace")
    if assign:
        found += [(0, *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if access:
        found += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if hexes:
        found += [(2, *m.span(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= 32]
    for _, kind in groupby(_added(text, data, tokens), key=itemgetter(0)):
        known = _Inside([(s, e) for _, s, e, _ in found])
        found += [x for x in kind if (x[1], x[2]) not in known]
    found.sort(key=lambda x: (x[1], x[0]))
    return found


_SCHEMA = (
    "id {id}, owner {owner}, row {row}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string,"
    " copy string, found array<struct<kind:int,start:int,end:int,hash:string,plausible:boolean>>"
)
_FOUND = pa.list_(
    pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("plausible", pa.bool_())])
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (p for b in batches for p in slices(b, 3)):
        counts, shas, copies, found = [[], [], []], [], [], []
        for data in contents(batch, 3):
            spans = scan_text(data or b"")
            for k in range(BASE_KINDS):
                counts[k].append(sum(s[0] == k for s in spans))
            base = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, _ in spans if k < BASE_KINDS)
            shas.append(hashlib.sha256(base.encode()).hexdigest())
            copies.append(xxhash.xxh3_128_hexdigest(data) if spans else None)
            found.append(
                [
                    {"kind": k, "start": s, "end": e, "hash": xxhash.xxh3_128_hexdigest(identity(k, v)), "plausible": live_looking(v)}
                    for k, s, e, v in spans
                ]
            )
        columns = [*batch.columns[:3], *(pa.array(c, pa.int64()) for c in counts), pa.array(shas), pa.array(copies, pa.string()), pa.array(found, _FOUND)]
        yield pa.RecordBatch.from_arrays(
            columns, ["id", "owner", "row", "n_assign", "n_access", "n_hex", "base_sha256", "copy", "found"]
        )


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", text: str = "text", row=None) -> DataFrame:
    """A row for each row of ``docs``: its candidates, with counts and the digest of the base spans."""
    slim = docs.select(
        column(repository).alias("id"),
        column(owner).alias("owner"),
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        column(text).alias("text"),
    )
    types = dict(slim.dtypes)
    return slim.mapInArrow(_scan, _SCHEMA.format(id=types["id"], owner=types["owner"], row=types["row"]))


def ownership(scanned: DataFrame, copies_once: bool = False) -> DataFrame:
    """``(hash, repositories, owners, all_repositories, all_owners)`` of every candidate value."""
    held = scanned.select("copy", "owner", "id", F.explode(F.array_distinct("found.hash")).alias("hash"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "owner")).alias("first")
    counts = _holders(held.groupBy("hash", "copy").agg(first).select("hash", "first.owner", "first.id"), "repositories", "owners")
    counts = counts.join(_holders(held, "all_repositories", "all_owners"), "hash")
    return counts if copies_once else counts.withColumn("owners", F.col("all_owners"))


def _holders(held: DataFrame, repositories: str, owners: str) -> DataFrame:
    """The numbers of distinct repositories and owners by hash."""
    return (
        held.groupBy("hash", "owner", "id").agg(F.lit(1).alias("one"))
        .groupBy("hash", "owner").agg(F.count("*").alias(repositories))
        .groupBy("hash").agg(F.sum(repositories).alias(repositories), F.count("*").alias(owners))
    )


def verdicts(scanned: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES, copies_once: bool = False) -> DataFrame:
    """For each row with candidates: ``spans``, an array of ``(start, kind, end,
    live, repositories, owners, all_repositories, all_owners)`` sorted by start and
    kind, with those added candidates that are live."""
    each = scanned.filter(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    specific = (F.col("owners") < copied_owners) & (F.col("repositories") < copied_repositories)
    # a value with a large share of all candidates is judged where these are (``skew``)
    held = each.groupBy("hash").agg(F.count("*").alias("n"))
    known = materialize(ownership(scanned, copies_once).join(held, "hash"), "secrets-owners")
    total = known.agg(F.sum("n")).first()[0] or 0
    judged = skew.joined(each, known, "hash", "n", total).withColumn("live", F.col("plausible") & specific)
    kept = judged.filter((F.col("kind") < BASE_KINDS) | F.col("live"))
    span = F.struct("start", "kind", "end", "live", *COUNTS)
    return kept.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def find_secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source", text: str = "text", copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES, copies_once: bool = False) -> DataFrame:
    """``id``, counts, ``base_sha256``, ``spans`` (text), ``n_live``, ``n_copied``,
    and the numbers of ``repositories`` and ``owners`` of each span's value, without
    copies as the verdict takes them and of all rows, in the order of the spans."""
    scanned = materialize(scan(docs, repository, owner, text), "secrets")
    judged = scanned.filter(F.size("found") > 0).join(verdicts(scanned, copied_owners, copied_repositories, copies_once), "row", "left")
    kind = "array<struct<start:int,kind:int,end:int,live:boolean," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    plain = scanned.filter(F.size("found") == 0).withColumn("spans", F.lit(None).cast(kind))
    names = F.array(*map(F.lit, KINDS))
    shown = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    counted = lambda c: F.array_join(F.transform("spans", lambda s: s[c].cast("string")), ",").alias(c)
    spans = F.coalesce("spans", F.array().cast(kind))
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return (
        judged.select(*plain.columns).unionByName(plain).withColumn("spans", spans)
        .select(
            "id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(F.transform("spans", shown), ",").alias("spans"),
            live.alias("n_live"), (F.size("spans") - live).alias("n_copied"),
            *map(counted, COUNTS),
        )
    )


def redact(docs: DataFrame, repository: str = "doc_id", owner: str = "source", text: str = "text", length: str = "n_chars", mark: str = "[SECRET]", copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES, copies_once: bool = False) -> DataFrame:
    """``docs`` with every live credential replaced by ``mark``; ``length``, if
    it is a column, follows the new text.  Texts without one stay as they are."""
    rows, key = addressed(docs)
    # the rest needs only rows with candidates; gathered, they are a few files instead of one a split of the input
    hits = scan(rows, repository, owner, text, column(key)).filter(F.size("found") > 0)
    scanned = materialize(hits.hint("rebalance"), "secrets")
    marks = fresh(rows.columns, "spans")
    spans = verdicts(scanned, copied_owners, copied_repositories, copies_once).select(
        F.col("row").alias(key), F.filter("spans", lambda s: s["live"]).alias(marks)
    )
    spans = materialize(spans.filter(F.size(marks) > 0), "secrets-live")

    @F.pandas_udf("string")
    def masked(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for body, spans_ in zip(texts, found):
            if body is None:
                out.append(None)
                continue
            parts, at = [], 0
            for start, end in sorted((s["start"], s["end"]) for s in spans_):
                if start >= at:
                    parts += [body[at:start], mark]
                at = max(at, end)
            out.append("".join(parts) + body[at:])
        return pd.Series(out, dtype=object)

    # one join; the texts without a live credential aren't sent to Python
    joined, changed = rows.join(spans, key, "left"), fresh([*rows.columns, marks], "changed")
    hit = F.col(marks).isNotNull()
    done = joined.withColumn(changed, masked(F.when(hit, column(text)), F.col(marks)))
    new = {text: F.when(hit, F.col(changed)).otherwise(column(text))}
    if length in docs.columns:
        new[length] = F.when(hit, F.length(changed)).otherwise(column(length)).cast(docs.schema[length].dataType)
    return done.select(*[new[c].alias(c) if c in new else column(c) for c in docs.columns])


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_secrets(docs, copies_once=True).withColumnRenamed("id", "doc_id")
