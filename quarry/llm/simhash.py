"""SimHash near-duplicates by a binary trie self-join.

Fingerprints.  Words of the lower-cased text are cut into shingles; each
shingle is hashed with XXH64 and a bit of the fingerprint is 1 if it is set in
over half of the hashes.

Join.  Distinct fingerprints are dealt out by the values of two of six blocks
of bits (fifteen ways to choose them): two fingerprints that differ in at most
four bits agree in at least two whole blocks, so they meet in some bucket.  A
bucket, sorted, is a binary trie: a node is a range that shares a prefix.  The
join walks pairs of nodes from the root, adds up the bits in which the two
prefixes differ, drops a pair as soon as the sum is over the error budget, and
drops a pair whose leaves are all known to be one component already.  The last
rule keeps dense groups from being spelled out pair by pair.  A bucket emits at
most one edge for each of its fingerprints.

Buckets above ``block_rows`` are split into blocks, and each pair of blocks is
a task of its own, so that no task holds a whole hot bucket.

Components are found by alternating stars on tables in the shared folder.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other; rows with a null ``doc_id`` are
fingerprinted and connect groups, but never name a component (its id is null
only if none of its rows has a ``doc_id``); repeated rows stay repeated; an
empty table gives an empty result; further columns are ignored by
``near_duplicates`` and kept by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quarry.llm.batches import contents, slices, word_blocks
from quarry.llm.rows import addressed, everything, mapped, matched
from quarry.operators import skew
from quarry.runtime import column, materialize

BITS = 64
WIDTHS = (11, 11, 11, 11, 10, 10)
MAX_DIFF = 4
SIGN = -(1 << 63)


def fingerprint(data: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of one UTF-8 text, as an unsigned integer."""
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    total, carry = 0, []
    for block in word_blocks(data.lower()):
        words = carry + block
        if len(words) >= shingle:
            text = b" ".join(words)
            ends = list(accumulate(len(w) + 1 for w in words))
            starts = [0, *ends]
            hashes = np.array(
                [digest(text[s : e - 1], seed) for s, e in zip(starts, ends[shingle - 1 :])],
                np.uint64,
            )
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.uint32)
            total += len(hashes)
            carry = words[len(words) - shingle + 1 :]
        else:
            carry = words
    if not total:
        return digest(b" ".join(carry), seed) if carry else 0
    packed = np.packbits((2 * ones > total).astype(np.uint8), bitorder="little")
    return int(packed.view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, seed: int = 42, out: str = "fp") -> DataFrame:
    """``docs`` with a column ``out``: the fingerprint as a signed long."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for part in (p for b in batches for p in slices(b, at)):
            prints = np.array([fingerprint(t or b"", shingle, seed) for t in contents(part, at)], np.uint64)
            yield part, [pa.array(prints.view(np.int64))]

    return mapped(docs, {out: LongType()}, run)


def trie_links(
    prints: np.ndarray, starts: np.ndarray, max_diff: int = MAX_DIFF, chunk: int = 1 << 15
) -> np.ndarray:
    """Component labels (positions of the first member) of sorted unsigned
    fingerprints under links of at most ``max_diff`` bits, found within each
    bucket; ``starts`` are the buckets' first positions, sorted.
    """
    n = len(prints)
    label = np.arange(n, dtype=np.int64)
    bounds = np.append(starts, n).astype(np.int64)
    lo, hi = bounds[:-1], bounds[1:]
    keep = hi - lo > 1
    lo, hi = lo[keep], hi[keep]
    if not len(lo):
        return label
    planes: dict[int, np.ndarray] = {}

    def zeros_end(bit: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where, in each range [a, b), the leaves with a 1 at ``bit`` begin."""
        if bit not in planes:
            ones = ((prints >> np.uint64(bit)) & np.uint64(1)).astype(np.int32)
            planes[bit] = np.concatenate(([0], np.cumsum(ones, dtype=np.int32)))
        p = planes[bit]
        return b - (p[b] - p[a])

    changes = np.arange(n, dtype=np.int64)  # label changes before each position
    stack = [
        (BITS - 1, *(x[i : i + chunk] for x in (lo, hi, lo, hi)), np.zeros(len(lo[i : i + chunk]), np.int8))
        for i in range(0, len(lo), chunk)
    ]
    while stack:
        bit, alo, ahi, blo, bhi, diff = stack.pop()
        same = alo == blo
        one = label[alo] == label[blo]
        one &= changes[ahi - 1] == changes[alo]
        one &= changes[bhi - 1] == changes[blo]
        leaves = (ahi - alo == 1) & (bhi - blo == 1)
        ready = leaves & ~same & ~one
        if ready.any():
            i, j = alo[ready], blo[ready]
            near = np.bitwise_count(prints[i] ^ prints[j]) <= max_diff
            i, j = label[i[near]], label[j[near]]
            low, high = np.minimum(i, j), np.maximum(i, j)
            pairs = np.unique(low * n + high)
            if len(pairs):
                label = _union(label, pairs // n, pairs % n)
                changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        go = ~leaves & ~one
        if bit < 0 or not go.any():
            continue
        alo, ahi, blo, bhi, diff, same = (x[go] for x in (alo, ahi, blo, bhi, diff, same))
        am, bm = zeros_end(bit, alo, ahi), zeros_end(bit, blo, bhi)
        more = diff + np.int8(1)
        every = np.ones(len(alo), bool)
        others = [  # a node with itself needs its 0-1 pair only once
            (alo, am, bm, bhi, more, every),
            (am, ahi, blo, bm, more, ~same),
            (alo, am, blo, bm, diff, ~same),
            (am, ahi, bm, bhi, diff, ~same),
        ]
        selves = [(alo, am, alo, am, diff, same), (am, ahi, am, ahi, diff, same)]
        for parts in (others, selves):  # the last pushed is walked first
            a, b, c, d, e, ok = (np.concatenate(x) for x in zip(*parts))
            ok = ok & (b > a) & (d > c) & (e <= max_diff) & ~((a == c) & (b - a == 1))
            picked = np.flatnonzero(ok)
            for i in range(0, len(picked), chunk):
                k = picked[i : i + chunk]
                stack.append((bit - 1, a[k], b[k], c[k], d[k], e[k]))
    return label


def _union(label: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Labels after joining pairs of labels; a label is its component's least position."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    for a, b in zip(low.tolist(), high.tolist()):
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    parent = np.arange(len(label))
    for x in list(up):
        parent[x] = find(x)
    return parent[label]


def block_widths(max_diff: int = MAX_DIFF) -> tuple[int, ...]:
    """Widths of blocks of bits of which two are equal in fingerprints that differ in at most ``max_diff`` bits."""
    if max_diff <= MAX_DIFF:
        return WIDTHS
    count = max_diff + 2
    return tuple(BITS // count + (i < BITS % count) for i in range(count))


def _bucket_keys(fp: F.Column, max_diff: int = MAX_DIFF) -> F.Column:
    """An array of the bucket keys of a fingerprint."""
    widths = block_widths(max_diff)
    offsets = [0, *accumulate(widths)]
    blocks = [F.shiftrightunsigned(fp, o).bitwiseAND((1 << w) - 1) for o, w in zip(offsets, widths)]
    return F.array(
        *[
            F.lit(k << 22).bitwiseOR(F.shiftleft(blocks[i], 11)).bitwiseOR(blocks[j]).cast("long")
            for k, (i, j) in enumerate(combinations(range(len(widths)), 2))
        ]
    )


def _link_batches(batches: Iterator[pa.RecordBatch], max_diff: int = MAX_DIFF) -> Iterator[pa.RecordBatch]:
    """Sorted rows (bucket, flipped fingerprint) to edges; a bucket that goes
    on in the next batch waits for it."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    wait_key, wait_fp = np.empty(0, np.int64), np.empty(0, np.int64)

    def edges(key: np.ndarray, flipped: np.ndarray) -> pa.RecordBatch:
        prints = flipped.view(np.uint64) ^ np.uint64(1 << 63)
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        many = np.repeat(sizes > 1, sizes)
        prints, sizes = prints[many], sizes[sizes > 1]
        label = trie_links(prints, np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64), max_diff)
        child = np.flatnonzero(label != np.arange(len(label)))
        signed = prints.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[child]), pa.array(signed[label[child]])], schema=schema)

    for batch in batches:
        key = np.concatenate((wait_key, batch.column(0).to_numpy(zero_copy_only=False)))
        fp = np.concatenate((wait_fp, batch.column(1).to_numpy(zero_copy_only=False)))
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield edges(key[:cut], fp[:cut])
        wait_key, wait_fp = key[cut:], fp[cut:]
    if len(wait_key):
        yield edges(wait_key, wait_fp)


def links(prints: DataFrame, block_rows: int = 1 << 15, max_diff: int = MAX_DIFF) -> DataFrame:
    """Edges ``(u, v)`` that join the distinct fingerprints ``fp`` which differ
    in at most ``max_diff`` bits, directly or through others."""
    keyed = prints.select("fp", F.explode(_bucket_keys(F.col("fp"), max_diff)).alias("key"))
    hot = materialize(
        keyed.groupBy("key").count().filter(F.col("count") > block_rows)
        .select("key", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")),
        "simhash-hot",
    )
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != mine)).alias("other")
    cold = keyed.join(hot, "key", "left_anti").select(F.xxhash64("key").alias("bucket"), "fp")
    split = (
        keyed.join(hot, "key").select("key", "fp", mine.alias("mine"), other)
        .select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "fp")
    )
    flipped = F.col("fp").bitwiseXOR(F.lit(SIGN).cast("long")).alias("flipped")
    rows = cold.unionByName(split).select("bucket", flipped)
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "flipped")
        .mapInArrow(lambda batches: _link_batches(batches, max_diff), "u long, v long").distinct()
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, label)`` for every node of ``edges(u, v)``; the label is the
    component's least node.  Alternates large and small stars, each a
    pre-aggregated minimum and a join, until the edges stay as they are.  The
    minima of nodes with a large share of the edges (the centre of a large
    component) are broadcast, the others are dealt out with their edges."""
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, "components")
    size, before = e.count(), None
    for _ in range(max_rounds):
        # each star keeps the components and lowers the larger ends
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = skew.joined(both, least, "u", "n", 2 * size).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (
            skew.joined(large, least, "u", "n", 2 * size).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
        e = materialize(small, "components")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        before, size = now, now[0]
    raise RuntimeError("components did not settle")


def _labels(prints: DataFrame, max_diff: int = MAX_DIFF) -> DataFrame:
    """``(fp, label)`` for those of the distinct fingerprints that have links."""
    found = components(materialize(links(prints, max_diff=max_diff), "simhash-links"))
    return materialize(found.withColumnRenamed("node", "fp"), "simhash-labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: id, fingerprint as 16 lowercase hex digits, and
    ``component_id``, the smallest id reachable over links of at most four bits."""
    slim = docs.select(column(id_col).alias("id"), column(text).alias("text"))
    prints = materialize(with_fingerprints(slim).select("id", "fp"), "simhash-prints")
    reps = materialize(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "simhash-reps")
    rows = reps.agg(F.sum("n")).first()[0] or 0
    # fingerprints without a link have no label and stay out of the joins on it
    linked = materialize(reps.select("fp", "rep").join(_labels(reps.select("fp")), "fp"), "simhash-linked")
    least = linked.groupBy("label").agg(F.min("rep").alias("least"), F.count("*").alias("n"))
    found = skew.joined(linked, least, "label", "n", linked.count()).select("fp", "least", F.lit(True).alias("linked"))
    groups = reps.join(found, "fp", "left").select(
        "fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("rep")).alias("component_id"), "n"
    )
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    # a text with thousands of copies is one fingerprint; its group is broadcast
    return skew.joined(prints, materialize(groups, "simhash-groups"), "fp", "n", rows).select(F.col("id").alias(id_col), hexed, "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, max_diff: int = MAX_DIFF) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest id (nulls
    last), and of rows with the same id that with the first address.  The law is
    that of ``near_duplicates`` unless ``shingle`` (words) and ``max_diff`` (bits) say otherwise."""
    rows, key = addressed(docs)
    slim = rows.select(column(id_col).alias("id"), column(text).alias("text"), column(key).alias("address"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "address")
    # the best row of each fingerprint is picked where the rows are; only these meet the labels
    best = with_fingerprints(slim, "text", shingle).groupBy("fp").agg(F.min(order).alias("best"))
    best = materialize(best, "simhash-best")
    kept = (
        best.join(_labels(best.select("fp"), max_diff), "fp", "left")
        .groupBy(F.coalesce("label", "fp").alias("group")).agg(F.min("best").alias("best"))
        .select(F.col("best.address").alias(key))
    )
    return matched(rows, kept, key, "left_semi").select(*everything(docs))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
