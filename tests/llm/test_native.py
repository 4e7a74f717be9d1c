"""Mixing, sharding and quality rules."""

import zlib

import pytest

from quarry.llm import mixing, quality, sharding
from tests.llm.fixtures import awkward, docs_of, rows_of, sql, written


def no_python(df):
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_mixing_against_sql(spark, tmp_path):
    docs = docs_of(spark)
    got = mixing.op2_mixing(spark, written(tmp_path, documents=docs))
    no_python(got)
    assert rows_of(got) == sql(mixing.ORACLE, documents=docs)


def test_mixing_law(spark):
    docs = docs_of(spark, awkward(5, 120))
    mixed = mixing.mix(docs, mixing.word_count(docs["text"])).collect()
    by = {}
    for r in mixed:
        s = by.setdefault(r.doc.source, [0, r.source_size, r.target, 0])
        s[0] += r.size * r.repeats
        s[3] = max(s[3], r.size)
        assert r.repeats <= 2
    total = sum(s[1] for s in by.values())
    assert sum(s[2] for s in by.values()) == pytest.approx(1.5 * total)
    weights = dict(zip(sorted((s for s in by), key=lambda s: (s is None, s or "")), [5, 2, 1] * 3))
    levels = [s[2] / weights[k] for k, s in by.items() if s[2] < 2 * s[1] - 1e-9]
    assert max(levels) == pytest.approx(min(levels))  # the open sources are filled to one level
    for k, (taken, size, target, largest) in by.items():
        assert target <= 2 * size + 1e-9
        assert abs(taken - target) <= largest / 2 + 1e-9
        if target == 2 * size:
            assert target / weights[k] <= max(levels) + 1e-9
    assert rows_of(mixing.repeated(docs).groupBy("doc_id").count()) == rows_of(mixing.repeated(docs).groupBy("doc_id").count())
    assert mixing.repeated(docs).count() == sum(r.repeats for r in mixed)


def test_mixing_degenerate(spark):
    assert mixing.repeated(docs_of(spark, [])).collect() == []
    blank = docs_of(spark, [(i, None if i else "", "en", "s", 0, 1, 2, "w", "s", 3, "i") for i in range(4)])
    assert [r.repeats for r in mixing.mix(blank, mixing.word_count(blank["text"])).collect()] == [0] * 4


@pytest.mark.parametrize("seed", [0, 4])
def test_sharding(spark, tmp_path, seed):
    rows = awkward(seed, 150)
    got = sharding.op4_sharding(spark, written(tmp_path, documents=docs_of(spark, rows)))
    no_python(got)
    found = got.collect()
    short = [r for r in rows if len(r[1] or "") < 5000]  # the SQL takes a byte at a time
    small = sharding.op4_sharding(spark, written(tmp_path / "short", documents=docs_of(spark, short)))
    assert rows_of(small) == sql(sharding.ORACLE, documents=docs_of(spark, short))
    want = sorted(((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=repr) == want
    total, largest = sum(r.size for r in found), max(r.size for r in found)
    shards = {}
    for r in found:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r["shard"] < 40
        shards.setdefault(r["shard"], []).append(r)
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 40) <= largest
    order = [r.doc_id for r in sorted(found, key=lambda r: (r["shard"], r.slot))]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))  # contiguous in the order of ids


def test_sharding_of_few_or_none(spark):
    assert sharding.shard(docs_of(spark, [])).collect() == []
    two = sharding.shard(docs_of(spark, awkward()[:2])).collect()
    assert len(two) == 2 and {r.slot for r in two} == {0}


def test_quality_against_sql(spark, tmp_path):
    docs = docs_of(spark)
    got = quality.op8_quality(spark, written(tmp_path, documents=docs))
    no_python(got)
    assert rows_of(got) == sql(quality.oracle(), documents=docs)
    assert quality.judge(docs_of(spark, [])).collect() == []


def plain_repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    return len({p for i, w in enumerate(windows) if counts[w] > 1 for p in range(i, i + 5)})


def test_repeated_windows(spark):
    texts = ["a b c d e a b c d e", "a a a a a a", "a a a a a", "x a b c d e y a b c d e z", "a b c d e f g h i j"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc.doc_id: r.n_repeat_words for r in quality.signals(docs).collect()}
    assert got == {i: plain_repeats(t.split()) for i, t in enumerate(texts)}


def test_rules_are_a_table(spark):
    rules = (quality.Rule("too_long", "n_words", high=3),)
    docs = spark.createDataFrame([(0, "a b c d " * 5), (1, "q w e r t y u i o p")], "doc_id long, text string")
    got = {r.doc.doc_id: list(r.broken) for r in quality.judge(docs, rules=rules).collect()}
    assert got == {0: ["too_long"], 1: ["too_long"]}
