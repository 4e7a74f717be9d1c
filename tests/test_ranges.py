"""Global order, hot keys and what is built on them, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.stem import stem, stem_array
from quarry.operators import evaluate, index, ranges, results, skew, vector
from quarry.runtime import column, fresh, materialize


def rows(n=400, seed=1):
    """A key that holds most rows, some others, and null."""
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 9 + ["a", "b", "zz", None]), i, rng.randint(0, 9)) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("by", [[], ["key"]])
@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("largest", [False, True])
def test_running(spark, by, before, largest):
    data = rows()
    df = spark.createDataFrame(data, "key string, at long, v long").repartition(3)
    got = ranges.running(df, {"total": F.col("v")}, [F.col("at")], by, largest, before, rows=5 * ranges.ROWS_EACH)
    assert got.columns == ["key", "at", "v", "total"]
    want, so_far = [], {}
    for key, at, v in sorted(data, key=lambda r: r[1]):
        seen = so_far.setdefault(key if by else 0, [])
        upto = seen if before else [*seen, v]
        want.append((key, at, v, (max(upto) if upto else None) if largest else sum(upto)))
        seen.append(v)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_running_of_nothing_and_clashes(spark):
    df = spark.createDataFrame(rows(30), "part string, of0 long, first long")
    assert ranges.numbered(df.filter("false"), "place", [F.col("of0")], ["part"]).collect() == []
    assert sorted(r.place for r in ranges.numbered(df, "place", [F.col("of0")]).collect()) == list(range(1, 31))


def test_heavy_keys_are_joined_without_a_shuffle_of_theirs(spark):
    data = rows(2000)
    df = materialize(spark.createDataFrame(data, "key string, at long, v long"), "rows")
    sizes = df.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.max("v").alias("most"))
    got = skew.joined(df, sizes, "key", "n", 2000, share=3).select("key", "at", "most")
    most = {k: max(v for q, _, v in data if q == k) for k in {r[0] for r in data}}
    assert sorted(map(tuple, got.collect())) == sorted((k, at, most[k]) for k, at, _ in data if k is not None)


def test_names():
    assert fresh(["A", "a_0", "b"], "a") == "a_1" and fresh([], "a") == "a"


def test_dotted_names(spark):
    assert spark.createDataFrame([(1,)], ["a.b`c"]).select(column("a.b`c")).first()[0] == 1


def test_deep_pages(spark, monkeypatch):
    data = [(i, float(i % 7)) for i in range(200)]
    hits = spark.createDataFrame(data, "doc_id long, score double").repartition(5)
    order = sorted(data, key=lambda r: (-r[1], r[0]))
    shallow = [tuple(r) for r in vector.ranked(hits, 20, 60).orderBy("rank").collect()]
    monkeypatch.setattr(vector, "TOP", 10)
    assert [tuple(r) for r in vector.ranked(hits, 20, 60).orderBy("rank").collect()] == shallow == [(*r, k) for k, r in enumerate(order[60:80], 61)]
    assert [tuple(r) for r in vector.ranked(hits).orderBy("rank").collect()] == [(*r, k) for k, r in enumerate(order, 1)]


def test_ranks_of_judged_documents(spark):
    rng = random.Random(4)
    data = [(q, w, d, round(rng.choice([0.0, 1.5, rng.random() * 40]), 6)) for q in range(4) for w in ("raw", "norm") for d in range(300)]
    judged = [(q, d) for q in (0, 1, 3, 9) for d in rng.sample(range(400), 25)] + [(1, 1), (1, 1)]
    got = evaluate.hits(spark.createDataFrame(data, "qid long, weight string, doc_id long, score double"), spark.createDataFrame(judged, "qid long, doc_id long"))
    want = []
    for q, w in {(q, w) for q, w, _, _ in data}:
        order = sorted((r for r in data if r[:2] == (q, w)), key=lambda r: (-r[3], r[2]))
        answers = len({j for j in judged if j[0] == q})
        want += [(q, d, w, s, k, answers) for k, (_, _, d, s) in enumerate(order, 1) if (q, d) in judged]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("by", [None, "kind"])
def test_exact_quantiles(spark, by):
    data = [(k, None if v == 3 else v / 7) for k, v, _ in rows(300)] + [("none", None)]
    log = spark.createDataFrame(data, "kind string, value double")
    got = results.latency_percentiles(log, by=by, exact=True).collect()
    groups = {k for k, _ in data} if by else {0}
    assert len(got) == len(groups)
    for r in got:
        own = [v for k, v in data if v is not None and (not by or k == r[by])]
        assert r.n == len(own)
        for p in (50, 90, 95, 99):
            assert r[f"p{p}"] == (pytest.approx(np.quantile(own, p / 100), abs=2e-6) if own else None)
    near = {r.n: r.p50 for r in results.latency_percentiles(log, by=by).collect()}
    assert all(near[r.n] == pytest.approx(r.p50, rel=0.2) for r in got if r.n > 50)


def test_lists_of_ids(spark):
    data = sorted({(k or "n", at) for k, at, _ in rows(500)})
    coded = index.deltas(spark.createDataFrame(data, "term string, doc_id long"))
    last = {}
    want = []
    for term, at in data:
        want.append((term, at, at - last.get(term, 0)))
        last[term] = at
    assert sorted(map(tuple, coded.collect())) == want
    assert sorted(map(tuple, index.undelta(coded.withColumnRenamed("doc_id", "pos")).collect())) == data


def test_stems_inside_rows(spark):
    words = ["running", "runs", "the", "happily", "été", "nationalization"]
    data = [(0, words * 3), (1, []), (2, None), (3, ["running"])]
    got = spark.createDataFrame(data, "id long, w array<string>").select("id", stem_array()(F.col("w")).alias("s"))
    want = {i: None if w is None else [stem(x) if len(x.encode()) > 3 else x for x in w] for i, w in data}
    assert {r.id: r.s for r in got.collect()} == want


#: Words that are in an index of one document each, and words that are not.
PRESENT = (
    "abjure abrogate abstemious acumen antebellum auspicious belie bellicose bowdlerize chicanery chromosome churlish circumlocution"
    " circumnavigate deciduous deleterious diffident enervate enfranchise epiphany equinox euro evanescent expurgate facetious fatuous"
    " feckless fiduciary filibuster gamete gauche gerrymander"
).split()
ABSENT = [
    "hemoglobin", "homogeneous", "hubris", "hypotenuse", "impeach", "incognito", "incontrovertible", "inculcate", "infrastructure",
    "interpolate", "irony", "jejune", "kinetic", "kowtow", "laissez faire", "lexicon", "loquacious",
]


def test_lookups(spark):
    lists = [(w, i, 1, float(i), 0.0, 0.0) for i, w in enumerate(PRESENT)]
    stored = spark.createDataFrame(lists, "term string, doc_id long, tf long, w_raw double, w_norm double, w_half double")
    for rel in (stored, materialize(stored, "lookups")):  # and reloaded
        found = index.lookup(rel, *PRESENT, *ABSENT).collect()
        assert sorted(map(tuple, found)) == sorted(lists)
        assert index.lookup(rel, *ABSENT).collect() == []
        assert [tuple(r) for r in index.lookup(rel, "euro").collect()] == [lists[21]]
