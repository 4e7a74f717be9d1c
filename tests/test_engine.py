import math

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import FIELDED, Profile
from quarry.operators import evaluate, index, results, stats, vector
from quarry.plans.corpus import Corpus, load_or_build
from quarry.sources import fielded, judged, pages

TEXTS = {0: "Alpha beta beta\nalpha", 1: "beta gamma", 2: "gamma gamma gamma delta", 3: "alpha"}


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus.from_table(spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string"))


def test_postings_keep_the_first_document(corpus):
    rows = corpus.of_terms(["alpha"]).collect()
    assert sorted(r.doc_id for r in rows) == [0, 3]
    assert {r.doc_id for r in corpus.boolean("alpha AND beta").collect()} == {0}
    assert {r.doc_id for r in corpus.boolean("gamma NOT delta").collect()} == {1}


def test_weights(corpus):
    idf = math.log(4 / 2)
    row = next(r for r in corpus.postings.filter("term = 'beta'").collect() if r.doc_id == 0)
    assert (row.tf, row.w_raw) == (2, pytest.approx(2 * idf))
    assert row.w_norm == pytest.approx((1 + math.log(2)) * idf) and row.w_half == pytest.approx(idf)


def test_ranking(corpus):
    found = {r.doc_id: r.score for r in corpus.vector("beta beta gamma", "raw").collect()}
    idf = math.log(2)
    assert found == {0: pytest.approx(4 * idf, abs=1e-6), 1: pytest.approx(3 * idf, abs=1e-6), 2: pytest.approx(3 * idf, abs=1e-6)}
    order = [r.doc_id for r in vector.ranked(corpus.vector("beta beta gamma")).orderBy("rank").collect()]
    assert order == [0, 1, 2]
    assert corpus.vector("", "half").collect() == [] and corpus.vector("absent").collect() == []
    assert vector.weight_of("brute") == vector.weight_of(None) == "raw"


def test_pages_and_links(spark):
    docs = Corpus.from_table(spark.createDataFrame([(i, f"common\nx{i}") for i in range(45)], "doc_id long, text string"))
    page = docs.search("common", offset="20")
    assert page.total == 45 and [r.rank for r in page.rows.orderBy("rank").collect()] == list(range(21, 41))
    assert "offset=0" in page.previous and "offset=40" in page.next
    last = docs.search("common", kind="boolean", offset=40)
    assert [r.doc_id for r in last.rows.orderBy("rank").collect()] == [40, 41, 42, 43, 44] and last.next == ""
    first = docs.search("common", weight="half", offset="x")
    assert first.rows.count() == 20 and first.previous == "" and "weight=half" in first.next
    assert [results.offset_of(x, 45) for x in (None, "", -5, 45, "44")] == [0, 0, 0, 0, 44]


def test_save_and_load(spark, corpus, tmp_path):
    path = f"file://{tmp_path}/index"
    perf = corpus.save(path)
    assert perf.index_bytes > 0 and perf.row["total_bytes"] == perf.index_bytes + perf.titles_bytes
    again = load_or_build(spark, corpus, path)
    for t in ("docs", "terms", "postings"):
        a, b = getattr(corpus, t), getattr(again, t)
        assert sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(b.columns)).collect()))
    assert [r.score for r in again.vector("gamma", "norm").collect()]
    assert {r.doc_id for r in again.boolean("alpha OR delta").collect()} == {0, 2, 3}
    plan = again.of_terms(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(term,alpha)]" in plan or "In(term" in plan or "IsNotNull(term), EqualTo(term,alpha)" in plan


def test_deltas(corpus):
    coded = index.deltas(corpus.tf)
    back = index.undelta(coded.select("term", F.col("doc_id").alias("pos"), "delta"))
    assert sorted(map(tuple, back.collect())) == sorted((r.term, r.doc_id) for r in corpus.tf.collect())


def test_stats(corpus):
    row = corpus.stats().first()
    assert (row.documents, row.vocabulary, row.tokens) == (4, 4, 11)
    b = (math.log(4) - math.log(3)) / (math.log(11) - math.log(6))
    assert row.b == pytest.approx(b, abs=1e-6) and row.k == pytest.approx(4 / 11**b, abs=1e-5)
    curve = {r.i: (r.tokens, r.vocabulary) for r in stats.heaps_curve(corpus.tokens, corpus.terms, 4).collect()}
    assert curve[0] == (0, 0) and curve[25] == (4, 2) and curve[99] == (10, 4) and len(curve) == 100


def test_statistics_of_ids_with_gaps(spark):
    texts = ["red green red", "green blue", "blue", "yellow red blue", "one two three four"]
    shown = []
    for ids in (range(5), (7, 100_000, 100_001, 300_000, 9_000_000)):
        docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
        c = Corpus.from_table(docs)
        shown.append((c.stats().collect(), sorted(stats.heaps_curve(c.tokens, c.terms, 5).collect())))
    assert shown[0] == shown[1] and shown[0][0][0].tokens == 13


def test_radix_fanout(spark):
    row = stats.radix_fanout(spark.createDataFrame([("chat",), ("chien",)], "term string")).first()
    assert (row.edges, row.inner_nodes, row.mean_children) == (3, 2, 1.5)


def test_evaluation(spark):
    ranking = spark.createDataFrame(
        [(1, "raw", d, 10.0 - d) for d in range(5)] + [(2, "raw", d, float(d)) for d in range(5)], "qid long, weight string, doc_id long, score double"
    )
    qrels = spark.createDataFrame([(1, 0), (1, 2), (1, 3), (2, 1)], "qid long, doc_id long")
    pts = evaluate.points(evaluate.hits(ranking, qrels))
    got = sorted((r.qid, r.rank, r.k, round(r.recall, 4), round(r.precision, 4)) for r in pts.collect())
    assert got == [(1, 1, 1, 0.3333, 1.0), (1, 3, 2, 0.6667, 0.6667), (1, 4, 3, 1.0, 0.75), (2, 4, 1, 1.0, 0.25)]
    assert [tuple(r) for r in evaluate.valid(pts).collect()] == [(1, "raw")]
    curve = {r.i: r.precision for r in evaluate.curves(pts).collect()}
    want = {i: max([p for r, p in ((1 / 3, 1.0), (2 / 3, 2 / 3), (1.0, 0.75)) if r > i / 256], default=0) for i in range(256)}
    assert curve == pytest.approx(want)
    assert evaluate.score(evaluate.average(evaluate.curves(pts))).first().map == pytest.approx(sum(want.values()) / 256)
    assert evaluate.report(ranking, qrels).first().topics == 1


RECORDS = """.I 1
.T
On the EL/1 machine. Second part
.W
The fault-tolerant system runs at 3.5 MHz.
.B
Letters May 1960
.A
Doe, J.
.N
note
.I 2
.T
Sorting
.K
sort, merge
.X
1 2 3
.I 3
.T
Last one
.A
Roe, R."""


@pytest.fixture
def collection(tmp_path):
    path = tmp_path / "all.txt"
    path.write_text(RECORDS)
    return f"file://{path}"


def test_fielded_source(spark, collection):
    docs = {r.doc_id: r for r in fielded.documents(fielded.scan_fielded(spark, collection)).collect()}
    assert len(docs) == 3
    assert docs[0].title == "On the EL/1 machine. Second part" and docs[0].publication == "Letters May 1960"
    assert docs[0].summary == "The fault-tolerant system runs at 3.5 MHz." and docs[0].authors == "Doe, J."
    assert docs[1].keywords == "sort, merge" and docs[1].summary == ""
    assert docs[2].authors == "Roe, R."
    cut = {r.doc_id: r for r in fielded.documents(fielded.scan_fielded(spark, collection, first_sentence_only=True)).collect()}
    assert cut[0].title == "On the EL/1 machine"
    assert fielded.fetch(fielded.documents(fielded.scan_fielded(spark, collection)), 99).collect() == []


def test_fielded_corpus(spark, collection):
    c = Corpus.from_fielded(spark, collection)
    assert c.profile is FIELDED
    terms = {r.term for r in c.tf.filter("doc_id = 0").collect()}
    assert "el/1" in terms and "the" not in terms and "machin" in terms
    assert {r.doc_id: r.title for r in c.docs.collect()}[0] == "On the EL/1 machine Second part"
    assert {r.doc_id for r in c.boolean("sorted").collect()} == {1}


def test_page_tree(spark, tmp_path):
    for name, body in {"0/a.edu_x__y": "one two \n", "1/b.edu_z": "two three", "0/c.edu": "one\n"}.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    c = Corpus.from_tree(spark, f"file://{tmp_path}/tree")
    docs = {r.doc_id: r for r in c.docs.collect()}
    assert [docs[i].title for i in range(3)] == ["0/a.edu_x__y", "0/c.edu", "1/b.edu_z"]
    assert docs[2].url == "https://b.edu/z"
    assert {r.doc_id for r in c.boolean("two").collect()} == {0, 2} and {r.doc_id for r in c.boolean("y").collect()} == {0}
    words = pages.page_tokens(pages.scan_tree(spark, f"file://{tmp_path}/tree")).collect()
    assert [r.term for r in sorted(words, key=lambda r: r.pos) if r.title == "0/a.edu_x__y"] == ["x", "y", "one", "two"]


def test_judged_files(spark, tmp_path):
    (tmp_path / "q.text").write_text(".I 1\n.W\n What is\nthis?\n.A\nDoe\n.N\n 1. note\n\n.I 2\n.W\nsecond\n")
    (tmp_path / "r.text").write_text("01 1410  0 0\n02 5 0 0\n")
    (tmp_path / "s.text").write_text("the\nof\nthe\n")
    assert {r.qid: r.text for r in judged.topics(spark, f"file://{tmp_path}/q.text").collect()} == {1: " What is this? ", 2: "second "}
    assert sorted(map(tuple, judged.qrels(spark, f"file://{tmp_path}/r.text").collect())) == [(1, 1409), (2, 4)]
    assert sorted(r.term for r in judged.stop_words(spark, f"file://{tmp_path}/s.text").collect()) == ["of", "the"]


def test_evaluate_a_corpus(spark, corpus):
    topics = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "qid long, text string")
    qrels = spark.createDataFrame([(1, 0), (1, 3), (2, 1), (2, 2)], "qid long, doc_id long")
    assert {r.weight: r.topics for r in corpus.evaluate(topics, qrels).collect()} == {"raw": 2, "norm": 2, "half": 2}


def test_stemmed_profile(spark):
    c = Corpus("s", spark.createDataFrame([(1, "running runs"), (2, "ran")], "doc_id long, text string"), Profile(stem=True))
    assert {r.doc_id: r.tf for r in c.of_terms(["run"]).collect()} == {1: 2}
    assert {r.doc_id for r in c.boolean("runners run").collect()} == set() and {r.doc_id for r in c.vector("running").collect()} == {1}


def test_cleanup(spark):
    from quarry import runtime

    df = runtime.materialize(spark.range(3), "cleaned")
    path = runtime._written[-1].removeprefix("file://")
    assert df.count() == 3
    import os

    kept, runtime._written[:] = runtime._written[:-1], runtime._written[-1:]
    runtime.cleanup(spark)
    runtime._written[:] = kept
    assert not os.path.exists(path)
