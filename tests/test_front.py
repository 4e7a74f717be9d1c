import json
import random
import re
import threading
from urllib.request import urlopen

import pytest
from pyspark.sql import functions as F

from quarry.__main__ import main
from quarry.plans import render
from quarry.plans.corpus import Corpus
from quarry.plans.serve import Site, serve, site_of
from quarry.runtime import materialize
from quarry.streaming.latency import live_percentiles


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('t')}/docs"
    spark.createDataFrame([(i, f"title <{i}>\ncommon word{i % 3}") for i in range(30)], "doc_id long, text string").write.parquet(path)
    return path


def test_command_line(spark, table, tmp_path, capsys):
    index = f"file://{tmp_path}/index"
    main(["index", "--table", table, "--index", index])
    assert json.loads(capsys.readouterr().out)["index_bytes"] > 0
    main(["search", "--index", index, "--query", "common word1", "--weight", "half"])
    found = json.loads(capsys.readouterr().out)
    assert found["total"] == 30 and found["rows"][0]["rank"] == 1 and len(found["rows"]) == 20
    main(["stats", "--index", index])
    assert json.loads(capsys.readouterr().out)["documents"] == 30
    (tmp_path / "q").write_text(".I 1\n.W\nword1 common\n")
    (tmp_path / "r").write_text("1 2 0 0\n1 5 0 0\n")
    main(["evaluate", "--index", index, "--topics", f"file://{tmp_path}/q", "--qrels", f"file://{tmp_path}/r"])
    assert {r["weight"] for r in json.loads(capsys.readouterr().out.splitlines()[-1])} == {"raw", "norm", "half"}


def test_fielded_index_brings_its_profile(spark, tmp_path, capsys):
    (tmp_path / "all").write_text(
        ".I 1\n.T\nSorting Machines\n.W\nA summary of these.\n.B\nMarch, 1960\n.A\nSome One\n"
        ".I 2\n.T\nOther things\n.K\nsorts, sorted\n.I 3\n.T\nEmpty of it\n"
    )
    (tmp_path / "stop").write_text("these\nother\n/*\nthese\n")
    index = f"file://{tmp_path}/index"
    main(["index", "--fielded", f"file://{tmp_path}/all", "--stop-words", f"file://{tmp_path}/stop", "--index", index])
    capsys.readouterr()
    for asked, ids in (("sorting machines", [0, 1]), ("these", []), ("other things", [1])):
        main(["search", "--index", index, "--query", asked])
        assert sorted(r["doc_id"] for r in json.loads(capsys.readouterr().out)["rows"]) == ids
    again = Corpus.load(spark, index)
    assert again.profile.stop == ("/*", "other", "these") and again.profile.stem and again.name == "fielded" and again.documents == 3
    assert again.perf["index_bytes"] > 0 and again.document(0)["publication"] == "March, 1960" and again.document(9) is None
    assert "March, 1960" in Site({"fielded": again}).get("/doc/0")[2]


def test_evaluation_is_kept(spark, table, tmp_path, capsys):
    index = f"file://{tmp_path}/index"
    main(["index", "--table", table, "--index", index])
    (tmp_path / "q").write_text(".I 1\n.W\nword1 common\n.I 2\n.W\nnothing\n")
    (tmp_path / "r").write_text("1 2 0 0\n1 5 0 0\n2 5 0 0\n")
    assert site_of(spark, [index]).get("/precall")[0] == 404
    main(["evaluate", "--index", index, "--topics", f"file://{tmp_path}/q", "--qrels", f"file://{tmp_path}/r"])
    report = json.loads(capsys.readouterr().out.splitlines()[-1])
    site = site_of(spark, [index])
    assert {(r["weight"], r["topics"]) for r in report} == {("raw", 1), ("norm", 1), ("half", 1)}
    for address in ("/precall", "/qrels/1"):
        assert site.get(address)[1] == "image/svg+xml" and site.get(address)[2].count("<polyline") == 3
    body = site.get("/qrels")[2]
    assert "word1 common" in body and "nothing" not in body and 'href="/qrels/1"' in body
    assert "index_bytes" in site.get("/perf")[2]


def test_site(spark, table):
    site = Site({"documents": Corpus.from_table(spark.read.parquet(table), source=table)})
    status, _, body = site.get("/?query=common+word1&type=boolean")
    assert status == 200 and "10 results" in body and "&lt;" not in body.split("<ol>")[0]
    assert "Next" in site.get("/?query=common&weight=norm")[2] and "offset=20" in site.get("/?query=common")[2]
    assert "<form>" in site.get("/")[2] and "<form>" in site.get("/?query=a&type=other")[2]
    assert "30" in site.get("/stat")[2] and "<polyline" in site.get("/heaps/documents")[2]
    assert "title &lt;3&gt;" in site.get("/doc/3")[2] and site.get("/doc/documents/99")[0] == 404
    assert site.get("/precall")[0] == 404 and site.get("/nothing")[0] == 404
    assert "<td>3</td>" in site.get("/latency")[2]
    server = serve(site, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urlopen(f"http://127.0.0.1:{server.server_port}/perf") as answer:
        assert b"Build figures" in answer.read()
    server.shutdown()


def test_every_result_link_opens(spark, table):
    site = Site({"other": Corpus.from_table(spark.read.parquet(table).filter("false"), "other"), "documents": Corpus.from_table(spark.read.parquet(table))})
    body = site.get("/?query=common&corpus=documents")[2]
    links = re.findall(r'<li value="\d+"><a href="([^"]+)">', body)
    assert len(links) == 20
    for link in links:
        status, _, page = site.get(link)
        assert status == 200 and f"<h3>doc_id</h3><p>{link.split('/')[-1]}</p>" in page


def test_svg():
    drawn = render.svg_lines({"a": [(0, 0), (2, 4)], "b": []}, "t & u", "x", "y")
    assert drawn.startswith("<svg") and "t &amp; u" in drawn and drawn.count("<polyline") == 2


def test_stored_types_come_back(spark):
    rng = random.Random()
    rows = [(rng.getrandbits(32), rng.random(), [f"w{rng.random()}" for _ in range(5)]) for _ in range(10)]
    again = materialize(spark.createDataFrame(rows, "n long, x double, words array<string>"), "types")
    assert sorted(map(repr, map(tuple, again.collect()))) == sorted(map(repr, rows))


def test_live_percentiles(spark, tmp_path):
    rows = spark.range(600).select(
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("ts"),
        F.lit("view").alias("event_type"), (F.col("id") % 100).cast("double").alias("value"),
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/log")
    log = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/log")
    run = live_percentiles(log, late="0 seconds").writeStream.outputMode("update").format("memory").queryName("latencies").start()
    try:
        run.processAllAvailable()
        found = spark.sql("select * from latencies").collect()
    finally:
        run.stop()
    assert sorted(r.n for r in found) == [300, 300] and all(48 <= r.p50 <= 51 for r in found)
    batch = live_percentiles(rows).collect()
    assert sorted(r.n for r in batch) == [300, 300]
