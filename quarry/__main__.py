"""python -m quarry index|search|stats|evaluate|serve: a corpus from the command line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from quarry.functions.text import DEFAULT
from quarry.plans.corpus import Corpus, load_or_build, with_stop_words
from quarry.sources import judged


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    p.add_argument("action", choices=["index", "search", "stats", "evaluate", "serve"])
    p.add_argument("--index", required=True, action="append", help="folder of the saved index; more than one to serve several")
    p.add_argument("--table", help="Parquet table with doc_id and text")
    p.add_argument("--fielded", help="fielded collection in one file")
    p.add_argument("--tree", help="folder of pre-tokenised pages")
    p.add_argument("--stop-words", help="file of stop words, kept with the index")
    p.add_argument("--query", default="")
    p.add_argument("--type", default="vectorial", choices=["vectorial", "boolean"])
    p.add_argument("--weight", default="raw")
    p.add_argument("--offset", default="0")
    p.add_argument("--topics", help="with --qrels: evaluate, and keep the curves beside the index")
    p.add_argument("--qrels")
    p.add_argument("--port", type=int, default=8080)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    profile, path = with_stop_words(spark, DEFAULT, a.stop_words), a.index[0]
    if a.table:
        corpus = Corpus.from_table(spark.read.parquet(a.table), profile=profile, source=a.table)
    elif a.fielded:
        corpus = Corpus.from_fielded(spark, a.fielded, stop_words=a.stop_words)
    elif a.tree:
        corpus = Corpus.from_tree(spark, a.tree, profile=profile)
    else:
        corpus = None
    if a.action == "index":
        print(json.dumps(corpus.save(path).row))
        return
    corpus = load_or_build(spark, corpus, path) if corpus else Corpus.load(spark, path)
    if a.action == "search":
        page = corpus.search(a.query, a.type, a.weight, a.offset)
        print(json.dumps({"total": page.total, "rows": [r.asDict() for r in page.rows.orderBy("rank").collect()]}))
    elif a.action == "stats":
        print(json.dumps(corpus.stats().first().asDict()))
    elif a.action == "evaluate":
        found = corpus.judge(judged.topics(spark, a.topics), judged.qrels(spark, a.qrels))
        found.save(path)
        print(json.dumps([r.asDict() for r in found.report.collect()]))
    else:
        from quarry.plans.serve import serve, site_of

        serve(site_of(spark, a.index), a.port).serve_forever()


if __name__ == "__main__":
    main()
