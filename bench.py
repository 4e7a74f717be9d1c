"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The index is built and saved once (timed), then searched from its files, as a
reader of a saved index would. Every query runs once untimed before it is timed.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import evaluate, results, vector
from quarry.plans import queries as engine
from quarry.plans.corpus import Corpus
from quarry.runtime import table


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 16))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # a small table in one file is still read by all cores
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "1m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    top = tempfile.mkdtemp(prefix="quarry-bench-")

    def timed(name: str, make, warm: bool = True) -> None:
        run = lambda: make().write.format("noop").mode("overwrite").save()
        if warm:
            run()
        began = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - began, 3)

    try:
        docs = table(spark, sf_dir, "documents")
        Corpus.from_table(docs.limit(200)).save(f"{top}/warm")
        began = time.perf_counter()
        perf = Corpus.from_table(docs).save(f"{top}/index")
        took["index_build"] = round(time.perf_counter() - began, 3)
        corpus = Corpus.load(spark, f"{top}/index")
        terms = engine.topics(spark, sf_dir)
        ranking = lambda: vector.vector_batch(corpus.postings, terms)

        def judged():
            longest = F.min_by("term", F.struct(-F.length("term"), "term")).alias("term")
            return terms.groupBy("qid").agg(longest).join(corpus.postings, "term").select("qid", "doc_id")

        for weight in ("raw", "norm", "half"):
            timed(f"vector_{weight}", lambda w=weight: results.page(corpus.vector(engine.QUESTION, w), corpus.docs))
        timed("vector_all_ranks", lambda: vector.ranked(corpus.vector(engine.QUESTION, "half")))
        timed("page_far_down", lambda: vector.ranked(corpus.vector("the of and", "half"), results.PAGE, 5_000))
        for name in ("bool_and", "bool_or", "bool_not", "bool_or_before_and"):
            timed(name, lambda n=name: corpus.boolean(engine.BOOLEAN[n][0]))
        timed("vector_batch", ranking)
        timed("eval_report", lambda: evaluate.report(vector.scores(corpus.postings, terms), judged()))
        timed("corpus_stats", lambda: corpus.stats())
        timed("tokenize", lambda: text.DEFAULT.tokens(docs))
        timed("radix_fanout", lambda: engine.stats.radix_fanout(corpus.terms))
    finally:
        spark.stop()
        shutil.rmtree(top, ignore_errors=True)
    sizes = {k: round(v, 3) if isinstance(v, float) else v for k, v in perf.row.items()}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "perf": sizes}))


if __name__ == "__main__":
    sys.exit(main())
