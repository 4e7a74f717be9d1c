"""A corpus: its documents and its index, built, saved, loaded and searched."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalar import id_url, path_url
from quarry.functions.text import DEFAULT, FIELDED, Profile, fielded_tokens
from quarry.operators import boolean, evaluate, index, results, stats, vector
from quarry.runtime import exists, materialize
from quarry.sources import fielded, judged, pages

TABLES = ("docs", "terms", "postings")


@dataclass
class SearchPage:
    rows: DataFrame
    total: int
    previous: str
    next: str


@dataclass
class Judged:
    """An evaluation: ``topics(qid, text)``, ``points``, ``curves`` and their
    ``mean`` by weight, and the ``report``.  Saved beside an index, and loaded."""

    topics: DataFrame
    points: DataFrame
    curves: DataFrame
    mean: DataFrame
    report: DataFrame

    def save(self, path: str) -> None:
        for name, df in vars(self).items():
            df.write.mode("overwrite").parquet(f"{path}/judged/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Judged | None:
        """What ``save`` wrote, None if nothing was."""
        if not exists(spark, f"{path}/judged/report/_SUCCESS"):
            return None
        return cls(*[spark.read.parquet(f"{path}/judged/{name}") for name in cls.__dataclass_fields__])


class Corpus:
    """``docs(doc_id, title, url, n_tokens)``, ``terms(term, df, min_doc, idf)``
    and ``postings(term, doc_id, tf, w_raw, w_norm, w_half)``; lazy until saved.

    ``meta`` tells how the corpus was cut into terms, what its build took and
    where its stored documents are; it is saved and loaded with the index."""

    def __init__(self, name: str, texts: DataFrame, profile: Profile = DEFAULT, title: Column | None = None, url: Column | None = None, stored: DataFrame | None = None, source: str | None = None):
        """``texts`` has ``doc_id`` and ``text``; ``stored`` are the records a
        reader is shown (saved with the index), ``source`` a Parquet table that has them."""
        self.name, self.texts, self.profile, self.perf, self.source = name, texts, profile, {}, source
        self._title = title if title is not None else fielded.display_title(F.split("text", "\n")[0])
        self._url = url if url is not None else id_url(F.col("doc_id"))
        self.stored = texts.sparkSession.read.parquet(source) if source else stored

    # -- builders

    @classmethod
    def from_table(cls, docs: DataFrame, name: str = "documents", profile: Profile = DEFAULT, source: str | None = None) -> Corpus:
        return cls(name, docs, profile, source=source)

    @classmethod
    def from_fielded(cls, spark: SparkSession, path: str, name: str = "fielded", profile: Profile = FIELDED, stop_words: str | None = None) -> Corpus:
        """``stop_words``: a file with a word a line, in place of the profile's."""
        docs = fielded.documents(fielded.scan_fielded(spark, path))
        title = F.array_join(fielded_tokens(F.col("title")), " ")
        return cls(name, docs, with_stop_words(spark, profile, stop_words), title, stored=docs.drop("text"))

    @classmethod
    def from_tree(cls, spark: SparkSession, root: str, name: str = "pages", profile: Profile = DEFAULT) -> Corpus:
        found = pages.numbered(pages.scan_tree(spark, root))
        words = F.array_join(pages.path_tokens(F.col("title")), " ")
        texts = found.withColumn("text", F.concat_ws(" ", words, "text"))
        return cls(name, texts, profile, title=F.col("title"), url=path_url(F.col("title")))

    @classmethod
    def load(cls, spark: SparkSession, path: str, name: str | None = None, profile: Profile | None = None) -> Corpus:
        """An index that ``save`` wrote, with its name, profile and stop words unless others are given."""
        self = cls.__new__(cls)
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"]) if exists(spark, f"{path}/meta/_SUCCESS") else {}
        known = meta.get("profile", asdict(DEFAULT))
        self.name, self.texts, self.perf, self.source = name or meta.get("name", "saved"), None, meta.get("perf", {}), meta.get("source")
        self.profile = profile or Profile(**known | {"stop": tuple(known["stop"])})
        if "documents" in meta:
            self.__dict__["documents"] = meta["documents"]
        for table in TABLES:
            self.__dict__[table] = spark.read.parquet(f"{path}/{table}")
        self.stored = None
        if self.source or meta.get("stored"):
            self.stored = spark.read.parquet(self.source or f"{path}/stored")
        return self

    # -- relations

    @cached_property
    def documents(self) -> int:
        """The number of documents; from file statistics where the source has them."""
        return (self.docs if self.texts is None else self.texts).count()

    @cached_property
    def dealt(self) -> DataFrame:
        return index.by_document(self.texts.select("doc_id", "text"))

    @cached_property
    def docs(self) -> DataFrame:
        n = F.size(self.profile.array(F.col("text"))).cast("long")
        return self.texts.select("doc_id", self._title.alias("title"), self._url.alias("url"), n.alias("n_tokens"))

    @cached_property
    def tokens(self) -> DataFrame:
        return index.doc_tokens(self.texts, self.profile) if self.texts is not None else self.docs.select("doc_id", "n_tokens")

    @cached_property
    def tf(self) -> DataFrame:
        return index.term_frequency(self.dealt, self.profile)

    @cached_property
    def terms(self) -> DataFrame:
        return index.with_idf(index.document_frequency(self.tf), self.documents)

    @cached_property
    def weights(self) -> DataFrame:
        return index.weights(index.with_max(self.tf))

    @cached_property
    def postings(self) -> DataFrame:
        return index.postings(self.weights, self.terms)

    def of_terms(self, terms: list[str]) -> DataFrame:
        """The postings of some terms without building all: the weights need
        each document's largest count, the rest is read of these terms only."""
        if self.texts is None:
            return index.lookup(self.postings, *terms)
        weights = self.weights.filter(F.col("term").isin(*terms)) if terms else self.weights.filter(F.lit(False))
        return index.postings(weights, index.with_idf(index.document_frequency(weights), self.documents))

    # -- search

    def boolean(self, query: str, parens: bool = False, standard: bool = False) -> DataFrame:
        # without a saved index, the query's terms are picked before anything is shuffled
        rows = self.postings if self.texts is None else index.occurrences(self.texts, self.profile)
        return boolean.boolean_search(rows, query, self.profile, parens, standard)

    def vector(self, query: str, weight: str | None = None) -> DataFrame:
        terms = list(vector.query_terms(query, self.profile))
        return vector.vector_search(self.of_terms(terms), query, weight, self.profile)

    def search(self, query: str, kind: str = "vectorial", weight: str | None = None, offset: str | int | None = 0) -> SearchPage:
        """A page of results with the total and the neighbouring pages' addresses."""
        ranked = kind != "boolean"
        hits = self.vector(query, weight) if ranked else self.boolean(query)
        total = hits.count()
        at = results.offset_of(offset, total)
        before, after = results.links(query, kind, self.name, weight, at, total)
        return SearchPage(results.page(hits, self.docs, at, scored=ranked), total, before, after)

    def document(self, doc_id: int) -> dict | None:
        """The stored record, or what the index knows of a document; None if there is none."""
        found = fielded.fetch(self.docs if self.stored is None else self.stored, doc_id).limit(1).collect()
        return found[0].asDict() if found else None

    # -- the rest

    def stats(self) -> DataFrame:
        return stats.corpus_stats(self.tokens, self.terms, self.documents, self.name)

    def heaps(self) -> DataFrame:
        return stats.heaps_curve(self.tokens, self.terms, self.documents)

    def topic_terms(self, topics: DataFrame) -> DataFrame:
        """``(qid, term, qtf)`` of ``topics(qid, text)``, cut into words as queries are."""
        return vector.topic_terms(topics, replace(self.profile, fielded=False, drop_short=False).terms(F.col("text")))

    def judge(self, topics: DataFrame, qrels: DataFrame) -> Judged:
        """``topics(qid, text)`` and ``qrels(qid, doc_id)`` to an evaluation; its points are made once."""
        pts = evaluate.points(evaluate.hits(vector.scores(self.postings, self.topic_terms(topics)), qrels))
        pts = materialize(pts, "points")
        curves = evaluate.curves(pts)
        return Judged(topics, pts, curves, evaluate.average(curves), evaluate.report_of(pts))

    def evaluate(self, topics: DataFrame, qrels: DataFrame) -> DataFrame:
        """The report by weight."""
        return self.judge(topics, qrels).report

    def save(self, path: str) -> stats.Perf:
        """Write the three tables as Parquet, postings sorted by term and id so
        that a term's row groups are found by their statistics, the stored records
        in the order of ids for the same reason, and the meta data; returns times and sizes."""
        perf = stats.Perf(self.name)
        spark = self.texts.sparkSession
        perf.timed("parsing", lambda: self.docs.write.mode("overwrite").parquet(f"{path}/docs"))
        # counts are made once; terms and postings are both read from them
        perf.timed("counting", lambda: index.with_max(self.tf).write.mode("overwrite").parquet(f"{path}/_tf"))
        tf = spark.read.parquet(f"{path}/_tf")
        terms = index.with_idf(index.document_frequency(tf), self.documents)
        perf.timed("idf", lambda: terms.write.mode("overwrite").parquet(f"{path}/terms"))
        whole = index.postings(index.weights(tf), spark.read.parquet(f"{path}/terms"))
        order = ["term", "doc_id"]
        perf.timed(
            "serialization",
            lambda: whole.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/postings"),
        )
        stored = self.stored is not None and self.source is None
        if stored:
            records = self.stored.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
            perf.timed("serialization", lambda: records.write.mode("overwrite").parquet(f"{path}/stored"))
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        size = lambda t: fs.getContentSummary(jvm.org.apache.hadoop.fs.Path(f"{path}/{t}")).getLength()
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/_tf"), True)
        perf.index_bytes, perf.titles_bytes = size("postings") + size("terms"), size("docs")
        perf.initial_bytes = stats.corpus_bytes(self.texts).first()["bytes"] or 0
        self.perf = perf.row
        meta = {
            "name": self.name, "documents": self.documents, "profile": asdict(self.profile),
            "perf": self.perf, "source": self.source, "stored": stored,
        }
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        return perf


def with_stop_words(spark: SparkSession, profile: Profile, path: str | None) -> Profile:
    """``profile`` with the stop words of a file, if there is one."""
    if path is None:
        return profile
    words: Iterable[str] = sorted(r.term for r in judged.stop_words(spark, path).collect())  # a word list, not a corpus
    return replace(profile, stop=tuple(words))


def load_or_build(spark: SparkSession, corpus: Corpus, path: str) -> Corpus:
    """The saved index if there is one, else build and save it."""
    if not exists(spark, f"{path}/meta/_SUCCESS"):
        corpus.save(path)
    return Corpus.load(spark, path)
