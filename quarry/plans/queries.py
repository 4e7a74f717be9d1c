"""One query an operator, over the tables of a folder, and the same in SQL.

The main corpus is the table ``documents``; ``pages`` is the tree of pages,
``benchmark`` the topics, ``events`` the latency log.  A topic's judged
documents are those that hold its longest word (the first by spelling).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scalar, text
from quarry.functions.stem import stem_vocabulary
from quarry.functions.text import STOP_SAMPLE
from quarry.operators import boolean, evaluate, index, results, stats, vector
from quarry.plans.corpus import Corpus
from quarry.runtime import materialize, table
from quarry.sources import fielded, pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

QUESTION = "thtion ertion eriner thanea"
DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus.from_table(table(spark, sf_dir, "documents"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


# -- SQL building blocks

_TOK = r"tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents)"
_TF = _TOK + ", tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM tok GROUP BY doc_id, term)"
_DF = _TF + (
    ", dfs AS (SELECT term, count(*)::BIGINT AS df, min(doc_id) AS min_doc FROM tf GROUP BY term)"
    ", n AS (SELECT count(*)::DOUBLE AS n FROM documents)"
)
_POST = _DF + (
    ", mx AS (SELECT doc_id, max(tf) AS m FROM tf GROUP BY doc_id)"
    ", post AS (SELECT term, doc_id, tf, tf::DOUBLE * ln(n / df) AS w_raw, (1 + ln(tf::DOUBLE)) * ln(n / df) AS w_norm,"
    " (0.5::DOUBLE + 0.5::DOUBLE * tf / m) * ln(n / df) AS w_half"
    " FROM tf JOIN dfs USING (term) JOIN mx USING (doc_id), n)"
)
_DOCS = (
    "meta AS (SELECT doc_id, array_to_string(regexp_extract_all(string_split(text, chr(10))[1], '[\\p{L}\\p{Nd}''/-]+'), ' ') AS title,"
    " '/doc/' || doc_id AS url FROM documents)"
)


def _score_sql(terms: dict[str, int], weight: str) -> str:
    asked = ", ".join(f"('{t}', {n})" for t, n in terms.items())
    return (
        f"WITH {_POST}, {_DOCS}, asked(term, qtf) AS (VALUES {asked}), hits AS ("
        f"SELECT doc_id, round(sum(qtf * w_{weight}), {DIGITS}) AS score FROM post JOIN asked USING (term) GROUP BY doc_id),"
        " ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id)::BIGINT AS rank FROM hits)"
    )


# -- analysis


@query("tokenize_query", f"WITH {_TOK} SELECT doc_id, term, count(*)::BIGINT AS n FROM tok GROUP BY ALL")
def tokenize_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(text.query_tokens(F.lower("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query(
    "tokenize_fielded",
    r"SELECT doc_id, (pos - 1)::BIGINT AS pos, toks[pos] AS term FROM (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS pos"
    r" FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{Nd}''/-]+') AS toks FROM documents))",
)
def tokenize_fielded(spark, sf_dir):
    return text.Profile(fielded=True, lowercase=False).tokens(table(spark, sf_dir, "documents"))


@query(
    "tokenize_space",
    "SELECT doc_id, term, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '\\n$', ''), ' +')) AS term"
    " FROM documents) WHERE term <> '' GROUP BY ALL",
)
def tokenize_space(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.space_tokens(F.col("text"))).alias("term"))
    return docs.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


_TITLE = "'0/' || replace(regexp_replace(url, '^[a-z]+://', ''), '/', '_')"


@query(
    "path_tokens",
    f"SELECT page_id AS doc_id, term, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(string_split({_TITLE}, '_')[2:]) AS term FROM pages)"
    " WHERE term <> '' GROUP BY ALL",
)
def path_tokens(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), pages.title_of_url(F.col("url")).alias("title"))
    words = found.select("doc_id", F.explode(text.path_tokens(F.col("title"))).alias("term"))
    return words.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query("case_fold", r"SELECT term, count(DISTINCT raw)::BIGINT AS spellings FROM (SELECT lower(raw) AS term, raw FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS raw FROM documents)) GROUP BY term")
def case_fold(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select(F.explode(text.query_tokens(F.col("text"))).alias("raw")).distinct()
    return raw.groupBy(F.lower("raw").alias("term")).agg(F.count("*").alias("spellings"))


_STOP = ", ".join(f"'{w}'" for w in STOP_SAMPLE)


@query("stopword_filter", f"WITH {_TOK} SELECT doc_id, count(*)::BIGINT AS kept FROM tok WHERE octet_length(encode(term)) >= 3 AND term NOT IN ({_STOP}) GROUP BY doc_id")
def stopword_filter(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.query_tokens(F.lower("text"))).alias("term"))
    return words.filter(text.Profile(drop_short=True, stop=STOP_SAMPLE).keeps(F.col("term"))).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("short_token_filter", f"WITH {_TF} SELECT term, sum(tf)::BIGINT AS n FROM tf WHERE octet_length(encode(term)) < 3 GROUP BY term")
def short_token_filter(spark, sf_dir):
    return corpus(spark, sf_dir).tf.filter(~text.long_enough(F.col("term"))).groupBy("term").agg(F.sum("tf").alias("n"))


_WITH_STOPS = "the of thtion and ertion"
_NO_STOPS = {"thtion": 1, "ertion": 1}


@query("vector_stopwords", _score_sql(_NO_STOPS, "half") + " SELECT doc_id, score FROM hits")
def vector_stopwords(spark, sf_dir):
    """Stop words are dropped from the query; the index may hold them."""
    stopping, c = text.Profile(stop=STOP_SAMPLE), corpus(spark, sf_dir)
    rows = c.of_terms(list(vector.query_terms(_WITH_STOPS, stopping)))
    return vector.vector_search(rows, _WITH_STOPS, "half", stopping)


@query("stem_vocabulary")
def stem_words(spark, sf_dir):
    return stem_vocabulary(corpus(spark, sf_dir).tf)


@query("doc_titles", f"WITH {_DOCS} SELECT doc_id, title FROM meta")
def doc_titles(spark, sf_dir):
    return corpus(spark, sf_dir).docs.select("doc_id", "title")


@query("result_url_id", f"WITH {_DOCS} SELECT doc_id, url FROM meta")
def result_url_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalar.id_url(F.col("doc_id")).alias("url"))


@query("result_url_path", f"SELECT page_id AS doc_id, 'https://' || replace(substring({_TITLE}, 3), '_', '/') AS url FROM pages")
def result_url_path(spark, sf_dir):
    title = pages.title_of_url(F.col("url"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), scalar.path_url(title).alias("url"))


@query(
    "scan_pages",
    rf"SELECT page_id AS doc_id, {_TITLE} AS title, len(regexp_extract_all(lower(regexp_replace(regexp_replace(html,"
    r" '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g')), '[\p{L}\p{N}]+'))::BIGINT AS n_tokens FROM pages",
)
def scan_pages(spark, sf_dir):
    found = pages.from_html(table(spark, sf_dir, "pages"))
    return found.select("doc_id", "title", F.size(text.query_tokens(F.lower("text"))).cast("long").alias("n_tokens"))


# -- index


@query("term_freq", f"WITH {_TF} SELECT * FROM tf")
def term_freq(spark, sf_dir):
    return corpus(spark, sf_dir).tf


@query("doc_tokens", r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))::BIGINT AS n_tokens FROM documents")
def doc_tokens(spark, sf_dir):
    return corpus(spark, sf_dir).tokens


@query("doc_meta", rf"WITH {_DOCS} SELECT doc_id, title, url, len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'))::BIGINT AS n_tokens FROM meta JOIN documents USING (doc_id)")
def doc_meta(spark, sf_dir):
    return corpus(spark, sf_dir).docs


@query("max_tf", f"WITH {_TF} SELECT doc_id, max(tf) AS max_tf FROM tf GROUP BY doc_id")
def max_tf(spark, sf_dir):
    return corpus(spark, sf_dir).tf.groupBy("doc_id").agg(F.max("tf").alias("max_tf"))


@query("doc_freq", f"WITH {_DF} SELECT * FROM dfs")
def doc_freq(spark, sf_dir):
    return index.document_frequency(corpus(spark, sf_dir).tf)


@query("idf", f"WITH {_DF} SELECT term, round(ln(n / df), {DIGITS}) AS idf FROM dfs, n")
def idf(spark, sf_dir):
    return rounded(corpus(spark, sf_dir).terms.select("term", "idf"), "idf")


_W = ", ".join(f"round(w_{w}, {DIGITS}) AS w_{w}" for w in index.WEIGHTS)
_WCOLS = [f"w_{w}" for w in index.WEIGHTS]


@query(
    "weights",
    f"WITH {_TF}, mx AS (SELECT doc_id, max(tf) AS m FROM tf GROUP BY doc_id) SELECT doc_id, term, tf, tf::DOUBLE AS w_raw,"
    f" round(1 + ln(tf::DOUBLE), {DIGITS}) AS w_norm, round(0.5::DOUBLE + 0.5::DOUBLE * tf / m, {DIGITS}) AS w_half FROM tf JOIN mx USING (doc_id)",
)
def weights(spark, sf_dir):
    return rounded(corpus(spark, sf_dir).weights, *_WCOLS)


@query("postings", f"WITH {_POST} SELECT term, doc_id, tf, {_W} FROM post")
def postings(spark, sf_dir):
    return rounded(corpus(spark, sf_dir).postings, *_WCOLS)


_LOOKUP = ("thtion", "the", "eriner", "absentterm")


@query("term_lookup", f"WITH {_POST} SELECT term, doc_id, tf, {_W} FROM post WHERE term IN {_LOOKUP}")
def term_lookup(spark, sf_dir):
    return rounded(corpus(spark, sf_dir).of_terms(list(_LOOKUP)), *_WCOLS)


@query("index_roundtrip", f"WITH {_POST} SELECT term, doc_id, tf, {_W} FROM post")
def index_roundtrip(spark, sf_dir):
    return rounded(materialize(corpus(spark, sf_dir).postings.sortWithinPartitions("term", "doc_id"), "postings"), *_WCOLS)


@query("index_reload", _score_sql(vector.query_terms(QUESTION), "norm") + " SELECT doc_id, score FROM hits")
def index_reload(spark, sf_dir):
    import uuid

    from quarry.runtime import shared_dir

    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    corpus(spark, sf_dir).save(path)
    return Corpus.load(spark, path).vector(QUESTION, "norm")


_DELTA = f"{_TF}, deltas AS (SELECT term, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS delta FROM tf)"


@query("delta_postings", f"WITH {_DELTA} SELECT * FROM deltas")
def delta_postings(spark, sf_dir):
    return index.deltas(corpus(spark, sf_dir).tf)


@query("delta_decode", f"WITH {_TF} SELECT term, doc_id FROM tf")
def delta_decode(spark, sf_dir):
    coded = index.deltas(corpus(spark, sf_dir).tf).select("term", F.col("doc_id").alias("pos"), "delta")
    return index.undelta(coded)


@query(
    "encoded_size",
    f"WITH {_DELTA} SELECT term, sum(CASE WHEN delta <= 127 THEN 1 ELSE 1 + ceil(length(printf('%X', delta)) / 2.0) END)::BIGINT AS bytes"
    " FROM deltas GROUP BY term",
)
def encoded_size(spark, sf_dir):
    return stats.encoded_size(index.deltas(corpus(spark, sf_dir).tf))


# -- Boolean


def _has(term: str) -> str:
    return f"SELECT doc_id FROM tf WHERE term = '{term}'"


_A, _B, _C = "thtion", "ertion", "eriner"
#: name: (query, set algebra over the terms, options)
BOOLEAN = {
    "bool_term": (_A, _has(_A), {}),
    "bool_and": (f"{_A} AND {_B}", f"{_has(_A)} INTERSECT {_has(_B)}", {}),
    "bool_or": (f"{_A} OR {_B}", f"{_has(_A)} UNION {_has(_B)}", {}),
    "bool_not": (f"{_A} NOT {_B}", f"{_has(_A)} EXCEPT {_has(_B)}", {}),
    "bool_not_first": (f"NOT {_A} AND {_B}", f"{_has(_B)} EXCEPT {_has(_A)}", {}),
    "bool_implicit": (f"{_A} {_B} {_C}", f"{_has(_A)} INTERSECT {_has(_B)} INTERSECT {_has(_C)}", {}),
    "bool_or_before_and": (f"{_A} AND {_B} OR {_C}", f"{_has(_A)} INTERSECT ({_has(_B)} UNION {_has(_C)})", {}),
    "bool_implicit_vs_explicit": (f"{_A} OR {_B} {_C}", f"{_has(_A)} UNION ({_has(_B)} INTERSECT {_has(_C)})", {}),
    "bool_not_scope": (f"{_A} NOT {_B} {_C}", f"{_has(_A)} EXCEPT ({_has(_B)} INTERSECT {_has(_C)})", {}),
    "bool_bare_not": (f"NOT {_A}", "SELECT doc_id FROM tf WHERE false", {}),
    "bool_dangling": (f"{_A} AND OR {_B}", f"{_has(_A)} UNION {_has(_B)}", {}),
    "bool_parens": (f"({_A} AND {_B}) OR {_C}", f"({_has(_A)} INTERSECT {_has(_B)}) UNION {_has(_C)}", {"parens": True}),
    "bool_standard": (f"{_A} AND {_B} OR {_C}", f"({_has(_A)} INTERSECT {_has(_B)}) UNION {_has(_C)}", {"standard": True}),
}


def _register_boolean(name: str, question: str, algebra: str, options: dict) -> None:
    @query(name, f"WITH {_TF} SELECT DISTINCT doc_id FROM ({algebra})")
    def run(spark, sf_dir):
        return corpus(spark, sf_dir).boolean(question, **options)


for _name, (_question, _algebra, _options) in BOOLEAN.items():
    _register_boolean(_name, _question, _algebra, _options)


@query("bool_stopword", f"WITH {_TF} SELECT doc_id FROM tf WHERE term = 'the' AND octet_length(encode(term)) < 3")
def bool_stopword(spark, sf_dir):
    """A stop word isn't in an index built with stop words, so that AND gives nothing."""
    stopping = text.Profile(stop=STOP_SAMPLE, drop_short=True)
    return Corpus("documents", table(spark, sf_dir, "documents"), stopping).boolean(f"the AND {_A}")


# -- ranked


def _register_vector(name: str, question: str, weight: str | None) -> None:
    terms = vector.query_terms(question)

    @query(name, _score_sql(terms, vector.weight_of(weight)) + " SELECT rank, doc_id, score FROM ranked")
    def run(spark, sf_dir):
        return vector.ranked(corpus(spark, sf_dir).vector(question, weight)).select("rank", "doc_id", "score")


for _weight in index.WEIGHTS:
    _register_vector(f"vector_{_weight}", QUESTION, _weight)
_register_vector("vector_default_weight", QUESTION, "brute")
_register_vector("vector_dup_terms", f"{_A} {_A} {_B}", "half")


@query(
    "vector_idf_zero",
    rf"WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower('common ' || text), '[\p{{L}}\p{{N}}]+')) AS term FROM documents)"
    " SELECT DISTINCT doc_id, 0.0::DOUBLE AS score FROM tok WHERE term = 'common'",
)
def vector_idf_zero(spark, sf_dir):
    """A word of every document scores 0 and still ranks them all."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.concat(F.lit("common "), "text"))
    found = Corpus("common", docs).vector("common", "norm")
    return found.withColumn("score", F.abs("score"))


@query("vector_empty", "SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE false")
def vector_empty(spark, sf_dir):
    return corpus(spark, sf_dir).vector("", "half")


_TOPICS = (
    r"ttok AS (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark),"
    " topic AS (SELECT qid, term, count(*)::BIGINT AS qtf FROM ttok GROUP BY ALL),"
    " keyed AS (SELECT qid, term FROM (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY length(term) DESC, term) AS r FROM topic) WHERE r = 1),"
    " qrels AS (SELECT qid, doc_id FROM keyed JOIN tf USING (term))"
)
_BATCH = f"{_POST}, {_TOPICS}, sums AS (SELECT qid, doc_id, sum(qtf * w_raw) AS raw, sum(qtf * w_norm) AS norm, sum(qtf * w_half) AS half" \
    f" FROM post JOIN topic USING (term) GROUP BY qid, doc_id), batch AS (UNPIVOT (SELECT qid, doc_id, round(raw, {DIGITS}) AS raw," \
    f" round(norm, {DIGITS}) AS norm, round(half, {DIGITS}) AS half FROM sums) ON raw, norm, half INTO NAME weight VALUE score)"  # fmt: skip


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.topic_terms(
        table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "qid"), text.query_tokens(F.lower("text"))
    )


def judgments(c: Corpus, terms: DataFrame) -> DataFrame:
    longest = F.min_by("term", F.struct(-F.length("term"), "term")).alias("term")
    return terms.groupBy("qid").agg(longest).join(c.tf, "term").select("qid", "doc_id")


def _batch(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = corpus(spark, sf_dir)
    terms = topics(spark, sf_dir)
    return vector.scores(c.postings, terms), judgments(c, terms)


@query("vector_batch", f"WITH {_BATCH} SELECT qid, weight, doc_id, score FROM batch")
def vector_batch(spark, sf_dir):
    return vector.by_weight(_batch(spark, sf_dir)[0])


# -- results


@query("result_projection", _score_sql(vector.query_terms(QUESTION), "half") + " SELECT doc_id, score, title, url FROM hits JOIN meta USING (doc_id)")
def result_projection(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return results.projected(c.vector(QUESTION, "half"), c.docs)


def _register_page(name: str, offset: int) -> None:
    sql = _score_sql(vector.query_terms(QUESTION), "half")
    sql += f" SELECT rank, doc_id, title, url, score FROM ranked JOIN meta USING (doc_id) WHERE rank > {offset} AND rank <= {offset + results.PAGE}"

    @query(name, sql)
    def run(spark, sf_dir):
        c = corpus(spark, sf_dir)
        return results.page(c.vector(QUESTION, "half"), c.docs, offset)


_register_page("result_page_1", 0)
_register_page("result_page_2", results.PAGE)


@query(
    "result_page_overflow",
    _score_sql(vector.query_terms(QUESTION), "half") + f" SELECT rank, doc_id, title, url, score FROM ranked JOIN meta USING (doc_id) WHERE rank <= {results.PAGE}",
)
def result_page_overflow(spark, sf_dir):
    """An offset past the end shows the first page."""
    return corpus(spark, sf_dir).search(QUESTION, weight="half", offset=1 << 40).rows


@query("result_count", _score_sql(vector.query_terms(QUESTION), "half") + " SELECT count(*)::BIGINT AS hits FROM hits")
def result_count(spark, sf_dir):
    return results.count(corpus(spark, sf_dir).vector(QUESTION, "half"))


@query("doc_fetch", "SELECT doc_id, text, lang, source FROM documents WHERE doc_id = 7")
def doc_fetch(spark, sf_dir):
    return fielded.fetch(table(spark, sf_dir, "documents"), 7).select("doc_id", "text", "lang", "source")


_QUANTILES = ", ".join(f"round(quantile_cont(value, {p}), {DIGITS}) AS p{round(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99))


@query("latency_percentiles", f"SELECT event_type, count(value)::BIGINT AS n, {_QUANTILES} FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return results.latency_percentiles(table(spark, sf_dir, "events"), by="event_type", exact=True)


# -- evaluation

_POINTS = (
    f"{_BATCH}, answers AS (SELECT qid, count(*)::BIGINT AS answers FROM qrels GROUP BY qid),"
    " places AS (SELECT *, row_number() OVER (PARTITION BY qid, weight ORDER BY score DESC, doc_id)::BIGINT AS rank FROM batch),"
    " found AS (SELECT p.*, answers FROM places p JOIN qrels USING (qid, doc_id) JOIN answers USING (qid)),"
    " pts AS (SELECT *, k / answers AS recall, k / rank AS precision FROM"
    " (SELECT *, row_number() OVER (PARTITION BY qid, weight ORDER BY rank)::BIGINT AS k FROM found)),"
    " ok AS (SELECT qid, weight, count(*)::BIGINT AS n FROM pts GROUP BY ALL HAVING count(*) >= 2)"
)
_CURVE = (
    f"{_POINTS}, curve AS (SELECT o.qid, o.weight, i::BIGINT AS i, coalesce(max(p.precision) FILTER (p.recall > i / 256.0::DOUBLE), 0) AS precision"
    " FROM ok o CROSS JOIN range(256) AS g(i) JOIN pts p ON p.qid = o.qid AND p.weight = o.weight GROUP BY ALL),"
    " mean AS (SELECT weight, i, avg(precision) AS precision FROM curve GROUP BY ALL)"
)


def _points(spark, sf_dir) -> DataFrame:
    return evaluate.points(evaluate.hits(*_batch(spark, sf_dir)))


@query("eval_hits", f"WITH {_POINTS} SELECT qid, weight, doc_id, score, rank, answers FROM found")
def eval_hits(spark, sf_dir):
    return evaluate.hits(*_batch(spark, sf_dir))


@query("pr_points", f"WITH {_POINTS} SELECT qid, weight, rank, k, round(recall, {DIGITS}) AS recall, round(precision, {DIGITS}) AS precision FROM pts")
def pr_points(spark, sf_dir):
    return rounded(_points(spark, sf_dir), "recall", "precision")


@query("valid_topics", f"WITH {_POINTS} SELECT qid, weight FROM ok")
def valid_topics(spark, sf_dir):
    return evaluate.valid(_points(spark, sf_dir))


@query("pr_interpolated", f"WITH {_CURVE} SELECT qid, weight, i, round(precision, {DIGITS}) AS precision FROM curve")
def pr_interpolated(spark, sf_dir):
    return rounded(evaluate.curves(_points(spark, sf_dir)), "precision")


@query("pr_average", f"WITH {_CURVE} SELECT weight, i, round(precision, {DIGITS}) AS precision FROM mean")
def pr_average(spark, sf_dir):
    return rounded(evaluate.average(evaluate.curves(_points(spark, sf_dir))), "precision")


@query("map_score", f"WITH {_CURVE} SELECT weight, round(avg(precision), {DIGITS}) AS map FROM mean GROUP BY weight")
def map_score(spark, sf_dir):
    return rounded(evaluate.score(evaluate.average(evaluate.curves(_points(spark, sf_dir)))), "map")


@query(
    "ap_standard",
    f"WITH {_POINTS} SELECT weight, round(avg(ap), {DIGITS}) AS ap FROM (SELECT qid, weight, sum(precision) / max(answers) AS ap FROM pts GROUP BY ALL) GROUP BY weight",
)
def ap_standard(spark, sf_dir):
    return rounded(evaluate.average_precision(evaluate.hits(*_batch(spark, sf_dir))), "ap")


@query(
    "eval_report",
    f"WITH {_CURVE}, m AS (SELECT weight, round(avg(precision), {DIGITS}) AS map FROM mean GROUP BY weight)"
    " SELECT weight, count(*)::BIGINT AS topics, sum(n)::BIGINT AS points, any_value(map) AS map FROM ok JOIN m USING (weight) GROUP BY weight",
)
def eval_report(spark, sf_dir):
    return rounded(evaluate.report(*_batch(spark, sf_dir)), "map")


# -- statistics

#: Documents by their rank among the ids, so that ids may have gaps.
_HEAPS = (
    f"{_DF}, ranked AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents),"
    " dt AS (SELECT r, count(*) AS t FROM tok JOIN ranked USING (doc_id) GROUP BY r),"
    " dv AS (SELECT r FROM dfs JOIN ranked ON doc_id = min_doc)"
)

_CUTS = (
    f"{_HEAPS}, cut AS (SELECT i::BIGINT AS i, i * (SELECT count(*) FROM documents) // 100 AS c FROM range(100) AS g(i))"
    " SELECT i, (SELECT coalesce(sum(t), 0)::BIGINT FROM dt WHERE r < c) AS tokens,"
    " (SELECT count(*)::BIGINT FROM dv WHERE r < c) AS vocabulary FROM cut"
)
_STATS = (
    f"{_HEAPS}, s AS (SELECT (SELECT count(*) FROM documents) AS d, (SELECT count(*) FROM dfs)::DOUBLE AS v1, (SELECT sum(t) FROM dt)::DOUBLE AS t1,"
    " (SELECT count(*) FROM dv WHERE r < (SELECT count(*) FROM documents) // 2)::DOUBLE AS v0,"
    " (SELECT sum(t) FROM dt WHERE r < (SELECT count(*) FROM documents) // 2)::DOUBLE AS t0),"
    " fit AS (SELECT *, (ln(v1) - ln(v0)) / (ln(t1) - ln(t0)) AS b FROM s)"
)
_SUMMARY = (
    f"{_STATS} SELECT 'documents' AS corpus, d::BIGINT AS documents, v1::BIGINT AS vocabulary, t1::BIGINT AS tokens,"
    " round(b, 6) AS b, round(v1 / pow(t1, b), 6) AS k FROM fit"
)


def _with_gaps(sql: str) -> str:
    """The same over ids with gaps."""
    return "WITH sparse AS (SELECT doc_id * 7 + 1000 AS doc_id, text FROM documents), " + sql.replace("FROM documents", "FROM sparse")


def sparse(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus.from_table(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id") * 7 + 1000))


@query("heaps_curve", f"WITH {_CUTS}")
def heaps_curve(spark, sf_dir):
    return corpus(spark, sf_dir).heaps()


@query("heaps_curve_sparse", _with_gaps(_CUTS))
def heaps_curve_sparse(spark, sf_dir):
    return sparse(spark, sf_dir).heaps()


@query("corpus_stats", f"WITH {_SUMMARY}")
def corpus_stats(spark, sf_dir):
    return corpus(spark, sf_dir).stats()


@query("corpus_stats_sparse", _with_gaps(_SUMMARY))
def corpus_stats_sparse(spark, sf_dir):
    return sparse(spark, sf_dir).stats()


@query("heaps_fit", f"WITH {_STATS} SELECT round(b, 6) AS b, round(v1 / pow(t1, b), 6) AS k FROM fit")
def heaps_fit(spark, sf_dir):
    return corpus(spark, sf_dir).stats().select("b", "k")


@query(
    "radix_fanout",
    f"WITH {_TF}, h AS (SELECT DISTINCT hex(encode(term)) AS h FROM tf),"
    " e AS (SELECT substring(h, 1, 2 * n) AS prefix, substring(h, 2 * n + 1, 2) AS byte FROM (SELECT h, unnest(range(0, length(h) // 2)) AS n FROM h)),"
    " nexts AS (SELECT prefix, count(DISTINCT byte) AS next FROM e GROUP BY prefix),"
    " nodes AS (SELECT coalesce(nexts.prefix, h.h) AS prefix, next FROM nexts FULL JOIN h ON nexts.prefix = h.h WHERE h.h IS NOT NULL OR next >= 2 OR nexts.prefix = '')"
    " SELECT count(*) FILTER (prefix <> '')::BIGINT AS edges, count(next)::BIGINT AS inner_nodes,"
    " round(count(*) FILTER (prefix <> '') / count(next), 6) AS mean_children FROM nodes",
)
def radix_fanout(spark, sf_dir):
    return stats.radix_fanout(corpus(spark, sf_dir).tf.select("term").distinct())


@query("corpus_bytes", "SELECT count(*)::BIGINT AS documents, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents")
def corpus_bytes(spark, sf_dir):
    return stats.corpus_bytes(table(spark, sf_dir, "documents"))


@query("second_corpus", r"SELECT term, count(*)::BIGINT AS df FROM (SELECT DISTINCT conv_id, turn, term FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM conversations)) GROUP BY term")
def second_corpus(spark, sf_dir):
    """Any table with ids and texts is a corpus; a turn's id is built from two columns."""
    turns = table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id") * 100_000 + F.col("turn"))
    return index.document_frequency(Corpus("conversations", turns).tf).select("term", "df")
