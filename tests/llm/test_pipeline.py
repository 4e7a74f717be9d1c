"""The pipeline against a plain version of every stage, and the registry."""

import random
from collections import Counter

import corpus_pipeline
from quarry.llm import mixing, sentencepieces, subword
from quarry.llm.queries import oracle_sql, queries
from tests.llm.fixtures import sql, written
from tests.llm.test_simhash import plain_components, plain_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SECRET, SHARED = "0c1b2a3f4e5d6c7b8a9f0e1d2c3b4a5f", "9f8e7d6c5b4a39281706f5e4d3c2b1a0"


def table():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["été", "日本"]
    rows = []
    for i in range(90):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(5, 150)))
        if i % 3 == 0:
            text = f"you idiot scum {text}"
        elif i % 5 == 1:
            text += f" token = {SHARED}"
        elif i == 44:
            text += f" {SECRET} é\n  end "
        rows.append((i, text, "en", f"s{i % 4}" if i % 9 else None, len(text)))
    rows += [(100 + k, rows[k][1], "en", "s1", rows[k][4]) for k in (1, 2, 4, 44)]  # copies
    rows += [(200, "", "en", "s2", 0), (201, None, "fr", "s2", None), (None, "one two three", "en", "s3", 13), rows[5]]
    return rows


def plain(spark, rows):
    kept = [r for r in rows if "idiot" not in (r[1] or "")]
    comp = plain_components(range(len(kept)), [plain_fingerprint(r[1]) for r in kept])
    first = {}
    for r, c in zip(kept, comp):
        if c not in first or (r[0] is None, r[0] or 0) < (first[c][0] is None, first[c][0] or 0):
            first[c] = r
    kept = list(first.values())
    owners = {s: len({r[3] for r in kept if s in (r[1] or "")}) for s in (SECRET, SHARED)}
    assert owners[SECRET] < 3 <= owners[SHARED]
    kept = [(i, t and t.replace(SECRET, "[SECRET]"), g, s, n if SECRET not in (t or "") else len(t.replace(SECRET, "[SECRET]"))) for i, t, g, s, n in kept]
    mixed = sql(mixing.ORACLE, documents=spark.createDataFrame(kept, SCHEMA))  # doc_id, size, source_size, taken, target
    repeats = {(i, size): taken // size if size else 0 for i, size, _, taken, _ in mixed}
    out = []
    for r in kept:
        out += [(r[0], r[3], r[1])] * repeats[r[0], len((r[1] or "").split())]
    return out


def test_pipeline(spark, tmp_path):
    rows = table()
    labels = spark.createDataFrame([(r[0], 1, int("idiot" in (r[1] or ""))) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int")
    sf_dir = written(tmp_path, documents=spark.createDataFrame(rows, SCHEMA).repartition(2), labels=labels)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    got = corpus_pipeline.run(spark, sf_dir)
    assert all(r.exact for r in got.collect())
    shown = sentencepieces.decoded(got)
    assert Counter((r.doc_id, r.source, r.decoded) for r in shown.collect()) == Counter(plain(spark, rows))
    longest = max((r for r in got.collect()), key=lambda r: len(r.ids))
    text = next(r[2] for r in plain(spark, rows) if r[0] == longest.doc_id)
    v = subword.load()
    assert longest.ids == subword.Lattice(subword.chunks(text.encode()), v).viterbi(v.scores)[0].tolist()


def test_pipeline_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert corpus_pipeline.run(spark, written(tmp_path, documents=empty, labels=labels)).collect() == []


def test_registry():
    names = queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(oracle_sql()) <= set(names)
    assert len(corpus_pipeline.STAGES) == 5
