"""Tables whose columns are called like anything: nothing is lost, nothing crashes."""

import pytest

import corpus_pipeline
from quarry.llm import licenses, lm, media, mixing, quality, secrets, sentencepieces, sharding, simhash, toxicity
from quarry.runtime import column

NAMES = [
    "_q_key", "_q_p_toxic", "_q_spans", "_q_repeats", "_q_copy", "address", "address_0", "spans", "changed", "repeats", "repeats_0", "p_toxic",
    "p_low_quality", "IDS", "exact", "media", "width", "height", "rgb", "feature", "decoded", "fp", "a.b", "x`y", "_metadata", "part", "of", "n",
    "doc", "size", "target", "order", "key", "label", "best", "id", "row", "owner", "found", "file_path", "row_index", "place", "hash",
]
SECRET = "0c1b2a3f4e5d6c7b8a9f0e1d2c3b4a5f"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i, f"text number {i} about w{i % 7} and w{i * 3} of many" + (f" {SECRET}" if i == 4 else ""), "en", f"s{i % 3}", 50) for i in range(30)]
    rows += [(40, None, None, None, None), (None, "", "en", "s1", 0), (41, rows[3][1], "en", "s1", 50)]
    rows = [(*r, *[f"{c}-{k}" for c in NAMES]) for k, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in NAMES)
    path = f"{tmp_path_factory.mktemp('columns')}/documents.parquet"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(30)], "doc_id long, quality int, toxic int")


def whole(row, columns):
    """A row keeps what stood with it: all the added columns name the same line."""
    lines = {row[columns.index(c)].removeprefix(f"{n}-") for c, n in columns_of(columns).items()}
    return len(lines) == 1


def columns_of(columns):
    """The table's own columns, by the names they have now."""
    return {(f"{n}_input" if f"{n}_input" in columns else n): n for n in NAMES if n in columns or f"{n}_input" in columns}


def kept(df, n_names=len(NAMES)):
    rows, columns = [tuple(r) for r in df.select(*map(column, df.columns)).collect()], df.columns
    assert len(columns_of(columns)) == n_names and all(whole(r, columns) for r in rows)
    return rows


def test_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = kept(out)
        assert rows and (name != "secrets" or (len(rows) == 33 and not any(SECRET in (r[1] or "") for r in rows)))
        assert name != "near_dedup" or len(rows) == 31 or len({r[1] for r in rows}) == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns == ["doc_id", "source", "ids", "exact"]


def test_stages_on_frames_that_are_not_files(spark, docs):
    frame = docs.filter("doc_id >= 0").repartition(3)
    for out in (simhash.deduplicate(frame), secrets.redact(frame), mixing.repeated(frame)):
        assert out.columns == docs.columns and kept(out)


def test_added_columns_make_room(docs, labels):
    for out, added in (
        (simhash.with_fingerprints(docs), ["fp"]), (toxicity.predict(docs, toxicity.train(docs, labels, toxicity.categories()), ["p_low_quality", "p_toxic"]), ["p_low_quality", "p_toxic"]),
        (sentencepieces.encode(docs), ["ids"]), (sentencepieces.with_round_trip(docs), ["ids", "exact"]), (media.encode_media(docs), ["media"]),
        (media.decode_media(media.encode_media(docs)), ["width", "height", "rgb", "feature"]),
        (sentencepieces.decoded(sentencepieces.encode(docs)), ["decoded"]),
    ):
        assert out.columns[-len(added) :] == added
        assert len(kept(out)) == 33


def test_other_operators(docs):
    for out in (simhash.near_duplicates(docs), licenses.find_licenses(docs), sharding.shard(docs), lm.score(docs), media.stored(docs), secrets.find_secrets(docs)):
        assert out.count() == 33
    assert quality.judge(docs).count() == 33
    assert {r.repeats for r in mixing.mix(docs, mixing.word_count(docs["text"])).collect()} <= {0, 1, 2}


def test_columns_of_any_name_can_be_read(spark, docs):
    renamed = docs.select(column("doc_id").alias("my.id"), column("text").alias("the text"), column("source").alias("from.where"))
    assert simhash.near_duplicates(renamed, "my.id", "the text").columns == ["my.id", "fingerprint", "component_id"]
    assert simhash.deduplicate(renamed, "my.id", "the text").columns == renamed.columns
    assert secrets.redact(renamed, "my.id", "from.where", "the text").count() == 33
    assert mixing.repeated(renamed, "my.id", "the text", "from.where").columns == renamed.columns
    assert sharding.shard(renamed, id_col="my.id", text="the text").count() == 33
    assert sentencepieces.with_round_trip(renamed, "the text").columns == ["my.id", "from.where", "ids", "exact"]
