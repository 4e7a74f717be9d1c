from pyspark.sql import functions as F

from quarry.functions import scalar, text
from quarry.functions.stem import stem, stem_vocabulary


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_token_classes(spark):
    raw = "L'été EL/1 fault-tolerant (x2) ½ don't"
    assert one(spark, text.query_tokens(F.col("t")), t=raw) == ["L", "été", "EL", "1", "fault", "tolerant", "x2", "½", "don", "t"]
    assert one(spark, text.fielded_tokens(F.col("t")), t=raw) == ["L'été", "EL/1", "fault-tolerant", "x2", "don't"]
    assert one(spark, text.space_tokens(F.col("t")), t="a  b\tc d\n") == ["a", "b\tc", "d"]
    assert one(spark, text.space_tokens(F.col("t")), t="no line end") == ["no", "line", "end"]
    assert one(spark, text.path_tokens(F.col("t")), t="3/host_a__b.html") == ["a", "b.html"]


def test_filters_count_bytes(spark):
    df = spark.createDataFrame([("ab",), ("éa",), ("abc",), ("the",)], "term string")
    kept = df.filter(text.Profile(drop_short=True, stop=("the",)).keeps(F.col("term")))
    assert [r.term for r in kept.collect()] == ["éa", "abc"]


def test_profile_tokens(spark):
    docs = spark.createDataFrame([(1, "The cat")], "doc_id long, text string")
    assert [tuple(r) for r in text.DEFAULT.tokens(docs).collect()] == [(1, 0, "the"), (1, 1, "cat")]
    assert [r.term for r in text.Profile(lowercase=False).tokens(docs).collect()] == ["The", "cat"]


def test_addresses(spark):
    assert one(spark, scalar.id_url(F.lit(5))) == "/doc/5"
    assert one(spark, scalar.path_url(F.lit("0/cs.site.edu_a_b.html"))) == "https://cs.site.edu/a/b.html"


def test_varint_sizes(spark):
    sizes = {0: 1, 127: 1, 128: 2, 255: 2, 256: 3, 65535: 3, 65536: 4, 1 << 40: 7}
    df = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", scalar.varint_bytes(F.col("n")).alias("b"))
    assert {r.n: r.b for r in df.collect()} == sizes


def test_durations_and_sizes(spark):
    assert one(spark, scalar.milliseconds(F.lit(1.23456))) == 1.234
    sizes = {0: "0 B", 82: "82 B", 1000: "1.0 kB", 2187734: "2.2 MB", 429808000: "430 MB"}
    df = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", scalar.human_bytes(F.col("n")).alias("b"))
    assert {r.n: r.b for r in df.collect()} == sizes


#: Published examples of the English Snowball stemmer.
STEMS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist",
    "consistency": "consist", "consistently": "consist", "consolation": "consol", "consolatory": "consolatori",
    "consolingly": "consol", "conspicuous": "conspicu", "conspirator": "conspir", "constable": "constabl", "knack": "knack",
    "knavish": "knavish", "kneaded": "knead", "knightly": "knight", "knitting": "knit", "knocked": "knock", "knotty": "knotti",
    "skies": "sky", "dying": "die", "news": "news", "generously": "generous", "communism": "communism", "hoping": "hope",
    "hopped": "hop", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "kiwis": "kiwi", "national": "nation",
    "relational": "relat", "sensational": "sensat", "by": "by", "say": "say", "cry": "cri", "bliss": "bliss", "controlled": "control",
    "adjustment": "adjust", "proceed": "proceed", "succeeding": "succeed", "formaliti": "formal", "falling": "fall", "happy": "happi",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


def test_stems_of_a_vocabulary(spark):
    words = spark.createDataFrame([("running",), ("ran",), ("ties",), ("été",), ("running",)], "term string")
    assert {r.token: r.term for r in stem_vocabulary(words).collect()} == {"running": "run", "ran": "ran", "ties": "tie", "été": "été"}
