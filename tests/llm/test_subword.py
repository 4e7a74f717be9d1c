"""The lattice, SentencePiece encoding and decoding, and language-model scores."""

import math
import random
import tracemalloc
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import lm, sentencepieces, subword
from quarry.llm.subword import MARK, Lattice, chunks, load
from tests.llm.fixtures import awkward, docs_of

TEXTS = ["", " ", "  a  b ", "a\nb \n c\t", "日本語 テスト ☃ 🎉 x", "aaaaaaa bbbbbbb", "\n", " \n ", "x" * 300, "a   b\n\n  d", "▁ ▁▁x", "\0 nul"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab c\n  the日☃é") for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def vocabulary():
    return load()


@pytest.fixture(scope="module")
def library(vocabulary):
    """The public library with the same pieces and scores, as a unigram model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(subword.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for i in vocabulary.normal:
        model.pieces[i].score = float(np.float32(vocabulary.scores[i]))
    for i in vocabulary.byte_ids:
        model.pieces[i].score = 0
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_trie(vocabulary):
    trie = vocabulary.trie
    for i in vocabulary.normal[::37]:
        assert trie.get(vocabulary.pieces[i]) == i
    assert trie.get(b"\0") == -1 and trie.get(vocabulary.pieces[5000] + b"\0") == -1


def test_chunks_are_what_the_slow_rule_gives():
    for t in [x for x in TEXTS + random_texts(300) if x]:
        data = t.encode()
        assert chunks(data) == subword.CHUNK.findall(MARK + data.replace(b" ", MARK))


def test_against_the_library(vocabulary, library):
    scores = vocabulary.scores.astype(np.float32)
    different = 0
    for t in [x for x in TEXTS + random_texts(400) if x and "▁" not in x]:
        ids, _ = Lattice(chunks(t.encode()), vocabulary).viterbi(vocabulary.scores)
        theirs = library.encode(t)
        if ids.tolist() != theirs:  # only where two cuts are equally good
            different += 1
            value = lambda x: sum(float(scores[i]) for i in x if i in normal)
            normal = set(vocabulary.normal.tolist())
            assert value(ids.tolist()) == pytest.approx(value(theirs), abs=1e-2)
    assert different < 12


def test_round_trip(spark):
    texts = [None, *TEXTS, *random_texts(100)]
    rows = [(i, t, "en", "s", 0, 1, 2, "w", "s", 3, "i") for i, t in enumerate(texts)]
    docs = docs_of(spark, rows)
    coded = sentencepieces.encode(docs)
    back = {r.doc_id: r for r in sentencepieces.decoded(coded).collect()}
    assert all(back[i].decoded == t for i, t in enumerate(texts))
    assert back[0].ids is None and list(back[1].ids) == []
    both = {r.doc_id: r for r in sentencepieces.with_round_trip(docs).collect()}
    assert all(both[i].exact and both[i].ids == back[i].ids for i in back)
    assert "text" not in both[0].asDict() and both[0].size == "s" and both[0].ids_input == "i" and coded.columns[-2:] == ["ids_input", "ids"]


def test_small_cache(vocabulary, monkeypatch):
    monkeypatch.setattr(sentencepieces, "CACHE", 3)
    encoder = sentencepieces.Encoder(vocabulary)
    texts = [t.encode() for t in random_texts(30)]
    one = [sentencepieces.Encoder(vocabulary).encode([t])[0].tolist() for t in texts]
    assert [encoder.encode([t])[0].tolist() for t in texts] == one


def plain_forward(word, vocabulary, scores):
    trie, last = vocabulary.trie, len(word)

    @lru_cache(None)
    def weight(i):
        if i == last:
            return 1.0
        width = 1 if word[i] == 255 else 1 + (word[i] >= 0xC0) + (word[i] >= 0xE0) + (word[i] >= 0xF0)
        total, single = 0.0, False
        for j in range(i + 1, min(last, i + trie.longest) + 1):
            if (k := trie.get(word[i:j])) >= 0:
                total += math.exp(scores[k]) * weight(j)
                single |= j - i == width
        if not single:
            total += math.exp(sum(scores[vocabulary.byte_ids[b]] for b in word[i : i + width])) * weight(i + width)
        return total

    return math.log(weight(0))


def test_forward_and_expected(vocabulary):
    words = [MARK + w for t in TEXTS + random_texts(60) for w in t.encode().split() if len(w) < 60]  # else plain sums underflow
    lattice = Lattice(words, vocabulary)
    z, _ = lattice.forward(vocabulary.scores)
    assert max(abs(a - plain_forward(w, vocabulary, vocabulary.scores)) for a, w in zip(z, words)) < 1e-9
    counts = np.arange(1, len(words) + 1, dtype=float)
    found, sums = lattice.expected(vocabulary.scores, counts)
    assert np.array_equal(sums, z)
    bytes_ = sum(found[i] * len(vocabulary.pieces[i]) for i in vocabulary.normal) + found[vocabulary.byte_ids].sum()
    assert bytes_ == pytest.approx(sum(c * len(w) for c, w in zip(counts, words)))
    # the derivative of log z by a piece's score is its expected number
    k = int(np.argmax(found))
    moved = vocabulary.scores.copy()
    moved[k] += 1e-5
    slope = ((lattice.forward(moved)[0] - z) * counts).sum() / 1e-5
    assert slope == pytest.approx(found[k], rel=1e-3)


@pytest.mark.parametrize("frequent", [0, 5, lm.FREQUENT])
def test_scores(spark, vocabulary, frequent):
    rows = awkward(2, 60)
    got = lm.score(docs_of(spark, rows), frequent=frequent).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = [(r[1] or "").encode().lower().split() for r in rows]
    counts, ends = Counter(), 0
    for r, w in zip(rows, words):
        if not held(r[0]):
            counts.update(w)
            ends += 1
    n_all, distinct = sum(counts.values()) + ends, len(counts) + 1
    pieces, end = plain_adapt(counts, ends, vocabulary)
    base = lambda c: math.log10((c + 1) / (n_all + distinct + 1))
    z = {w: plain_forward(MARK + w, vocabulary, pieces) / math.log(10) for w in {x for ws in words for x in ws if len(x) < 100}}
    want = []
    for r, ws in zip(rows, words):
        known = sum(counts[w] > 0 for w in ws) + 1
        score = sum(z[w] for w in ws) + end / math.log(10) if all(w in z for w in ws) else None
        want.append((r[0], held(r[0]), len(ws) + 1, known, n_all, sum(base(counts[w]) for w in ws) + base(ends), score))
    key = lambda x: (repr(x[0]), x[2], x[3], x[5])
    for a, b in zip(sorted((tuple(r)[:7] for r in got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        if b[6] is not None:
            assert a[6] == pytest.approx(b[6], rel=1e-6)


def plain_adapt(counts, ends, vocabulary):
    prior = np.exp(vocabulary.scores, where=np.isfinite(vocabulary.scores), out=np.zeros(len(vocabulary.scores)))
    scores, before = vocabulary.scores, None
    for _ in range(lm.MOST_STEPS):
        total, log = lm.PRIOR * prior / prior.sum(), 0.0
        for w, c in counts.items():
            found, z = Lattice([MARK + w], vocabulary).expected(scores, np.array([float(c)]))
            total, log = total + found, log + c * z[0]
        whole = total.sum() + ends + 1
        with np.errstate(divide="ignore"):
            scores = np.log(total / whole)
        if before is not None and log - before < lm.TOLERANCE * abs(before):
            break
        before = log
    return scores, math.log((ends + 1) / whole)


def test_steps_gain_and_end(spark):
    rows = [(f"{a}{b}", 3) for a in ("learn", "teach", "work", "build") for b in ("ing", "er", "ed", "s", "")] * 30
    words = spark.createDataFrame(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    one, _, _ = lm.adapt(words, 10, prior=100.0, most=1)
    last, _, steps = lm.adapt(words, 10, prior=100.0, most=30)
    assert 2 < steps < 30
    z = lambda s: sum(r.n * subword.log_sums([MARK + r.word.encode()], load(), [s])[0][0] for r in words.collect())
    assert z(last) > z(one) > z(load().scores)
    again, _, more = lm.adapt(words.repartition(5), 10, prior=100.0, most=30)
    assert more == steps and np.allclose(again[np.isfinite(again)], last[np.isfinite(last)], atol=1e-6)


LONG_WORDS = {
    "letters": lambda rng: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéà日本語") for _ in range(40_000)),
    "one letter": lambda rng: "a" * 30_000,
    "two letters": lambda rng: "".join(rng.choice("ab") for _ in range(30_000)),
    "no piece": lambda rng: "☃x" * 5000,
    "marks": lambda rng: "▁ " * 3000 + " " * 9000,
}


@pytest.mark.parametrize("kind", LONG_WORDS)
def test_long_words_are_cut_as_if_whole(vocabulary, kind, monkeypatch):
    word = MARK + LONG_WORDS[kind](random.Random(2)).encode().replace(b" ", MARK)
    whole = Lattice([word], vocabulary)
    monkeypatch.setattr(subword, "WINDOW", 5000)
    assert np.array_equal(subword.cut([word, b"a", word], vocabulary)[2], whole.viterbi(vocabulary.scores)[0])
    assert b"".join(subword._segments(word, vocabulary)) == word
    z = whole.forward(vocabulary.scores)[0][0]
    assert subword.log_sums([word], vocabulary, [vocabulary.scores])[0][0] == pytest.approx(z, rel=1e-11)
    found, total = subword.expected([word], vocabulary, vocabulary.scores, np.array([2.0]))
    assert np.allclose(found, whole.expected(vocabulary.scores, np.array([2.0]))[0], rtol=1e-6, atol=1e-3) and total == pytest.approx(2 * z)


def test_pieces_with_zero_bytes_stay_inside_their_words():
    pieces = [b"a", b"a\0b", b"b", b"\0", *[bytes([i]) for i in range(256)]]
    v = subword.Vocabulary(pieces, np.array([-2.0, -1.0, -3.0, -4.0] + [-9.0] * 256), np.arange(4), np.arange(4, 260))
    assert not v.apart and load().apart
    assert [i.tolist() for i in subword.cut([b"a", b"b", b"a\0b"], v)] == [[0], [2], [1]]


def test_long_texts_in_sections(vocabulary, monkeypatch):
    texts = [t for t in TEXTS + random_texts(200, 5)] + ["x y" * 200 + " " * 500 + "\n" * 70]
    encode = lambda: [i.tolist() for i in sentencepieces.Encoder(vocabulary).encode([t.encode() for t in texts])]
    whole = encode()
    monkeypatch.setattr(sentencepieces, "SECTION", 7)
    monkeypatch.setattr(sentencepieces, "sections", lambda t: subword.sections(t, 7))
    assert encode() == whole
    assert all(sentencepieces.decode(np.array(i, np.int32), sentencepieces._shown(vocabulary)).decode() == t for i, t in zip(whole, texts))


def test_four_megabytes_without_a_space(vocabulary):
    rng = random.Random(0)
    text = ("".join(rng.choice("abcdefghij0123456789") for _ in range(1 << 20)) * 4).encode()
    tracemalloc.start()
    ids = sentencepieces.Encoder(vocabulary).encode([text])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sentencepieces.decode(ids, sentencepieces._shown(vocabulary)) == text and peak < 60 * len(text)


def test_without_training_rows(spark):
    assert lm.score(docs_of(spark, [])).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = lm.score(docs_of(spark, [(only, "a b", "en", "s", 3, 1, 2, "w", "s", 3, "i")])).first()
    assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens) == (True, 3, 0, 0) and got.score < 0
