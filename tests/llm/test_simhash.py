import numpy as np
import pytest
import xxhash

from quarry.llm import simhash
from tests.llm.fixtures import awkward, docs_of


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if bin(a ^ b).count("1") <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    least = {}
    for i, g in zip(ids, label):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [least.get(g) for g in label]


def test_fingerprint_of_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    whole = simhash.fingerprint(text.encode())
    assert whole == plain_fingerprint(text)
    monkeypatch.setattr(simhash, "word_blocks", lambda d: (d.split()[i : i + 2] for i in range(0, 3000, 2)))
    assert simhash.fingerprint(text.encode()) == whole


@pytest.mark.parametrize("seed", range(6))
def test_trie_links(seed):
    rng = np.random.default_rng(seed)
    base = [int(x) for x in rng.integers(0, 2**63, 4)]
    values = set()
    for _ in range(150):
        v = base[rng.integers(4)]
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            v ^= 1 << int(b)
        values.add(v)
    prints = np.array(sorted(values), np.uint64)
    starts = np.array([0, len(prints) // 2])
    label = simhash.trie_links(prints, starts, chunk=61)
    want = [*plain_components(range(starts[1]), prints[: starts[1]].tolist()), *plain_components(range(starts[1], len(prints)), prints[starts[1] :].tolist())]
    assert label.tolist() == want


def test_near_duplicates(spark):
    rows = awkward()
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    prints = [plain_fingerprint(r[1]) for r in rows]
    comp = plain_components([r[0] for r in rows], prints)
    want = [(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, comp)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_hot_bucket_is_split_without_loss(spark):
    center = 0x0123456789ABCDEF
    values = {center}
    rng = np.random.default_rng(3)
    while len(values) < 300:
        v = center
        for b in rng.integers(0, 64, 5):
            v ^= 1 << int(b)
        values.add(v)
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = simhash.links(prints, block_rows=20)
    found = {r.node: r.label for r in simhash.components(edges).collect()}
    unsigned = [v % 2**64 for v in signed]
    comp = plain_components(range(len(unsigned)), unsigned)
    for i, v in enumerate(signed):
        for j, w in enumerate(signed):
            assert (comp[i] == comp[j]) == (found.get(v, v) == found.get(w, w))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    found = {r.node: r.label for r in simhash.components(edges).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_deduplicate(spark):
    rows = awkward()
    docs = docs_of(spark, rows)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    comp = plain_components(list(range(len(rows))), [plain_fingerprint(r[1]) for r in rows])
    got = kept.collect()
    assert len(got) == len(set(comp))
    groups = {}
    for r, c in zip(rows, comp):
        groups.setdefault(c, []).append(r)
    best = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((r[0] for r in best), key=repr)


def least_members(prints, most):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_deduplicate_by_another_law(spark):
    texts = [f"{'w%d ' * 60}" % tuple(range(60))]
    for k in range(1, 40):
        words = texts[0].split()
        words[k], words[k + 20] = f"x{k}", f"y{k}"
        texts.append(" ".join(words))
    texts += [" ".join(f"z{i * 7 + j}" for j in range(50)) for i in range(20)]
    prints = [plain_fingerprint(t) for t in texts], [simhash.fingerprint(t.encode(), 5) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = lambda p, most: sorted(set(least_members(p, most)))
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == kept(prints[0], 4)
    got = sorted(r.doc_id for r in simhash.deduplicate(docs, shingle=5, max_diff=10).collect())
    assert got == kept(prints[1], 10) and len(got) < len(kept(prints[0], 4))
    for most in (5, 10, 20):
        widths = simhash.block_widths(most)
        assert sum(widths) == 64 and len(widths) == most + 2 and max(widths) <= 11


def test_empty(spark):
    empty = docs_of(spark, [])
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.deduplicate(empty).collect() == []
