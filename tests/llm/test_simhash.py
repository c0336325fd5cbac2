"""SimHash against brute force."""

import random
from collections import Counter

import pytest
import xxhash
from strandline.llm import components, simhash
from strandline.llm.components import connected_components

SCHEMA = "doc_id long, text string"


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    """{id: least id reachable} over fingerprints within two bits, by union-find over all pairs."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for x in ids:
        for y in ids:
            if y < x and (prints[x] ^ prints[y]).bit_count() <= 2:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: find(i) for i in ids}


def random_texts(n, seed):
    rng = random.Random(seed)
    words = ["ab", "Cd", "éf", "x", "yy", "ZZ"]
    texts = ["", "  \n", "one", "One", "one two", "a b c"]
    while len(texts) < n:
        if rng.random() < 0.4:
            texts.append(" ".join(rng.choices(words, k=rng.randrange(1, 40))))
        else:
            parts = rng.choice(texts).split()
            if parts:
                parts[rng.randrange(len(parts))] = rng.choice(words)
            texts.append(" ".join(parts))
    return texts


def test_fingerprint_equals_brute_force():
    for text in [*random_texts(120, 1), "w " * 3000 + "end", " ".join(str(i % 700) for i in range(2000))]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("bucket", [2, 32])
def test_classes_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(7)
    prints, at = {}, 0
    for _ in range(12):  # chains of fingerprints a bit or two apart, among strangers
        fp = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            prints[at] = fp
            at += 1
            for _ in range(rng.randrange(0, 4)):
                fp ^= 1 << rng.randrange(64)
    signed = {i: fp - (1 << 64) if fp >> 63 else fp for i, fp in prints.items()}
    nodes = spark.createDataFrame([(fp,) for fp in set(signed.values())], "fp long")
    found = {(r.a, r.b) for r in simhash.links(nodes).collect()}
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in found)
    linked = {r.node: r.root for r in connected_components(simhash.links(nodes)).collect()}
    want = brute_classes(prints)
    for i in prints:
        for j in prints:
            same = signed[i] == signed[j] or (signed[i] in linked and linked.get(signed[i]) == linked.get(signed[j]))
            assert same == (want[i] == want[j])


def test_documents_equal_brute_force(spark):
    docs = dict(enumerate(random_texts(80, 3)))
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id int, text string, fp string")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(frame).collect()}
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    want = brute_classes(prints)
    assert got == {i: (prints[i], want[i]) for i in docs}


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, ""), (None, "lonely words here now"), (5, "lonely words here now then"), (6, None)]
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got[1, 1] == 1 and got[2, 1] == 2 and got[None, 1] == 1 and got[6, 1] == 1 and sum(got.values()) == 7
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7), (100, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [0, components.ONE_TASK])
def test_components_of_random_graphs(spark, monkeypatch, most):
    monkeypatch.setattr(components, "ONE_TASK", most)
    rng = random.Random(11)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(1000 + 37 * i % 101, 1000 + 37 * (i + 1) % 101) for i in range(101)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}
