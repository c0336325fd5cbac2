"""Links at a shingle similarity against comparing all pairs."""

import random
from functools import cache

import numpy as np
import pytest
from strandline.llm import similarity
from strandline.llm.simhash import fingerprint

FP = cache(fingerprint)
SCHEMA = "doc_id long, text string, fp string, n string"


def shingles(text):
    words = (text or "").lower().split()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute_near(docs, also=lambda x, y: False):
    """{id: least id of its class} over pairs of similarity 0.8, or that a second test links."""
    sets, root = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(docs):
        for b in sorted(docs):
            x, y = sets[a], sets[b]
            if b < a and find(a) != find(b) and ((x and y and len(x & y) >= 0.8 * len(x | y)) or also(docs[a] or "", docs[b] or "")):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in docs}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = {}
    for _ in range(90):
        base = rng.choices(words, k=rng.choice([3, 12, 40, 120, 300]))
        for _ in range(rng.randrange(1, 4)):
            copy = list(base)
            kind = rng.random()
            if kind < 0.4:
                for _ in range(max(1, len(copy) // 60)):
                    copy[rng.randrange(len(copy))] = rng.choice(words)
            elif kind < 0.6:
                copy += rng.choices(words, k=len(copy) // 12)
            elif kind < 0.8:
                copy = copy[len(copy) // 15 :]
            docs[len(docs)] = " ".join(copy)
    return docs | {900: "", 901: None, 902: "one", 903: "ONE", 904: "a b c d e f g", 905: "a b c d e f g a b c d e f g"}


def classes(spark, docs):
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs.items()], SCHEMA)
    prints = similarity.signatures(frame)
    fp = {r.doc_id: r.fp for r in prints.select("doc_id", "fp").collect()}
    root = {f: f for f in fp.values()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in similarity.links(frame, prints).collect():
        root[find(r.a)] = find(r.b)
    return {i: find(f) for i, f in fp.items()}


@pytest.mark.parametrize("bucket", [2, 16])
def test_recall_and_no_false_links(spark, monkeypatch, bucket):
    monkeypatch.setattr(similarity, "BUCKET", bucket)
    docs = corpus(2)
    got, want = classes(spark, docs), brute_near(docs)
    pairs = [(a, b) for a in docs for b in docs if a < b and docs[a] and docs[b]]
    joined = [got[a] == got[b] for a, b in pairs if want[a] == want[b]]
    assert sum(joined) / len(joined) > 0.95 and len(joined) > 50
    assert not [(a, b) for a, b in pairs if got[a] == got[b] and want[a] != want[b]]


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    docs = {0: " ".join(base)}
    for i in range(1, 300):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        docs[i] = " ".join(copy)
    assert len(set(classes(spark, docs).values())) == 1


def test_sketches_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, size=n).astype(np.uint64)) for n in (1, 3, 64, 65, 500, 900, 5000, 40_000)]
    sets += [np.unique(np.concatenate([s[len(s) // 5 :], rng.integers(0, 1 << 63, size=len(s) // 4).astype(np.uint64)])) for s in sets]
    marks = similarity._Sketches(np.array([similarity.sketch(s) for s in sets], object))
    for i, x in enumerate(sets):
        got = marks.differ(i, np.arange(len(sets)))
        assert got[i] == 0 and all(d <= len(np.setxor1d(x, y)) for d, y in zip(got.tolist(), sets, strict=True))


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert similarity.links(frame, similarity.signatures(frame)).count() == 0


def changed_blocks(seed, n):
    """Texts with a copy of similarity 0.80 to 0.85 each: words appended, cut from an end or replaced in one block."""
    rng = random.Random(seed)
    docs = {}
    for i in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([150, 200, 400]))]
        kind, share = i % 3, rng.uniform(0.19, 0.24)
        if kind == 0:
            copy = base + [f"y{rng.randrange(5000)}" for _ in range(int(len(base) * share))]
        elif kind == 1:
            copy = base[int(len(base) * share / (1 + share)) :]
        else:
            k = int(len(base) * share / 2.3)
            copy = base[:40] + [f"y{rng.randrange(5000)}" for _ in range(k)] + base[40 + k :]
        docs |= {2 * i: " ".join(base), 2 * i + 1: " ".join(copy)}
    return docs


def test_block_changes_at_the_threshold_are_all_found(spark):
    docs = changed_blocks(5, 300)
    sets = {i: shingles(t) for i, t in docs.items()}
    near = [i for i in range(0, 600, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    got = classes(spark, docs)
    assert len(near) > 200 and all(got[i] == got[i + 1] for i in near)
    assert len(set(got.values())) == 600 - len(near)


def test_copies_among_many_texts_of_one_template(spark):
    """Each text shares a template with all others, which is short of the similarity, and has one true copy at most."""
    rng = random.Random(8)
    template, docs = [f"t{i}" for i in range(170)], {}
    for i in range(400):
        own = [f"v{i}x{j}" for j in range(34)]
        copy = list(own)
        copy[2:12] = [f"c{i}x{j}" for j in range(10)]
        docs |= {2 * i: " ".join(template + own), 2 * i + 1: " ".join(template + copy)}
    rng.shuffle(order := list(docs))
    docs = {k: docs[i] for k, i in enumerate(order)}
    assert classes_alike(classes(spark, docs), brute_near(docs, one_print))


def one_print(x, y):
    return FP(x) == FP(y)  # links() connects fingerprints, so texts that share one are a class


def classes_alike(got, want):
    return len(set(got.values())) == len(set(want.values())) == len({(got[i], want[i]) for i in want})


@pytest.mark.parametrize("block", [40, similarity.BLOCK])
def test_crowded_buckets_give_the_classes_of_all_pairs(spark, monkeypatch, block):
    """Large groups around several centres, whose members are similar to some of the group only; also with buckets cut into pairs of blocks."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = random.Random(9)
    docs = {}
    for g in range(4):
        base = [f"g{g}w{rng.randrange(3000)}" for _ in range(120)]
        for i in range(120):
            copy = list(base)
            for _ in range(rng.randrange(1, 5)):
                copy[rng.randrange(120)] = f"g{g}x{rng.randrange(40)}"
            docs[len(docs)] = " ".join(copy)
    assert classes_alike(classes(spark, docs), brute_near(docs, one_print))


def test_every_text_counts_for_the_order_of_shingles(spark):
    docs = {i: " ".join(f"w{i}x{j}" for j in range(i % 9)) + (" shared by many texts here" if i % 3 == 0 else "") for i in range(60)} | {60: None}
    got = similarity.shingle_counts(spark.createDataFrame([(i, t, "x", "y") for i, t in docs.items()], SCHEMA))
    want = np.zeros(similarity.CELLS, np.int64)
    for t in docs.values():
        np.add.at(want, similarity._cell(similarity.shingle_set(similarity._words(t or ""))), 1)
    assert want.max() >= 20 and (got == want).all()


def test_a_group_costs_links_in_proportion_to_its_texts(spark, monkeypatch):
    """Texts that verified links connect already are not compared again: 14 near copies have 91 pairs, of which 13 do."""
    rng, docs, compared = random.Random(6), {}, []
    for g in range(3):
        base = [f"g{g}w{rng.randrange(3000)}" for _ in range(150)]
        for i in range(14):
            docs[len(docs)] = " ".join([*base[: 10 * i], f"x{g}y{i}", *base[10 * i + 1 :]])
    write = similarity.materialise

    def counted(frame, label):
        out = write(frame, label)
        compared.append(out.count() if label == "near" else 0)
        return out

    monkeypatch.setattr(similarity, "materialise", counted)
    assert len(set(classes(spark, docs).values())) == 3
    assert sum(compared) == 3 * 13
