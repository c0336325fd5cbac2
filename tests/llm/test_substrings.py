"""Substring dedup against brute force over all windows."""

import hashlib
import random
from collections import Counter

import pytest
from strandline.llm import substrings

SCHEMA = "doc_id long, text string, start string"


def brute(docs, window):
    first = {}
    for doc, text in docs:
        words = (text or "").split()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in docs:
        words = (text or "").split()
        gone = set()
        for i in range(len(words) - window + 1):
            if doc is not None and first[tuple(words[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def run(spark, docs, window, kmer):
    frame = spark.createDataFrame([(*d, "x") for d in docs], SCHEMA)
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.deduplicate(frame, window, kmer).collect())


@pytest.mark.parametrize(("window", "kmer", "seed"), [(8, 3, 1), (6, 6, 2), (12, 1, 3)])
def test_random_corpora(spark, window, kmer, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    passages = [" ".join(rng.choices(words, k=rng.randrange(window - 2, 4 * window))) for _ in range(8)]
    docs = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(words, k=rng.randrange(1, 15))) for _ in range(rng.randrange(1, 6))]
        docs.append((i * 3, " ".join(parts)))
    docs += [(500, docs[3][1]), (501, docs[3][1]), (502, "x " * 100), (503, "x " * 90), (504, "a b " * 40), (505, "b a " * 40)]
    assert run(spark, docs, window, kmer) == brute(docs, window)


def test_nulls_repeats_and_short_texts(spark):
    long = " ".join(map(str, range(40)))
    docs = [(5, long), (5, long), (5, "other " + long), (9, long), (None, long), (None, None), (1, None), (2, ""), (3, "short text"), (10, long[:-3])]
    assert run(spark, docs, 10, 4) == brute(docs, 10)


def test_empty_table(spark):
    assert substrings.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_windows_keep_no_neighbours():
    words = [b"%d" % (i * i % 97) for i in range(300)]
    m, c, start, n = substrings.pieces_of(words, 50, 12)
    assert n.sum() == 251 and start[0] == 0 and (start[1:] == (start + n)[:-1]).all()
    assert substrings.pieces_of(words[:49], 50, 12)[0].size == 0
    again = substrings.pieces_of([b"front"] * 7 + words, 50, 12)
    assert set(c[1:-1].tolist()) <= set(again[1].tolist())
