"""Toxicity: folding, the lexicon, learning without held-out labels, and held-out accuracy."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from strandline.llm import toxicity

DOCS, LABELS = "doc_id long, text string, _score string, toxic string", "doc_id long, toxic int, text string"


def corpus(n=900, seed=5):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ter", "son", "val", "dim", "rex", "tol")]
    nasty = ["blorgface", "snivler", "wretchling", "gruntwad"]
    docs, labels = [], []
    for i in range(n):
        words, toxic = rng.choices(plain, k=rng.randrange(8, 60)), rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                word = rng.choice(nasty)
                words.insert(rng.randrange(len(words)), word.replace("o", "0").replace("i", "1") if rng.random() < 0.3 else word.upper() if rng.random() < 0.3 else word)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS), spark.createDataFrame([(*x, "z") for x in labels], LABELS)


def test_folding():
    assert toxicity.fold("IDI0T, 1diot, іdіоt, ｉｄｉｏｔ") == "idiot, idiot, idiot, idiot"
    assert toxicity.fold("in 2015 we had 3 of them") == "in 2015 we had 3 of them"


def test_exceptions_and_word_starts():
    lexicon = toxicity.Lexicon({"trash$": 3.0, "moron": 3.0})
    none = lexicon.features("we put it into the trash can")[0]
    assert none == 0 and lexicon.features("you are trash")[0] > 0
    assert lexicon.features("oxymoron")[0] == 0 and lexicon.features("MORONS!")[0] > 0
    short, long = (lexicon.scores(np.array([lexicon.features(t)]))[0] for t in ("you moron", "you moron " + "and then we went home " * 400))
    assert short > long


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, l = frames(spark, docs, labels)
    truth = dict(labels)
    rows = toxicity.scored(d, l).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in docs}
    out = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_held_out_labels_change_nothing(spark):
    docs, labels = corpus(400)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    scores = [sorted((r.doc_id, r.score) for r in toxicity.scored(*frames(spark, docs, x)).collect()) for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_nulls_repeats_and_empty_tables(spark):
    docs, labels = corpus(200)
    d, l = frames(spark, [*docs, (None, "text"), (500, None), (500, None), (501, ""), (502, "word " * 50_000)], [*labels, (None, 1), (3, None), (9999, 1), (4, 7)])
    rows = toxicity.scored(d, l).collect()
    assert len(rows) == 205 and all(r.score is not None and r.held_out is not None for r in rows)
    assert toxicity.scored(d.limit(0), l).count() == 0
    assert toxicity.scored(d, l.limit(0)).count() == 205


def test_terms_come_from_both_halves_of_the_sample(spark):
    """A toxic word that only one half has often enough gets its weight, whichever half it is."""
    frame = spark.range(1200).select(F.col("id").alias("doc_id"))
    frame = frame.where(~toxicity.held_out()).select("doc_id", (F.xxhash64("doc_id", F.lit(1)) % 2 == 0).alias("half"))
    rows, labels, seen = [], [], {True: 0, False: 0}
    for r in sorted(frame.collect()):
        seen[r.half] += 1
        toxic = int(seen[r.half] % 5 == 0)
        word = ("grubworm" if r.half else "zanderlout") if toxic else "meadow"
        rows.append((r.doc_id, f"you {'vilefiend' if toxic else 'kindly'} {word} walk to the river"))
        labels.append((r.doc_id, toxic))
    lexicon = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    for word in ("grubworm", "zanderlout"):
        assert any(word.startswith(t.rstrip("$")) for t in lexicon.weights)
