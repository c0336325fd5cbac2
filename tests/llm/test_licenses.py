"""License scans against brute force, and templates with lost and added words."""

import random
import re

from strandline.llm import licenses

SCHEMA = "doc_id long, text string, label string, at string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places, labels = [], []
    for label, phrase in licenses.PHRASES.items():
        q = phrase.split()
        found = [i for i in range(len(words) - len(q) + 1) if words[i : i + len(q)] == q]
        places, labels = places + found, labels + [label] * bool(found)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def scan(spark, texts):
    rows = licenses.scan(spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)).collect()
    assert len(rows) == len(texts)
    return {r.doc_id: r for r in rows}


def test_base_equals_brute_force(spark):
    rng = random.Random(9)
    parts = ["CC", "by", "cc-BY", "General", "public", "license", "all rights", "reserved", "All Rights Reserved.", "é", "x1", "\n", "İ", "GNU GENERAL PUBLIC LICENSE"]
    texts = ["", None, "cc", "cc by", "CC BY-NC cc by"] + [" ".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(200)]
    for i, r in scan(spark, texts).items():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[i])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_templates(spark):
    mit, gpl = licenses.TEMPLATES[2][1], licenses.TEMPLATES[11][1]
    words = mit.split()
    filler = "Some ordinary text without any notice stands here, as long as you like. "
    texts = [
        filler + mit, filler * 30 + mit.upper() + filler, " ".join(words[:15] + ["really"] + words[15:]), " ".join(words[:20] + words[21:]), " ".join(words[: len(words) // 2]), " ".join(reversed(words)),
        "Released under the MIT License.", "under the license", filler, gpl + "\n" + mit, "Licensed under CC BY-NC 4.0.",
    ]
    got = {i: r.labels for i, r in scan(spark, texts).items()}
    assert got == {0: "mit", 1: "mit", 2: "mit", 3: "mit", 4: "", 5: "", 6: "mit", 7: "", 8: "", 9: "gpl,mit", 10: "cc-by,cc-by-nc"}


def test_repeats_nulls_and_empty_table(spark):
    rows = [(7, "released under the MIT license", "x", "y")] * 3 + [(7, "all rights reserved", "x", "y"), (None, "cc by", "x", "y"), (None, "released under the MIT license", "x", "y")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id is None, r.labels) for r in licenses.scan(frame).collect())
    assert got == [(False, "mit")] * 3 + [(False, "reserved"), (True, "cc-by"), (True, "mit")]
    assert licenses.scan(frame.limit(0)).count() == 0
