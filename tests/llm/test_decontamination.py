"""Containment search against comparing all documents with all items."""

import random
import re

import pytest
from strandline.llm import decontamination

DOCS, ITEMS = "doc_id long, text string, item_id string, h string", "item_id long, text string, doc_id string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text, width=5):
    words = WORD.findall((text or "").lower())
    width = min(width, len(words))
    return width, {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute(docs, items, share=0.8):
    found = {}
    for item, text in items:
        width, own = shingles(text)
        for doc, body in docs:
            words = WORD.findall((body or "").lower())
            there = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()
            if own and len(own & there) >= share * len(own) - 1e-9:
                key, new = (doc, body or "", item), (len(own & there) / len(own), len(own), len(own & there))
                found[key] = max(found.get(key, new), new)
    return {(d, i, n, s, c) for (d, _, i), (c, n, s) in found.items()}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(6, 60)))) for i in range(12)] + [(20, "only three words"), (21, "one"), (22, None), (23, "..."), (3, "another text of the same item here")]
    docs = []
    for i in range(80):
        parts = [" ".join(rng.choices(words, k=rng.randrange(0, 200)))]
        if rng.random() < 0.6:
            inside = rng.choice(items)[1] or ""
            part = inside.split()
            for _ in range(rng.randrange(0, 3)):
                if part:
                    part[rng.randrange(len(part))] = rng.choice(words)
            parts.append(" ".join(part).upper() if rng.random() < 0.3 else ", ".join(part))
        docs.append((i, " ".join(parts) + "!"))
    return docs + [(90, None), (91, ""), (None, items[0][1]), (5, items[1][1]), (92, "Only three, words."), (93, docs[2][1]), (93, docs[2][1])], items


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", broadcast)
    docs, items = corpus(4)
    got = decontamination.contained_items(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS))
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared, r.containment) for r in got.collect()} == brute(docs, items)


def test_clean_documents_keep_columns(spark):
    docs, items = corpus(6)
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS)
    clean = decontamination.clean_documents(frame, spark.createDataFrame([(*i, "x") for i in items], ITEMS))
    bad = {(d, i) for d, i, *_ in brute(docs, items)}
    assert clean.columns == frame.columns
    by_text = [(d, t) for d, t in docs if not brute([(d, t)], items)]
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted(by_text, key=repr) and bad


def test_sketch_finds_what_is_contained(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(24)), "x")], ITEMS)
    rows = decontamination.index_items(items).collect()
    assert len(rows) == 20 and {r.need for r in rows} == {16} and sum(r.in_sketch for r in rows) == 5
    assert max(r.h for r in rows if r.in_sketch) < min(r.h for r in rows if not r.in_sketch)


def test_empty_tables(spark):
    docs, items = corpus(1)
    d, i = spark.createDataFrame([(*x, "x", "y") for x in docs], DOCS), spark.createDataFrame([(*x, "x") for x in items], ITEMS)
    assert decontamination.contained_items(d.limit(0), i).count() == 0
    assert decontamination.contained_items(d, i.limit(0)).count() == 0
    assert decontamination.clean_documents(d, i.limit(0)).count() == d.count()
