"""Quality rules against brute force, and on text that anyone can judge."""

import random
import re
from collections import Counter

from strandline.llm import quality

SCHEMA = "doc_id long, text string, words string, grams string"
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    covered = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_counts_equal_brute_force(spark):
    rng = random.Random(3)
    parts = ["a", "b", "the", "é", "💥x", "#", "$$", "<b>", "\n", "\n", " \t\n", "  ", "\r", "line one\n", "|", "\x0b", " "]
    texts = ["", None, " ", "\n\n", "a b c d e", "a b c d e a b c d e", "x " * 50, "same\nsame\nsame\n\n", "end"] + [" ".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(300)]
    texts.append(" ".join(str(i % 700) for i in range(3000)))
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "one two", "x", "y")] * 2, SCHEMA)
    rows = quality.assess(frame).collect()
    got = {r.doc_id: tuple(r[c] for c in FIGURES) for r in rows if r.doc_id is not None}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert len(rows) == len(texts) + 2 and not any(r.kept for r in rows if r.base_failed)


def test_verdicts(spark):
    good = "The old house stood by the river and it was quiet in the evening when the boats came home with the tide. " + "Nobody in the town knew who had built it or why."
    bad = {
        "symbols": " ".join(f"{w}###" for w in good.split()), "shouting": " ".join(f"{w}!!" for w in good.upper().split()), "table": good.replace(" ", " | "),
        "no stop words": " ".join(f"zz{i}" for i in range(80)), "repeats": good + " click here to read more now" * 20, "letters": " ".join("x" * 1 for _ in range(3)) + " q" * 40,
    }
    frame = spark.createDataFrame([(0, good, "", ""), *((i, t, "", "") for i, t in enumerate(bad.values(), 1))], SCHEMA)
    assert {r.doc_id: r.kept for r in quality.assess(frame).collect()} == {0: True} | dict.fromkeys(range(1, len(bad) + 1), False)


def test_other_rules_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a b c d e f g h i j k", "", "")], SCHEMA)
    assert quality.assess(frame, rules=()).first().kept
    assert not quality.assess(frame, rules=(("long", "n_words", 12, None),)).first().kept
    assert quality.assess(frame.limit(0)).count() == 0
