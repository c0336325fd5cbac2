"""Toxicity scores from a weighted lexicon, matched by an Aho-Corasick automaton over folded text."""

from __future__ import annotations

import hashlib
import pickle
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, texts

#: Labelled rows that a model is fitted on at most: those with the least hash of doc_id. It is the only bound; all terms with evidence count.
LABELLED_ROWS = 12_000
PREFIXES = range(4, 11)
MIN_TOXIC = 4
#: Terms that count without labelled rows, and phrases in which a term is harmless.
SEED_TERMS = ("idiot$", "moron$", "stupid$", "scum$", "loser$", "pathetic$", "worthless$", "disgusting$", "trash$", "clown$")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "taking out the trash", "class clown", "clown fish", "clown car", "sore loser", "idiot proof", "pathetic fallacy", "stupid question", "oxymoron")

_HOMOGLYPHS = dict(zip("аеорсухіјѕԁһɡӏвкмнтαοερτυικν", "aeopcyxijsdhglbkmhtaoeptuikv", strict=True))
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_FOLD = str.maketrans(_HOMOGLYPHS | {c: chr(ord(c) - 0xFEE0) for c in map(chr, range(0xFF41, 0xFF5B))} | {"​": None, "‍": None, "­": None})
_LEET = re.compile(r"[^\W\d_][\w@$!]*[013457@$!]\w*[^\W\d_]|[013457@$]+[^\W\d_]{2,}")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, look-alike letters as Latin ones, and digits or signs amid the letters of a word as the letters they stand for."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    return _LEET.sub(lambda m: "".join(_DIGITS.get(c, c) for c in m.group()), text)


@dataclass
class Lexicon:
    """Terms with weights (a final $: the whole word, else a prefix of one), and a logistic model on what they add up to."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    means: tuple[float, ...] = (0.0,) * 6
    scales: tuple[float, ...] = (1.0,) * 6
    coefficients: tuple[float, ...] = (0.2, 0.4, 0.4, 0.2, 0.2, 0.0)
    intercept: float = -3.0

    @cached_property
    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term in {t.rstrip("$") for t in self.weights}:
            machine.add_word(term, (len(term), self.weights.get(term, 0.0), self.weights.get(term + "$", 0.0)))
        for phrase in self.exceptions:  # a phrase that is also a term stays a term
            if not machine.exists(phrase):
                machine.add_word(phrase, (len(phrase), None, None))
        machine.make_automaton()
        return machine

    def features(self, text: str) -> tuple[float, ...]:
        """Of the terms that start words, by the heaviest a word has: their sum, that sum by length and its root, the largest, their number; and the length."""
        text = fold(text)
        n, spared, hits = text.count(" ") + text.count("\n") + 1, [], {}
        if self.weights:
            last = len(text) - 1
            for end, (size, prefix, whole) in self.automaton.iter(text):
                start = end - size + 1
                if prefix is None:
                    spared.append((start, end))
                elif start == 0 or not text[start - 1].isalpha():
                    weight = max(prefix, whole) if end == last or not text[end + 1].isalpha() else prefix
                    if weight > hits.get(start, 0.0):
                        hits[start] = weight
        if spared:  # how far the phrases reach that start at or before a hit
            spared.sort()
            starts, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
            hits = {at: w for at, w in hits.items() if not (k := bisect_right(starts, at)) or reach[k - 1] < at}
        times = Counter((_WORD.match(text, at)[0], w) for at, w in hits.items())
        total = sum(w * (1 + np.log(k)) for (_, w), k in times.items())  # a word said again adds less each time
        return total, 100 * total / (n + 20), total / n**0.5, max(hits.values(), default=0.0), float(len(times)), float(np.log(n))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = ((rows - self.means) / self.scales) @ np.array(self.coefficients) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out() -> F.Column:
    """True for the fifth of the documents whose labels no model may see."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, clean, toxic): documents that have the term, counted by batch."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
            words = set(_WORD.findall(fold(text.as_py())))
            counts[toxic.as_py()].update({w[:k] for w in words for k in PREFIXES if k <= len(w)} | {w + "$" for w in words if len(w) > 3})
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], ["term", "clean", "toxic"])


def _chosen(rows: list, n_clean: int, n_toxic: int) -> dict[str, float]:
    """Weights of the terms that tell toxic documents: a term is left out where a shorter prefix of it tells as much."""
    weights: dict[str, float] = {}
    scored = []
    for r in rows:
        weight = np.log((r.toxic + 0.5) / (n_toxic + 1)) - np.log((r.clean + 0.5) / (n_clean + 1))
        if weight > 2:
            scored.append((float(weight), r.toxic, r.term))
    for weight, _, term in sorted(scored, key=lambda x: (len(x[2].rstrip("$")), x[2])):
        bare = term.rstrip("$")
        if all(weight > weights.get(bare[:k], 0.0) + 0.3 for k in PREFIXES if k <= len(bare) and bare[:k] != term):
            weights[term] = weight
    return weights


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Coefficients and intercept by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learn the lexicon and its logistic model from labelled documents that are not held out.

    The sample is at most LABELLED_ROWS labels, chosen by a hash of doc_id; only their texts are read into the model, through a
    join with that bounded list. Terms are counted in Spark; what reaches the driver is the terms with evidence and six
    figures a sampled row. The coefficients are cross-fitted: the terms of each half of the sample give the figures of the other half; the terms
    returned are those of the whole sample. Null labels, and labels without a document, are passed over. Without labels of both
    kinds the seed terms and default coefficients stand.
    """
    spark = docs.sparkSession
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out() & F.col("toxic").isin(0, 1))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
    )
    known = spark.createDataFrame([tuple(r) for r in sample.collect()], "doc_id long, toxic int")
    rows = texts(docs).join(F.broadcast(known), "doc_id")
    rows = rows.withColumn("half", (F.xxhash64("doc_id", F.lit(1)) % 2 == 0).cast("int"))
    n = {(r.half, r.toxic): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    if len({toxic for _, toxic in n}) < 2:
        return Lexicon({t: 3.0 for t in SEED_TERMS})
    grams = [rows.where(F.col("half") == h).select("text", "toxic").mapInArrow(_grams, "term string, clean long, toxic long").withColumn("half", F.lit(h)) for h in (0, 1)]
    kinds = [F.sum(F.when(F.col("half") == h, F.col(kind)).otherwise(0)).alias(f"{kind}{h}") for h in (0, 1) for kind in ("clean", "toxic")]
    counted = materialise(grams[0].union(grams[1]).groupBy("term").agg(*kinds).where(F.col("toxic0") + F.col("toxic1") >= MIN_TOXIC), "terms")

    def lexicon_of(*halves: int) -> Lexicon:
        n_clean, n_toxic = (sum(n.get((h, kind), 0) for h in halves) for kind in (0, 1))
        both = counted.select("term", *(sum(F.col(f"{kind}{h}") for h in halves).alias(kind) for kind in ("clean", "toxic")))
        sure = F.log((F.col("toxic") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n_clean + 1.0)) > 2
        found = both.where((F.col("toxic") >= MIN_TOXIC) & sure).collect()  # at most the distinct terms of the bounded sample
        return Lexicon(_chosen(found, n_clean, n_toxic))

    # figures of a half come from the terms of the other: a term found by chance gets no credit for it
    drafts = {1 - h: lexicon_of(h) for h in (0, 1) if (h, 0) in n and (h, 1) in n}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [drafts[h.as_py()].features(t.as_py()) for t, h in zip(batch.column("text"), batch.column("half"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    final = lexicon_of(0, 1)
    got = rows.where(F.col("half").isin(*drafts)).select("text", "toxic", "half").mapInArrow(features, "x array<double>, toxic int").collect() if drafts else []
    x, y = np.array([r.x for r in got]).reshape(-1, 6), np.array([r.toxic for r in got], float)
    if len(set(y.tolist())) < 2:
        return final
    means, scales = x.mean(axis=0), x.std(axis=0) + 1e-9
    w, b = _logistic((x - means) / scales, y)
    return Lexicon(final.weights, means=tuple(means), scales=tuple(scales), coefficients=tuple(w), intercept=b)


_MODELS: dict[str, Lexicon] = {}


def _score(model: bytes, column: str):
    key = hashlib.sha256(model).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = pickle.loads(model)
        lexicon = _MODELS[key]
        for batch in batches:
            rows = np.array([lexicon.features(t.as_py() or "") for t in batch.column("text")]).reshape(-1, 6)
            yield batch.append_column(column, pa.array(lexicon.scores(rows), pa.float64()))

    return run


def score(docs: DataFrame, lexicon: Lexicon, column: str = "score") -> DataFrame:
    """The documents, columns and all, with a column from 0 to 1 (of the text alone; a null text counts as empty); docs has no column of its name."""
    return docs.mapInArrow(_score(pickle.dumps(lexicon), column), docs.select("*", F.lit(0.0).alias(column)).schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of 0.5 on); repeated rows keep a row each."""
    rows = score(texts(docs), fit(docs, labels))
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
