"""Substring dedup: the word windows that documents share, by minimiser partitioning in place of De Bruijn compaction; spans are compared by hashes, not word by word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table, texts

#: Words of a window (an edge of the graph, between nodes of one word less), and of the k-mers that pick its bucket.
WINDOW, KMER = 50, 12
SEED = 50
#: Windows that are handed on at once.
ROWS = 20_000
_MUL, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_PIECE = "m long, c long, doc_id long, text_hash long, start int, n int"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * _MUL + (b ^ _ADD))


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size consecutive entries, put together from runs of powers of two."""
    powers, width = [h], 1
    while 2 * width <= size:
        powers.append(_pairs(powers[-1][:-width], powers[-1][width:]))
        width *= 2
    out, at = None, 0
    for bit in reversed(range(len(powers))):
        if size >> bit & 1:
            n = len(h) - size + 1
            part = powers[bit][at : at + n]
            out = part if out is None else _pairs(out, part)
            at += 1 << bit
    return out


def _least(h: np.ndarray, size: int) -> np.ndarray:
    """Minima of all runs of size consecutive entries."""
    width = 1
    while 2 * width <= size:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (size - width)], h[size - width :]) if size > width else h


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))


def pieces_of(words: list[bytes], window: int = WINDOW, kmer: int = KMER) -> tuple[np.ndarray, ...]:
    """(m, c, start, n) of a document's pieces: maximal runs of n windows from word start on with one least k-mer hash m; c is the hash of
    the run's windows in order.

    Equal windows have the same least k-mer, so they meet in one bucket m, whatever stands around them; a piece is the
    part of a document's path through the graph that lies in one bucket.
    """
    if len(words) < window:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    h = _hashes(words)
    windows, least = _runs(h, window), _least(_runs(h, kmer), window - kmer + 1)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    n = np.diff(np.append(starts, len(least)))
    within = np.arange(len(windows), dtype=np.uint64) - np.repeat(starts, n).astype(np.uint64)
    return least[starts], _mix(np.add.reduceat(_mix(windows + within * _MUL), starts) + n.astype(np.uint64)), starts, n


def _cut(window: int, kmer: int):
    schema = pa.schema([("m", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pieces_of(words_of(t.as_py()), window, kmer) for t in batch.column("text")]
            times = [len(x[0]) for x in found]
            keys = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), times) for c in ("doc_id", "text_hash")]
            m, c, start, n = (np.concatenate([x[i] for x in found] or [np.empty(0, np.int64)]) for i in range(4))
            arrays = [m.view(np.int64), c.view(np.int64), *keys, start.astype(np.int32), n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(arrays, schema, strict=True)], schema=schema)

    return run


def _windows(window: int):
    """The windows of chosen pieces: read again from the text at their coordinates."""
    schema = pa.schema([("m", pa.int64()), ("w", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, text, chosen in zip(*(batch.column(c) for c in ("doc_id", "text_hash", "text", "chosen")), strict=True):
                hashes = _runs(_hashes(words_of(text.as_py())), window).view(np.int64)
                m, start, n = (chosen.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("m", "start", "n"))
                places, m = np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n), np.repeat(m, n)
                for at in range(0, len(places), ROWS):
                    some = places[at : at + ROWS]
                    rows = len(some)
                    arrays = [m[at : at + ROWS], hashes[some], np.full(rows, doc.as_py(), np.int64), np.full(rows, key.as_py(), np.int64), some.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(arrays, schema, strict=True)], schema=schema)

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(doc_id, text_hash, start, n): n windows from word start on that also start in a document with a smaller doc_id.

    docs: doc_id, text, text_hash. The windows of a text are edges of a De Bruijn graph. Each document is cut at the source into pieces,
    the parts of its path that lie in one bucket (see pieces_of). Only buckets that two documents reach go on. Pieces
    with equal windows are compacted into one path each, by its bucket and hash; every occurrence outside the path's
    first document is a repeat as a whole. Where different paths meet in a bucket the graph may branch, so there the first
    occurrences are taken apart into single windows, at their coordinates in the source, and compared one by one. Every
    comparison is of two 64-bit hashes together, of a k-mer and of all words.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("doc_id").isNotNull())
    pieces = materialise(known.mapInArrow(_cut(window, kmer), _PIECE), "pieces")
    buckets = pieces.groupBy("m").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("c").alias("c1"), F.max("c").alias("c2"))
    # each aggregate is written before it is joined: then both sides of the join are plain exchanges, and a hot key's rows can be split
    met = materialise(buckets.where("a < b").select("m", (F.col("c1") != F.col("c2")).alias("branches")), "met")
    shared = materialise(pieces.join(met, "m"), "shared")
    discard(spark, pieces)
    paths = materialise(shared.groupBy("m", "c").agg(F.min("doc_id").alias("first")), "paths")
    placed = materialise(shared.join(paths, ["m", "c"]), "placed")
    discard(spark, shared)
    # the occurrences in a path's first document, which may hold it again; sets, since rows may repeat
    own = placed.where("doc_id = first AND branches").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("m", "start", "n")).alias("chosen"))
    chosen = known.join(own, ["doc_id", "text_hash"])
    single = materialise(chosen.mapInArrow(_windows(window), "m long, w long, doc_id long, text_hash long, start int"), "windows")
    again = materialise(single.groupBy("m", "w").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").drop("b"), "again")
    later = single.join(again, ["m", "w"]).where("doc_id > a").select("doc_id", "text_hash", "start", F.lit(1).alias("n"))
    return placed.where("doc_id > first").select("doc_id", "text_hash", "start", "n").union(later)


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = words_of(text.as_py())
                kept = words
                if spans.is_valid:
                    step = np.zeros(len(words) + 1, np.int64)
                    start, n = (spans.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "n"))
                    np.add.at(step, start, 1)
                    np.add.at(step, start + n + window - 1, -1)
                    stay = np.cumsum(step[:-1]) == 0
                    kept = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                rows.append((len(words), len(words) - len(kept), b" ".join(kept)))
            n, gone, joined = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in joined], pa.string()), pa.array(joined, pa.binary())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return run


def deduplicate(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and kept, the words that stay (UTF-8, joined by a space).

    A word goes if a window of consecutive words that covers it also starts in a document with a smaller doc_id; all windows are judged on the
    input. Null texts have no words; texts of fewer words than a window keep them all. Rows that repeat a doc_id are no
    smaller than each other and keep a row each. A row without doc_id takes no part: it stays whole and takes nothing from others.
    """
    docs = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    spans = repeated_spans(docs, window, kmer).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    both = docs.join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_removed(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("kept")


OP3_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
),
g AS (
  SELECT r, doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS gram
  FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d WHERE len(words) >= {WINDOW} AND doc_id IS NOT NULL)
),
later AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first FROM g) WHERE first < doc_id),
w AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
c AS (SELECT w.r, w.word, w.i, coalesce(w.i - max(later.i) OVER (PARTITION BY w.r ORDER BY w.i) < {WINDOW}, false) AS gone FROM w LEFT JOIN later ON later.r = w.r AND later.i = w.i),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
