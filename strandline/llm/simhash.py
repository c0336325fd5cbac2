"""Near-duplicate detection by SimHash fingerprints and deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_rows, materialise, rows_with_keys, table, texts
from .components import connected_components

SEED = 42
#: A bucket with more distinct fingerprints than this is resolved by two-wildcard variants, not by comparing its pairs.
BUCKET = 32
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | list[bytes], width: int = 3) -> int:
    """The 64-bit SimHash of the word shingles of a text (or of its lower-case words), repeats included; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else text
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, max(1, len(words) - width + 1))
    counts, starts = np.empty((8, 8), np.int64), np.arange(0, len(h), 255)
    for i in range(8):  # a byte of a lane counts one bit of up to 255 hashes
        lanes = np.add.reduceat((h >> np.uint64(i)) & _LANES, starts)
        counts[:, i] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(counts.ravel() * 2 > len(h)))


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    return texts(docs).mapInArrow(_fingerprints(width), "doc_id long, fp long")


def _variants() -> F.Column:
    """One-wildcard variants of both 32-bit halves: bits 0-31 the half without bit p, then p and the half's number.

    Two fingerprints that differ in two bits at most have a half that differs in one at most, so they share a variant.
    """
    keys = "transform(sequence(0, 31), p -> ({half} & ~shiftleft(1L, p)) | shiftleft(cast(p as bigint), 32) | {number})"
    low, high = "(fp & 4294967295L)", "shiftrightunsigned(fp, 32)"
    return F.explode(F.expr(f"concat({keys.format(half=low, number='0L')}, {keys.format(half=high, number='137438953472L')})"))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, fp) in this order: (a, b) for the near pairs of a bucket, or (fp, fp) for each member of a crowded one.

    Holds one batch and at most BUCKET rows before it, however large a bucket is.
    """
    keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
    crowded: int | None = None

    def settle(keys: np.ndarray, fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        left, right = [], []
        for size in np.unique(sizes[sizes > 1]):
            rows = starts[sizes == size]
            if size > BUCKET:
                all_of = fps[(rows[:, None] + np.arange(size)).ravel()]
                left.append(all_of)
                right.append(all_of)
                continue
            i, j = np.triu_indices(size, 1)
            a, b = fps[(rows[:, None] + i).ravel()], fps[(rows[:, None] + j).ravel()]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= 2
            left.append(a[near])
            right.append(b[near])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (left, right)], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False)])
        if crowded is not None:
            more = int(np.searchsorted(keys, crowded, "right"))
            if more:
                yield pa.RecordBatch.from_arrays([pa.array(fps[:more])] * 2, ["a", "b"])
            keys, fps = keys[more:], fps[more:]
        if len(keys):
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, len(keys)))
            whole = sizes[-1] > BUCKET  # the last bucket may go on: keep it back, or if it is crowded pass it on as it comes
            crowded = int(keys[-1]) if whole else None
            upto = len(starts) if whole else len(starts) - 1
            yield settle(keys, fps, starts[:upto], sizes[:upto])
            keep = len(keys) if whole else starts[-1]
            keys, fps = keys[keep:], fps[keep:]
    if len(keys):
        yield settle(keys, fps, np.array([0]), np.array([len(keys)]))


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) of Hamming distance 2 or less.

    The links returned connect exactly what all such pairs connect. Buckets of up to BUCKET fingerprints yield all their
    near pairs. Those of larger buckets are also indexed by all variants without two of the 64 bits: at most four
    fingerprints share such a key, any two of them differ in those bits alone, and any two that differ in two bits
    at most share one. So the work grows with the number of fingerprints, never with the square of a bucket.
    The index is shuffled once, as bare (key, fp) rows: nearly all keys are single, so combining before gains nothing.
    """
    spark = nodes.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = nodes.select("fp").repartition(tasks, "fp").select(_variants().alias("key"), "fp")
    with batch_rows(spark, 50_000):
        found = materialise(index.repartition(tasks, "key").sortWithinPartitions("key", "fp").mapInArrow(_sweep, "a long, b long"), "near")
    two = "flatten(transform(sequence(0, 62), p -> transform(sequence(p + 1, 63), q -> named_struct('p', p * 64 + q, 'v', fp & ~(shiftleft(1L, p) | shiftleft(1L, q))))))"
    crowded = (
        found.where("a = b").select(F.col("a").alias("fp")).distinct().repartition(tasks, "fp").select("fp", F.explode(F.expr(two)).alias("k"))
        .groupBy("k").agg(F.min("fp").alias("a"), F.array_distinct(F.collect_list("fp")).alias("fps")).where("size(fps) > 1")
        .select("a", F.explode("fps").alias("b")).where("a <> b")
    )
    return found.where("a <> b").union(crowded).distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row per document: doc_id, fp (signed long) and component_id, the least doc_id linked to it by chains of
    fingerprints that differ in two bits at most.

    Null texts count as empty. Texts without words have fingerprint 0 and are linked like any other. Rows that repeat a
    doc_id each keep a row. A row without doc_id keeps its row and never names a component, unless no member has an id.
    """
    spark = docs.sparkSession
    prints = materialise(fingerprints(docs, width), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = connected_components(links(nodes))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = materialise(rooted.join(named, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The documents, columns and all, without those that a near-duplicate stands for: of each class the row with the least doc_id stays.

    Classes are what similarity.links() connects: fingerprints within two bits, and texts whose sets of five-word shingles have a
    similarity of 0.8 or more. Of rows that share a doc_id the one with the least text hash stays, of equal rows one. Where no row of a
    class has a doc_id, the row with the least text hash stays.
    """
    from . import similarity

    keyed = rows_with_keys(docs)
    prints = similarity.signatures(docs)
    nodes = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")).alias("least"))
    roots = connected_components(links(nodes).union(similarity.links(docs, prints)))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("least", F.coalesce("root", "fp").alias("root"))
    stay = materialise(rooted.groupBy("root").agg(F.min("least").alias("x")).select(F.col("x.doc_id").alias("stay"), F.col("x.text_hash").alias("hash")), "representatives")
    kept = keyed.join(stay, F.col("id").eqNullSafe(F.col("stay")) & (F.col("key") == F.col("hash")), "left_semi")
    one = Window.partitionBy("id", "key").orderBy(F.lit(1))  # equal rows
    return kept.withColumn("at", F.row_number().over(one)).where("at = 1").select("row.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
