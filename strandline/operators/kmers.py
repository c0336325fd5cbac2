"""k-mer indexes, seeds and diagonals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..functions import sequence as sq

#: Bases of a sequence that are taken at once.
PART = 1 << 20
_DIGITS = np.full(256, 4, np.uint8)
_DIGITS[list(b"ACGT")] = range(4)


def rolling_codes(seq: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, whether it has no other letter than ACGT) of every window of k bases."""
    return base_codes(np.frombuffer(seq.encode("ascii", "replace"), np.uint8), k)


def base_codes(letters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As rolling_codes(), of bytes; put together from windows of powers of two."""
    bases = _DIGITS[letters]
    wrong = np.concatenate([[0], np.cumsum(bases > 3)])
    n = len(bases) - k + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, bool)
    power, width, out, at = bases.astype(np.int64) & 3, 1, np.zeros(n, np.int64), 0
    for bit in range(k.bit_length()):
        if k >> bit & 1:  # the bases at the end of a window first, so that they come lowest
            out |= power[k - at - width : k - at - width + n] << (2 * at)
            at += width
        power, width = (power[:-width] << (2 * width)) | power[width:] if len(power) > width else power[:0], 2 * width
    return out, wrong[k:] == wrong[:-k]


def kmer_positions(sequences: DataFrame, k: int, interval: int = 1, key: str = "id", seq: str = "seq") -> DataFrame:
    """(kmer, key, pos): a row per sampled window without other letters than ACGT; kmer is a code of two bits a base (k up to 31), pos counts from 0.

    Linear in the length of a sequence, and in parts of PART bases of a long one. A null sequence has no windows.
    """
    schema = StructType([StructField("kmer", LongType()), sequences.schema[key], StructField("pos", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, rows, places, held = [], [], [], 0

            def flush() -> pa.RecordBatch:
                arrays = [pa.array(np.concatenate(codes)), batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(places).astype(np.int32))]
                return pa.RecordBatch.from_arrays(arrays, ["kmer", key, "pos"])

            for i, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                step = PART // interval * interval
                for start in range(0, max(len(text) - k + 1, 0), step):
                    code, good = rolling_codes(text[start : start + step + k - 1], k)
                    at = np.flatnonzero(good[::interval]) * interval
                    codes.append(code[at])
                    places.append(at + start)
                    rows.append(np.full(len(at), i, np.int64))
                    held += len(at)
                    if held > PART:
                        yield flush()
                        codes, rows, places, held = [], [], [], 0
            if held:
                yield flush()

    return sequences.select(key, seq).mapInArrow(run, schema)


def kmer_counts(positions: DataFrame) -> DataFrame:
    return positions.groupBy("kmer").agg(F.count("*").alias("n"))


def count_summary(counts: DataFrame) -> DataFrame:
    """One row: stored positions, distinct k-mers, mean positions of a k-mer."""
    return counts.agg(F.sum("n").cast("long").alias("positions"), F.count("*").alias("kmers"), F.avg("n").alias("mean"))


def reduced_positions(positions: DataFrame, k: int, mode: str, plus: bool = True) -> DataFrame:
    """The index with each k-mer's base change carried out: lists of k-mers that become one are merged."""
    return positions.withColumn("kmer", sq.kmer_code(sq.reduce_bases(sq.kmer_text(F.col("kmer"), k), mode, plus)))


def without_frequent(positions: DataFrame, most: float | None = None) -> DataFrame:
    """The index without k-mers of more than most positions (frequency_limit() by default), which are cut before any join so that no key of it is hot."""
    rare = kmer_counts(positions).where(F.col("n") <= (frequency_limit(positions).first()[0] if most is None else most)).select("kmer")
    return positions.join(rare, "kmer", "left_semi")


def frequency_limit(positions: DataFrame, factor: int = 10, least: int = 100) -> DataFrame:
    """One row (most): the places above which a k-mer counts as frequent, a multiple of the mean and at least so many."""
    return kmer_counts(positions).agg(F.greatest(F.lit(float(least)), factor * F.coalesce(F.avg("n"), F.lit(0.0))).alias("most"))


def repeated_kmers(positions: DataFrame, key: str = "id") -> DataFrame:
    """The positions with a flag repeated: the k-mer comes twice or more in its sequence."""
    again = positions.groupBy(key, "kmer").agg((F.count("*") > 1).alias("repeated"))
    return positions.join(again, [key, "kmer"])


def repeat_counts(sequences: DataFrame, k: int, key: str = "id", seq: str = "seq") -> DataFrame:
    """(key, repeated, total): windows of each key whose k-mer comes twice or more in its sequences, and all its windows; keys without any are left out.

    Only sequences are shuffled, not windows; a key's sequences are counted together, in memory in proportion to their length.
    """
    schema = StructType([sequences.schema[key], StructField("repeated", LongType(), False), StructField("total", LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, repeated, total = [], [], []
            for i, texts in enumerate(batch.column(1)):
                codes = [code[good] for code, good in (rolling_codes(text.as_py(), k) for text in texts)]
                if n := sum(map(len, codes)):
                    code = np.sort(np.concatenate(codes))
                    same = code[1:] == code[:-1]
                    rows.append(i)
                    repeated.append(int((np.append(same, False) | np.append(False, same)).sum()))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(repeated, pa.int64()), pa.array(total, pa.int64())], schema.names)

    return sequences.groupBy(key).agg(F.collect_list(seq).alias("seqs")).mapInArrow(run, schema)


def seeds(queries: DataFrame, index: DataFrame, query: str = "id", target: str = "id") -> DataFrame:
    """(query, target, qpos, pos, diagonal): index places of each query k-mer; diagonal is pos - qpos."""
    q = queries.select(F.col("kmer"), F.col(query).alias("query"), F.col("pos").alias("qpos"))
    t = index.select(F.col("kmer"), F.col(target).alias("target"), "pos")
    return q.join(t, "kmer").select("query", "target", "qpos", "pos", (F.col("pos") - F.col("qpos")).alias("diagonal"))


def diagonals(found: DataFrame, least: int = 2) -> DataFrame:
    """(query, target, diagonal, n, first, last, middle): diagonals with seeds at least places of the query."""
    grouped = found.groupBy("query", "target", "diagonal").agg(
        F.count_distinct("qpos").alias("n"), F.min("qpos").alias("first"), F.max("qpos").alias("last"), F.percentile("qpos", 0.5).alias("middle")
    )
    return grouped.where(F.col("n") >= least)


def intersect_diagonals(one: DataFrame, two: DataFrame) -> DataFrame:
    """(query, target, diagonal) that two seed lists share."""
    keys = ["query", "target", "diagonal"]
    return one.select(*keys).intersect(two.select(*keys))


def collapse_diagonals(found: DataFrame, reach: int = 12) -> DataFrame:
    """The seeds with base: the diagonal that stands for each. From the lowest on, diagonals within reach of a base take it; the next one is a new base.

    The distinct diagonals of one query and target (their number is bounded by the lengths of both) are gone through once, base by base.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases = []
            for value in batch.column("ds"):
                ds = value.values.to_numpy()
                own, at = np.empty_like(ds), 0
                while at < len(ds):
                    end = int(np.searchsorted(ds, ds[at] + reach, "right"))
                    own[at:end], at = ds[at], end
                bases.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bases, pa.list_(pa.int64()))], [*batch.schema.names, "bases"])

    lists = found.groupBy("query", "target").agg(F.sort_array(F.collect_set(F.col("diagonal").cast("long"))).alias("ds"))
    mapped = lists.mapInArrow(run, StructType([*lists.schema.fields, StructField("bases", ArrayType(LongType()))])).select("query", "target", F.explode(F.arrays_zip("ds", "bases")).alias("x"))
    return found.join(mapped.select("query", "target", F.col("x.ds").alias("diagonal"), F.col("x.bases").alias("base")), ["query", "target", "diagonal"])


def uniqueness_profile(sequences: DataFrame, index: DataFrame, k: int, key: str = "id", seq: str = "seq") -> DataFrame:
    """(key, length, hits): places in the index of each prefix's last k-mer chain, for lengths from k + 2 until one place at most is left.

    A prefix occurs where all its k-mers lie on one diagonal; so its hits are the diagonals with as many seeds as it has k-mers.
    """
    places = kmer_positions(sequences, k, 1, key, seq)
    met = seeds(places, index, key).groupBy("query", "target", "diagonal").agg(F.sort_array(F.collect_set("qpos")).alias("at"))
    # the run of seeds from the query's start on: how long a prefix this diagonal carries
    run = F.size(F.filter(F.transform("at", lambda x, i: F.when(x == i, x)), lambda x: x.isNotNull()))
    whole = met.withColumn("length", run + k - 1).where("length >= %d" % k)
    lengths = sequences.select(F.col(key).alias("query"), F.explode(F.sequence(F.lit(k + 2), F.greatest(F.length(seq), F.lit(k + 2)))).alias("prefix")).join(
        sequences.select(F.col(key).alias("query"), F.length(seq).alias("n")), "query"
    ).where("prefix <= n")
    counted = lengths.join(whole.select("query", "length"), "query", "left").groupBy("query", "prefix").agg(F.count_if(F.col("length") >= F.col("prefix")).alias("hits"))
    before = Window.partitionBy("query").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.coalesce(F.min("hits").over(before), F.lit(2)) > 1
    return counted.withColumn("_on", stop).where("_on").select(F.col("query").alias(key), F.col("prefix").alias("length"), "hits")


def expand_alleles(windows: DataFrame, snps: DataFrame, most: int = 4) -> DataFrame:
    """Index rows of the k-mers that known variants make. windows: id, pos, kmer text; snps: id, pos, alternates (an array of bases).

    A window with 1 to most variants yields every combination but the reference; windows with more are left out.
    """
    w = windows.select("id", F.col("pos").alias("wpos"), F.col("kmer").alias("text"), F.length("kmer").alias("k"))
    spread = w.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("pos", F.col("wpos") + F.col("at"))
    hit = spread.join(snps.select("id", "pos", "alternates"), ["id", "pos"]).groupBy("id", "wpos", "text", "k").agg(F.sort_array(F.collect_list(F.struct("at", "alternates"))).alias("v"))
    hit = hit.where(F.size("v") <= most)

    def grow(texts: Column, v: Column) -> Column:
        options = F.transform(v["alternates"], lambda b: F.transform(texts, lambda t: F.overlay(t, b, v["at"] + 1)))
        return F.array_distinct(F.concat(texts, F.flatten(options)))

    made = hit.select("id", F.col("wpos").alias("pos"), "text", F.explode(F.aggregate("v", F.array("text"), grow)).alias("kmer"))
    return made.where("kmer <> text").select(sq.kmer_code(F.col("kmer")).alias("kmer"), "id", "pos").distinct()
