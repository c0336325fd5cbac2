"""Near-duplicates at a shingle similarity, found exactly by a prefix filter on the sets of shingles."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, discard, materialise, texts
from .components import connected_components
from .simhash import fingerprint
from .substrings import _hashes, _mix, _runs

#: Words of a shingle, and the least Jaccard similarity of two texts' sets of shingles.
WIDTH, SIMILARITY = 5, 0.8
#: Cells in which the texts that hold a shingle are counted, a power of two, and how many of them travel in a row. They set the order of the prefixes, not the result.
CELLS, PART = 1 << 22, 1 << 14
#: Buckets of up to this size give all their pairs at once; of larger ones each text first meets the LEAST first texts and the one before
#: it, then FIRST of those that are not linked to it by then, and at last all that are not.
BUCKET, LEAST, FIRST = 16, 3, 8
#: Rows of a bucket that a task holds at a time, and bits of a sketch at most.
BLOCK, SKETCH_BITS = 20_000, 1 << 14
#: Documents of candidate pairs up to which their keys are broadcast.
BROADCAST_ROWS = 200_000


def shingle_set(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Hashes of the distinct shingles, in order; the whole text where it has fewer words; none without words."""
    h = _hashes(words)
    return np.unique(_runs(h, min(width, len(h)))) if len(h) else h


def sketch(own: np.ndarray) -> bytes:
    """Parities of a set's hashes by their value modulo a power of two about the size of the set.

    Two sketches differ in at most as many bits as the sets differ in members; a longer one is folded to the length of a shorter one.
    """
    bits = min(SKETCH_BITS, max(64, 1 << (len(own) - 1).bit_length()))
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _cell(own: np.ndarray) -> np.ndarray:
    return (own & np.uint64(CELLS - 1)).astype(np.int64)


def _set_hash(own: np.ndarray) -> int:
    total = int(_mix(own).sum(dtype=np.uint64)) if len(own) else 0
    return total - (1 << 64) if total >> 63 else total


def _prefix(own: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """Of a set's shingles, rare ones first, as many as must hold one of any set that has the similarity."""
    own = own[np.argsort(counts[_cell(own)], kind="stable")]
    return own[: len(own) - math.ceil(similarity * len(own) - 1e-6) + 1]


_PRINTS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64()), ("shingles", pa.int64()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _signatures(counts: np.ndarray, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                words = _words(value.as_py())
                own = shingle_set(words)
                fp = int(np.uint64(fingerprint(words)).astype(np.int64))
                rows.append((fp, _set_hash(own), len(own), _prefix(own, counts, similarity).view(np.int64), sketch(own)) if len(own) else (fp, 0, 0, [], b""))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            arrays = [pa.array(x, f.type) for x, f in zip(columns, list(_PRINTS)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *arrays], schema=_PRINTS)

    return run


def signatures(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, fp, shingles, n, prefix, sketch) of each document, in one pass over the texts.

    fp: as in simhash. shingles: a hash of the set of shingles, n its size, prefix the members under which it is looked for (see links()), and
    sketch what rules out most sets that are not similar. Texts without words have n = 0.
    """
    rows = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    counts = shingle_counts(docs)
    kind = "doc_id long, text_hash long, fp long, shingles long, n int, prefix array<long>, sketch binary"
    return materialise(rows.mapInArrow(_signatures(counts, similarity), kind), "signatures")


def _rows_of_cells(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    packed = [zlib.compress(c.tobytes(), 1) for c in parts.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(packed, pa.binary())], ["part", "counts"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.uint32)
    for batch in batches:
        for value in batch.column("text"):
            np.add.at(counts, _cell(shingle_set(_words(value.as_py()))), 1)
    yield _rows_of_cells({i // PART: counts[i : i + PART] for i in range(0, CELLS, PART) if counts[i : i + PART].any()})


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, packed in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
            sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(packed.as_py()), np.uint32)
    yield _rows_of_cells(sums)


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """For each cell, how often a text holds a shingle that falls there, over all texts. A frequent shingle makes its cell stand out the more, the more texts there are."""
    spark = docs.sparkSession
    kind = "part int, counts binary"
    counted = texts(docs).select("text").mapInArrow(_count, kind).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
    counts = np.zeros(CELLS, np.uint32)
    for row in counted.mapInArrow(_sum, kind).toArrow().to_pylist():
        counts[row["part"] * PART : (row["part"] + 1) * PART] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return counts


def _buckets(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[list[np.ndarray]]:
    """The columns of rows in order of their first column, cut only between its values.

    With most, the rows of one value also come in parts of about so many; each further part starts with the LEAST first rows and the last one before it.
    """
    held: list[list[np.ndarray]] = []
    whole = lambda: [np.concatenate(c) for c in zip(*held, strict=True)]
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        keys = held[-1][0]
        if keys[-1] == held[0][0][0]:  # all that is held is one bucket, which may go on
            if most and sum(len(x[0]) for x in held) > most:
                part = whole()
                yield part
                held = [[np.concatenate([c[:LEAST], c[-1:]]) for c in part]]
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        rest = [c[cut:] for c in held[-1]]
        held[-1] = [c[:cut] for c in held[-1]]
        yield whole()
        held = [rest]
    if held:
        yield whole()


def _may(at: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets may have the similarity if a shared shingle is their first one in order: what is left of both must hold their common part.

    at: size of the set and place of the shingle. The first shingle that two sets share always lets a pair of that similarity pass.
    """
    n, left = at >> 32, (at >> 32) - (at & 0xFFFFFFFF)
    return np.minimum(left[a], left[b]) >= similarity / (1 + similarity) * (n[a] + n[b]) - 1e-6


def _found(a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))]


def _pairs(similarity: float, bucket: int):
    """(a, b, key, at) of rows (key, at, shingles) in order of key and at: pairs a < b without a key, and with it a row a = b for each member of a crowded bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, at, ids in _buckets(batches, BLOCK):
            twin = keys[1:] == keys[:-1]
            shared = np.append(twin, False) | np.insert(twin, 0, False)
            keys, at, ids = keys[shared], at[shared], ids[shared]
            if not len(keys):
                continue
            starts = np.flatnonzero(np.insert(keys[1:] != keys[:-1], 0, True))
            sizes = np.diff(np.append(starts, len(keys)))
            first, crowded = np.repeat(starts, sizes), np.repeat(sizes > bucket, sizes)
            rows = np.arange(len(keys))
            left, right = [], []
            for back in range(1, min(bucket, int(sizes.max()))):
                r = rows[(rows - back >= first) & (~crowded | (back == 1))]
                left.append(r - back)
                right.append(r)
            for k in range(LEAST):
                r = rows[crowded & (rows - 1 > first + k)]
                left.append(first[r] + k)
                right.append(r)
            a, b = np.concatenate(left), np.concatenate(right)
            ok = _may(at, a, b, similarity) & (ids[a] != ids[b])
            a, b, nulls = ids[a[ok]], ids[b[ok]], pa.nulls(int(ok.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([*_found(a, b), nulls, nulls], ["a", "b", "key", "at"])
            if crowded.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[crowded]) for x in (ids, ids, keys, at)], ["a", "b", "key", "at"])

    return run


class _Sketches:
    """The sketches of a bucket's rows, by length, and folded to shorter ones where asked for."""

    def __init__(self, values: np.ndarray) -> None:
        self.size = np.array([len(v) for v in values])
        self.place = np.empty(len(values), np.int64)
        self.own: dict[tuple[int, int], np.ndarray] = {}
        for size in np.unique(self.size).tolist():
            rows = np.flatnonzero(self.size == size)
            self.place[rows] = np.arange(len(rows))
            self.own[size, size] = np.frombuffer(b"".join(values[rows]), np.uint64).reshape(-1, size // 8)

    def _folded(self, size: int, to: int) -> np.ndarray:
        if (size, to) not in self.own:
            wide = self._folded(size, 2 * to)
            self.own[size, to] = wide[:, : to // 8] ^ wide[:, to // 8 :]
        return self.own[size, to]

    def differ(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of rows differ from that of row i."""
        out, own = np.empty(len(rows), np.int64), int(self.size[i])
        for size in np.unique(self.size[rows]).tolist():
            to, some = min(size, own), self.size[rows] == size
            both = self._folded(size, to)[self.place[rows[some]]] ^ self._folded(own, to)[self.place[i]]
            out[some] = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        return out


def _across(similarity: float, most: int | None):
    """(a, b), a < b, of rows (unit, at, shingles, root, side, sketch) in order of unit and at: all pairs of a unit that have not the same root and
    may have the similarity, or most for a member. In a unit of two sides only pairs across them count."""
    differ = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for units, at, ids, roots, sides, prints in _buckets(batches):
            starts = np.flatnonzero(np.insert(units[1:] != units[:-1], 0, True))
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(units)], strict=True):
                _, number, sizes = np.unique(roots[start:end], return_inverse=True, return_counts=True)
                if len(sizes) == 1:
                    continue
                here, own, side, largest = at[start:end], ids[start:end], sides[start:end], int(sizes.argmax())
                n, marks, two, left, right = here >> 32, _Sketches(prints[start:end]), side.min() != side.max(), [], []
                for i in np.flatnonzero(number != largest).tolist():  # members of the largest class meet the others only
                    low, high = np.searchsorted(n, [similarity * n[i] - 1e-6, n[i] / similarity + 1e-6])
                    b = np.arange(low, high)
                    b = b[(number[b] != number[i]) & ((number[b] == largest) | (b > i)) & (not two or side[b] != side[i])]
                    b = b[_may(here, np.full(len(b), i), b, similarity)]
                    b = b[marks.differ(i, b) <= differ * (n[b] + n[i]) + 1e-6]
                    if most and len(b) > most:  # those of the least mix with the text's own hash: the same in all buckets
                        b = b[np.argsort(_mix(own[b].view(np.uint64) ^ own[i : i + 1].view(np.uint64)))[:most]]
                    left.append(np.full(len(b), own[i]))
                    right.append(own[b])
                yield pa.RecordBatch.from_arrays(_found(np.concatenate(left), np.concatenate(right)), ["a", "b"])

    return run


def _alike(similarity: float):
    """(a, b) of rows (a, b, na, sa, nb, sb) whose sketches do not rule the pair out."""
    differ = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            rows = batch.num_rows
            marks = _Sketches(np.concatenate([columns["sa"], columns["sb"]]))
            near = np.fromiter((marks.differ(i, np.array([i + rows]))[0] for i in range(rows)), np.int64, rows) <= differ * (columns["na"].astype(np.int64) + columns["nb"]) + 1e-6
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("a", "b")], ["a", "b"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingle_set(_words(t.as_py())).view(np.int64) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("shingles"), pa.array(found, pa.list_(pa.int64()))], ["shingles", "hashes"])


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return run


def _units(crowded: DataFrame, roots: DataFrame, prints: DataFrame) -> DataFrame:
    """(unit, at, shingles, root, side, sketch): the crowded buckets whose sets have more than one root, those of over BLOCK rows in pairs of blocks.

    A set's block comes from its hash; each row goes to the pairs its block is part of, so no task holds more than two blocks.
    """
    rooted = crowded.join(roots, F.col("shingles") == F.col("node"), "left").select("key", "at", "shingles", F.coalesce("root", "shingles").alias("root"))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("size")).where("r1 <> r2")
    sizes = materialise(open_keys.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "open")
    rows = rooted.join(sizes, "key").withColumn("side", F.pmod(F.xxhash64("shingles"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    unit = F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("unit")
    return rows.join(prints, "shingles").select(unit, "at", "shingles", "root", "side", "sketch")


def links(docs: DataFrame, prints: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links between fingerprints (fp) of documents whose sets of shingles are equal or have the similarity.

    prints: signatures(docs). The links connect exactly what all such pairs connect. Equal sets are one node each. Shingles have one order, in which those
    of cells with high counts come last; two sets of the similarity share one of the first in both, so they meet in a bucket of it, unless sizes
    and places there rule them out. Buckets of up to BUCKET sets give all pairs. In larger ones a few links for each set come first, and then all pairs whose
    sets these did not connect and whose sketches do not rule them out: a group of near copies costs each of them a few comparisons, and no pair is left out.
    Pairs are verified on the sets themselves, read again from the text; first one for each set, then those that these did not connect. Texts without words are equal to each other only.
    """
    spark = docs.sparkSession
    sets = materialise(
        prints.where("n > 0").groupBy("shingles", "n").agg(F.min("fp").alias("fp"), F.max("fp").alias("last"), F.min(F.struct("text_hash", "doc_id")).alias("one"))
        .select("shingles", "n", "fp", "last", "one.*"), "sets",
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prefixes = prints.where("n > 0").select("shingles", "n", "prefix").dropDuplicates(["shingles"])
    keys = prefixes.select("shingles", "n", F.posexplode("prefix").alias("pos", "key")).select("key", F.expr("shiftleft(CAST(n AS LONG), 32) + pos").alias("at"), "shingles")
    with batch_rows(spark, 20_000):
        met = materialise(keys.repartition(tasks, "key").sortWithinPartitions("key", "at", "shingles").mapInArrow(_pairs(similarity, BUCKET), "a long, b long, key long, at long"), "met")
    pairs = materialise(met.where("key IS NULL").select("a", "b").distinct(), "pairs")
    crowded = met.where("key IS NOT NULL").select("key", "at", F.col("a").alias("shingles"))
    ids = pairs.select(F.col("a").alias("shingles")).union(pairs.select("b")).union(crowded.select("shingles")).distinct()
    marks = materialise(prints.where("n > 0").select("shingles", "n", "sketch").join(ids, "shingles", "left_semi").dropDuplicates(["shingles"]), "sketches")
    both = pairs.join(marks.toDF("a", "na", "sa"), "a").join(marks.toDF("b", "nb", "sb"), "b")
    alike = materialise(both.mapInArrow(_alike(similarity), "a long, b long"), "alike")
    rows = texts(docs).withColumn("text_hash", F.xxhash64("text"))

    def verified(candidates: DataFrame) -> DataFrame:
        ids = candidates.select(F.col("a").alias("shingles")).union(candidates.select("b")).distinct()
        wanted = materialise(sets.select("shingles", F.col("text_hash").alias("wanted_hash"), F.col("doc_id").alias("wanted_id")).join(ids, "shingles", "left_semi"), "wanted")
        if not (n := wanted.count()):
            return candidates
        wanted = F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted
        hashes = rows.join(wanted, (F.col("text_hash") == F.col("wanted_hash")) & F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select("shingles", "text")
        hashes = materialise(hashes.mapInArrow(_sets, "shingles long, hashes array<long>").dropDuplicates(["shingles"]), "hashes")
        compared = candidates.join(hashes.toDF("a", "x"), "a").join(hashes.toDF("b", "y"), "b")
        near = materialise(compared.mapInArrow(_verified(similarity), "a long, b long"), "near")
        discard(spark, hashes)
        return near

    near = verified(materialise(alike.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first"))
    roots = connected_components(near)
    apart = alike.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    near = near.union(verified(materialise(apart, "apart")))
    for most in (FIRST, None) if not crowded.isEmpty() else ():
        units = _units(crowded, connected_components(near), marks)
        with batch_rows(spark, 5_000):
            others = units.repartition(tasks, "unit").sortWithinPartitions("unit", "at", "shingles").mapInArrow(_across(similarity, most), "a long, b long")
            others = materialise(others.distinct().join(pairs, ["a", "b"], "left_anti"), "others")
        pairs, near = pairs.union(others), near.union(verified(others))
    fps = sets.select("shingles", "fp")
    linked = near.join(fps.toDF("a", "fa"), "a").join(fps.toDF("b", "fb"), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    # equal sets whose fingerprints differ, as their words come in another order or number
    split = sets.where("fp <> last").select("shingles", F.col("fp").alias("a"))
    equal = prints.where("n > 0").join(split, "shingles").select("a", F.col("fp").alias("b"))
    return materialise(linked.union(equal).where("a <> b").distinct(), "similar")
