"""Seeds between all sequences, folded by query and target where they are found: no seed is ever shuffled.

The sequences are dealt to blocks by a hash of their key. Each pair of blocks is one task of a cartesian product, which reads both blocks' bases again
from one shuffle of the sequences: disk grows with the bases, not with the seeds. A block holds all of a key's sequences, so a query and a target
meet in one task only, and its groups are whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .kmers import base_codes, kmer_counts, kmer_positions

#: Bases of a block; a task holds the index of one block and takes the queries of another in parts.
BLOCK = 1 << 24
#: Fewer bases are dealt to several blocks only for the sake of cores.
SMALL, BLOCKS = 1 << 18, 4
#: Bases of queries looked up at once, and seeds folded at once; a single query is never cut.
PART, SEEDS = 1 << 19, 1 << 20

#: Seeds in the order of q, t, diagonal and, if asked for, qpos: q and t as one number, and the diagonal.
Sorted = tuple[np.ndarray, np.ndarray, np.ndarray]


def frequent_kmers(sequences: DataFrame, k: int, interval: int, key: str = "id", seq: str = "seq", factor: int = 10, least: int = 100) -> tuple[np.ndarray, int]:
    """The k-mers of more than frequency_limit() places, sorted, and the number of all places. Fewer than one in least places makes one."""
    counts = kmer_counts(kmer_positions(sequences, k, interval, key, seq))
    often = F.when(F.col("n") > least, F.col("kmer"))
    found = counts.groupBy(often.alias("kmer")).agg(F.sum("n").alias("n"), F.count("*").alias("kmers")).toArrow()
    places, kinds = (int(pc.sum(found[c]).as_py() or 0) for c in ("n", "kmers"))
    limit = max(float(least), factor * places / kinds if kinds else 0.0)
    rows = found.filter(pc.and_(pc.is_valid(found["kmer"]), pc.greater(pc.cast(found["n"], pa.float64()), limit)))
    return np.sort(rows["kmer"].to_numpy().astype(np.int64)), places


def _ordered(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of so many bits in order, and where each stood."""
    room = max(1, len(values).bit_length())
    if bits + room > 63:
        order = np.argsort(values, kind="stable")
        return values[order], order
    packed = np.sort(values << room | np.arange(len(values)))
    return packed >> room, packed & ((1 << room) - 1)


class _Block:
    """The sequences of a block, end to end, with a number for each key."""

    def __init__(self, rows: pa.StructArray, k: int) -> None:
        ids, seqs = rows.field("id"), rows.field("seq").cast(pa.large_string())
        coded = ids.dictionary_encode()
        self.ids, self.number, self.k = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), k
        self.bytes, self.at = self._flat(seqs)
        if len(self.bytes) and self.bytes.max() > 127:  # a letter is one place, whatever its bytes
            self.bytes, self.at = self._flat(pa.array([s.encode("ascii", "replace").decode() for s in seqs.to_pylist()], pa.large_string()))

    @staticmethod
    def _flat(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
        whole = seqs.buffers()[2]
        return np.frombuffer(whole, np.uint8)[: at[-1]] if whole is not None and len(at) else np.empty(0, np.uint8), at

    def parts(self) -> Iterator[tuple[int, int]]:
        """Runs of sequences of PART bases; those of one key, which lie side by side, stay together."""
        first = np.append(np.flatnonzero(np.diff(self.number, prepend=-1)), len(self.number))
        for a, b in _runs(np.diff(self.at[first]), PART):
            yield int(first[a]), int(first[b])

    def windows(self, a: int, b: int, interval: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, sequence, pos) of the windows of sequences a to b."""
        codes, good = base_codes(self.bytes[self.at[a] : self.at[b]], self.k)
        lengths = np.diff(self.at[a : b + 1])
        row = np.repeat(np.arange(a, b), lengths)[: len(codes)]
        pos = np.arange(self.at[a], self.at[a] + len(codes)) - self.at[row]
        good = good & (pos + self.k <= lengths[row - a])  # not over the end of a sequence
        keep = np.flatnonzero(good if interval == 1 else good & (pos % interval == 0))
        return codes[keep], row[keep], pos[keep]


def _index(block: _Block, interval: int, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """(k-mers, start, number of places, key of each place, pos of each place) without frequent k-mers."""
    codes, keys, places = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for a, b in block.parts():
        code, row, pos = block.windows(a, b, interval)
        if len(frequent):
            rare = frequent[np.minimum(np.searchsorted(frequent, code), len(frequent) - 1)] != code
            code, row, pos = code[rare], row[rare], pos[rare]
        codes.append(code)
        keys.append(block.number[row].astype(np.int32))
        places.append(pos.astype(np.int32))
    code, order = _ordered(np.concatenate(codes), 2 * block.k)
    del codes
    start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)
    return code[start], start, np.diff(np.append(start, len(code))), np.concatenate(keys)[order], np.concatenate(places)[order]


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs with sizes of most together, or of one that is larger; those of nothing are left out."""
    total, a = np.concatenate([[0], np.cumsum(sizes)]), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        if total[b] > total[a]:
            yield a, b
        a = b


def _met(queries: _Block, targets: _Block, interval: int, frequent: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(q, t, qpos, pos) of the seeds of a pair of blocks, all those of a query key at once; q and t are numbers of keys."""
    kmers, start, many, key, place = _index(targets, interval, frequent)
    if not len(kmers):
        return
    own = pc.fill_null(pc.index_in(queries.ids, targets.ids), -1).to_numpy(zero_copy_only=False)
    for a, b in queries.parts():
        code, row, pos = queries.windows(a, b)
        code, order = _ordered(code, 2 * queries.k)
        at = np.minimum(np.searchsorted(kmers, code), len(kmers) - 1)
        hit = kmers[at] == code
        order, at = order[hit], at[hit]
        order, back = _ordered(order, 40)
        query, pos, at = queries.number[row[order]], pos[order], at[back]
        n, base = many[at], queries.number[a]
        for low, high in _runs(np.bincount(query - base, n).astype(np.int64), SEEDS):
            i, j = np.searchsorted(query, [base + low, base + high])
            total, m = np.cumsum(n[i:j]), n[i:j]
            spot = np.arange(total[-1]) + np.repeat(start[at[i:j]] - total + m, m)
            q, t = np.repeat(query[i:j], m), key[spot]
            other = own[q] != t
            yield q[other], t[other], np.repeat(pos[i:j], m)[other], place[spot][other]


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where a group of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _sorted(pair: np.ndarray, diagonal: np.ndarray, qpos: np.ndarray | None = None) -> Sorted:
    """By pair, diagonal and qpos; packed into one number where that has room."""
    low = int(diagonal.min())
    wide = (int(diagonal.max()) - low).bit_length()
    deep = 0 if qpos is None else int(qpos.max()).bit_length()
    if int(pair.max()).bit_length() + wide + deep > 62:
        order = np.lexsort((diagonal, pair) if qpos is None else (qpos, diagonal, pair))
        return pair[order], diagonal[order], qpos if qpos is None else qpos[order]
    packed = pair << wide | (diagonal - low)
    packed = np.sort(packed if qpos is None else packed << deep | qpos)
    return packed >> (wide + deep), (packed >> deep & ((1 << wide) - 1)) + low, None if qpos is None else packed & ((1 << deep) - 1)


Fold = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, list[np.ndarray]]]


def _counted(pair: np.ndarray, diagonal: np.ndarray, qpos: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    pair = np.sort(pair)
    at = _edges(pair)
    return pair[at], [np.diff(np.append(at, len(pair)))]


def _by_diagonal(least: int) -> Fold:
    def fold(pair: np.ndarray, diagonal: np.ndarray, qpos: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        pair, diagonal, qpos = _sorted(pair, diagonal, qpos)
        at = _edges(pair, diagonal)
        end = np.append(at[1:], len(pair))
        new = np.zeros(len(pair), np.int64)
        new[_edges(pair, diagonal, qpos)] = 1  # a place that a key's sequences share counts once
        kinds = np.add.reduceat(new, at)
        middle = (qpos[(at + end - 1) // 2] + qpos[(at + end) // 2]) / 2
        keep = kinds >= least
        return pair[at][keep], [diagonal[at][keep], kinds[keep], qpos[at][keep], qpos[end - 1][keep], middle[keep]]

    return fold


def _on_both_sides(edge: int) -> Fold:
    def fold(pair: np.ndarray, diagonal: np.ndarray, qpos: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        pair, diagonal, side = _sorted(pair, diagonal, (qpos >= edge).astype(np.int64))
        at = _edges(pair, diagonal)
        both = side[at] != side[np.append(at[1:], len(pair)) - 1]
        return pair[at][both], [diagonal[at][both]]

    return fold


def _by_base(reach: int) -> Fold:
    def fold(pair: np.ndarray, diagonal: np.ndarray, qpos: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        pair, diagonal, _ = _sorted(pair, diagonal)
        first = _edges(pair)
        end = np.append(first[1:], len(pair))
        bases, at = [], first
        while len(at):  # the next base of every pair at once
            bases.append(at)
            beyond = _after(diagonal, at, end, diagonal[at] + reach)
            more = beyond < end
            at, end = beyond[more], end[more]
        at = np.sort(np.concatenate(bases))
        return pair[at], [diagonal[at], np.diff(np.append(at, len(pair)))]

    return fold


def _after(values: np.ndarray, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each run low to high of sorted values, the first place of more than bound, or high."""
    low, high = low.copy(), high.copy()
    while (low < high).any():
        middle = (low + high) // 2
        over = (low < high) & (values[np.minimum(middle, len(values) - 1)] > bound)
        low, high = np.where((low < high) & ~over, middle + 1, low), np.where(over, middle, high)
    return low


def _folded(sequences: DataFrame, k: int, interval: int, fold: Fold, columns: dict[str, type], key: str, seq: str) -> DataFrame:
    frequent, places = frequent_kmers(sequences, k, interval, key, seq)
    bases = places * interval
    n = max(-(-bases // BLOCK), min(BLOCKS, -(-bases // SMALL)), 1)
    kind = sequences.schema[key].dataType
    schema = StructType([StructField("query", kind), StructField("target", kind), *(StructField(c, t()) for c, t in columns.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                q, t = (_Block(batch.column(c).slice(i, 1).flatten(), k) for c in ("queries", "targets"))
                for one, two, qpos, pos in _met(q, t, interval, frequent):
                    if len(one):
                        pair, found = fold(one * len(t.ids) + two, pos - qpos, qpos)
                        ids = [q.ids.take(pa.array(pair // len(t.ids))), t.ids.take(pa.array(pair % len(t.ids)))]
                        yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, found)], schema.names)

    rows = sequences.where(F.col(key).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("block"), F.struct(F.col(key).alias("id"), F.coalesce(seq, F.lit("")).alias("seq")).alias("x"))
    # sorted by key, so that a key's sequences lie side by side and are looked up together
    blocks = rows.repartitionById(n, "block").groupBy("block").agg(F.sort_array(F.collect_list("x")).alias("x"))
    pairs = blocks.select(F.col("x").alias("queries")).crossJoin(blocks.select(F.col("x").alias("targets")).hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(run, schema)


def seed_counts(sequences: DataFrame, k: int, interval: int, key: str = "id", seq: str = "seq") -> DataFrame:
    """(query, target, n): seeds of each query k-mer in the index of every interval-th place of all other sequences, without frequent k-mers."""
    return _folded(sequences, k, interval, _counted, {"n": LongType}, key, seq)


def seed_diagonals(sequences: DataFrame, k: int, interval: int, least: int = 2, key: str = "id", seq: str = "seq") -> DataFrame:
    """(query, target, diagonal, n, first, last, middle), as kmers.diagonals() of those seeds."""
    return _folded(sequences, k, interval, _by_diagonal(least), {**dict.fromkeys(("diagonal", "n", "first", "last"), LongType), "middle": DoubleType}, key, seq)


def shared_diagonals(sequences: DataFrame, k: int, interval: int, edge: int, key: str = "id", seq: str = "seq") -> DataFrame:
    """(query, target, diagonal) with a seed before place edge of the query and one from it on."""
    return _folded(sequences, k, interval, _on_both_sides(edge), {"diagonal": LongType}, key, seq)


def seed_bases(sequences: DataFrame, k: int, interval: int, reach: int = 12, key: str = "id", seq: str = "seq") -> DataFrame:
    """(query, target, base, n), as kmers.collapse_diagonals() of those seeds."""
    return _folded(sequences, k, interval, _by_base(reach), {"base": LongType, "n": LongType}, key, seq)
