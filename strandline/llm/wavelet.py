"""Token ids kept as wavelet matrices: one compressed file per shard, with rank and select."""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, batch_rows, materialise, new_path, table, texts

MAGIC = b"SWM2"
END_ID = 2
#: Tokens of a shard file at most (a longer document gets a file of its own), and documents of a task's range of ids about.
SHARD_TOKENS, RANGE_DOCS = 2_000_000, 8_000
#: Rows of an Arrow batch of texts: a larger one holds fewer distinct words for its size, and costs a worker more memory.
TEXT_ROWS = 2_048
#: Distinct words of each of the two generations that a worker keeps the ids of, about.
CACHED_WORDS = 400_000
_BLOCK, UNIT = 512, 1 << 16  # bits of a rank block, and bytes of a plane that are compressed together


class Plane:
    """One bit of every value: compressed units that are inflated when they are first read, and the ones before every block of _BLOCK bits."""

    def __init__(self, n: int, units: list[bytes | np.ndarray], blocks: np.ndarray) -> None:
        self.n, self.units, self.blocks = n, units, blocks

    @classmethod
    def build(cls, n: int, data: np.ndarray) -> Plane:
        padded = np.zeros(-(-max(1, n) // _BLOCK) * (_BLOCK // 8), np.uint8)
        padded[: len(data)] = data
        counts = np.bitwise_count(padded.view(np.uint64)).reshape(-1, _BLOCK // 64).sum(axis=1, dtype=np.uint32)
        return cls(n, [padded[i : i + UNIT] for i in range(0, len(padded), UNIT)], np.concatenate([[0], np.cumsum(counts, dtype=np.uint32)]).astype(np.uint32))

    def unit(self, i: int) -> np.ndarray:
        if isinstance(self.units[i], bytes):
            self.units[i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.units[i]), np.uint8)
        return self.units[i]

    def bits(self) -> np.ndarray:
        return np.concatenate([self.unit(i) for i in range(len(self.units))])

    def zeros(self) -> int:
        return self.n - int(self.blocks[-1])

    def bit(self, i: int) -> int:
        return int(self.unit(i // (8 * UNIT))[i // 8 % UNIT]) >> (i % 8) & 1

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first so many bits, for each entry of at."""
        out = self.blocks[at // _BLOCK].astype(np.int64)
        within = np.flatnonzero(at % _BLOCK)
        for u in np.unique(at[within] // (8 * UNIT)).tolist():
            some = within[at[within] // (8 * UNIT) == u]
            words, here = self.unit(u).view(np.uint64), at[some] - u * 8 * UNIT
            start, upto = here // _BLOCK * (_BLOCK // 64), here // 64
            for k in range(_BLOCK // 64):  # whole words of the block in front, then the part of the last one
                word = np.minimum(start + k, len(words) - 1)
                take = np.where(start + k < upto, np.uint64(0xFFFFFFFFFFFFFFFF), np.where(start + k == upto, (np.uint64(1) << (here % 64).astype(np.uint64)) - np.uint64(1), np.uint64(0)))
                out[some] += np.bitwise_count(words[word] & take)
        return out

    def place(self, bit: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th bits (from 0) of this value, by bisection of the counts."""
        low, high = np.zeros_like(k), np.full_like(k, self.n)
        while (open_ := high - low > 1).any():
            mid = np.where(open_, (low + high) // 2, low)
            ones = self.ones(mid)
            before = (ones if bit else mid - ones) <= k
            low, high = np.where(open_ & before, mid, low), np.where(open_ & ~before, mid, high)
        return low


class WaveletMatrix:
    """A sequence of non-negative integers as bit-planes, the highest bit first.

    Each level stores one bit of every value; values with a 0 go on in front of those with a 1. access, rank and select
    take one step a level; a count of ones every 512 bits makes each step's rank a short popcount.
    """

    def __init__(self, n: int, planes: list[Plane]) -> None:
        self.n, self.planes, self.levels = n, planes, len(planes)

    @classmethod
    def build(cls, values: np.ndarray, levels: int | None = None) -> WaveletMatrix:
        levels = levels or max(1, int(values.max(initial=0)).bit_length())
        kind = np.uint16 if levels <= 16 else np.uint32
        values, planes = np.asarray(values).astype(kind), []
        for b in reversed(range(levels)):
            ones = (values & kind(1 << b)).astype(bool)
            planes.append(Plane.build(len(values), np.packbits(ones, bitorder="little")))
            if b:
                values = np.concatenate([np.compress(~ones, values), np.compress(ones, values)])
        return cls(len(values), planes)

    def values(self) -> np.ndarray:
        """The whole sequence: the levels' stable partitions undone from the last to the first."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for b, plane in enumerate(reversed(self.planes)):
            ones = np.unpackbits(plane.bits(), count=self.n, bitorder="little").view(bool)
            back, zeros = np.empty(self.n, kind), plane.zeros()
            back[np.flatnonzero(~ones)], back[np.flatnonzero(ones)] = out[:zeros], out[zeros:] | kind(1 << b)  # places are taken quicker than a mask
            out = back
        return out

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in self.planes:
            bit, ones = plane.bit(i), int(plane.ones(np.array([i]))[0])
            value, i = value << 1 | bit, plane.zeros() + ones if bit else i - ones
        return value

    def _below(self, value: int, at: np.ndarray) -> np.ndarray:
        """Where positions of the sequence come to stand below the last level if they follow value."""
        for level, plane in enumerate(self.planes):
            ones = plane.ones(at)
            at = plane.zeros() + ones if value >> (self.levels - 1 - level) & 1 else at - ones
        return at

    def ranks(self, value: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of value among the first so many values, for each entry of at."""
        at = np.clip(np.asarray(at, np.int64), 0, self.n)
        if not 0 <= value < 1 << self.levels:
            return np.zeros(len(at), np.int64)
        return self._below(value, at) - self._below(value, np.zeros(1, np.int64))

    def rank(self, value: int, i: int | None = None) -> int:
        """Occurrences of value among the first i values (all by default)."""
        return int(self.ranks(value, np.array([self.n if i is None else i]))[0])

    def selects(self, value: int, k: np.ndarray) -> np.ndarray:
        """Positions of the occurrences number k (from 0) of value, for each entry of k."""
        k = np.asarray(k, np.int64)
        if len(k) and not 0 <= k.min() <= k.max() < self.rank(value):
            raise IndexError(value)
        at = self._below(value, np.zeros(1, np.int64)) + k
        for level in reversed(range(self.levels)):
            bit, plane = value >> (self.levels - 1 - level) & 1, self.planes[level]
            at = plane.place(bit, at - plane.zeros() if bit else at)
        return at

    def select(self, value: int, k: int) -> int:
        """Position of occurrence number k (from 0) of value."""
        return int(self.selects(value, np.array([k]))[0])

    def occurrences(self, value: int) -> list[int]:
        return self.selects(value, np.arange(self.rank(value))).tolist()


def pack(doc_ids: Iterable[int], lengths: Iterable[int], values: np.ndarray) -> bytes:
    """A shard file: magic, counts, the documents' ids and lengths deflated, then of each plane the rank blocks and its units (compressed where that helps)."""
    matrix, doc_ids, lengths = WaveletMatrix.build(values), np.asarray(list(doc_ids), np.int64), np.asarray(list(lengths), np.int64)
    head, squeeze = zlib.compress(doc_ids.tobytes() + lengths.tobytes(), 1), zstandard.ZstdCompressor(level=1)
    out = [MAGIC, struct.pack("<QQBI", matrix.n, len(doc_ids), matrix.levels, len(head)), head]
    for plane in matrix.planes:
        units = []
        for unit in plane.units:
            small = squeeze.compress(unit.tobytes())
            units.append((len(small) < 0.9 * unit.nbytes, small if len(small) < 0.9 * unit.nbytes else unit.tobytes()))
        out += [struct.pack("<II", len(plane.blocks), len(units)), plane.blocks.tobytes()]
        out += [struct.pack("<BI", small, len(kept)) for small, kept in units]
        out += [kept for _, kept in units]
    return b"".join(out)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """(doc_ids, lengths, matrix) of a shard file; a unit of a plane is inflated when something in it is asked for."""
    if data[:4] != MAGIC:
        raise ValueError("not a shard file")
    n, docs, levels, head = struct.unpack_from("<QQBI", data, 4)
    at = 4 + struct.calcsize("<QQBI")
    both, at, planes = np.frombuffer(zlib.decompress(data[at : at + head]), np.int64), at + head, []
    for _ in range(levels):
        n_blocks, n_units = struct.unpack_from("<II", data, at)
        blocks, at = np.frombuffer(data, np.uint32, n_blocks, at + 8), at + 8 + 4 * n_blocks
        sizes, at, units = [struct.unpack_from("<BI", data, at + 5 * i) for i in range(n_units)], at + 5 * n_units, []
        for small, size in sizes:
            units.append(data[at : at + size] if small else np.frombuffer(data[at : at + size], np.uint8))
            at += size
        planes.append(Plane(n, units, blocks))
    return both[:docs], both[docs:], WaveletMatrix(n, planes)


class _Store:
    """Files in any store that Arrow can reach by URI."""

    def __init__(self, folder: str) -> None:
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.local = isinstance(self.fs, fs.LocalFileSystem)

    def write(self, name: str, data: bytes) -> None:
        """All or nothing: a task that dies leaves no file of that name, and one that runs twice writes the same bytes."""
        if self.local:
            self.fs.create_dir(self.path)
        part = f"{self.path}/.{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as f:
            f.write(data)
        self.fs.move(part, f"{self.path}/{name}")

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.path}/{name}") as f:
            return f.read()


#: Between a letter and a run of these signs that ends a word, the tokenizer cuts by itself.
_TAIL = re.compile(rb"(?<=[a-z\xdf-\xf6\xf8-\xff])([.,!?;:|#&*%$]+)(?=\s|$)")
#: Latin-1 in lower case; and its kinds: full stops and commas as "." and other signs as "!", the rest as "a". Where no "." stands behind a sign, each can be cut off by itself.
_LOWER = bytes(ord(chr(c).lower()) for c in range(256))
_WORD_OR_SPACE = re.compile(rb"[\sA-Za-z0-9\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]")
_KINDS = bytes(ord("." if chr(c) in ".," else "a" if _WORD_OR_SPACE.match(bytes([c])) else "!") for c in range(256))
#: How a tokenizer's file spells the normalising and cutting that plain_bytes() relies on.
NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Words by which the short way is tried out: whether the model alone gives what the whole tokenizer gives.
TRIAL = ("a", "the", "tions", "onenthatwhing", "é", "über", "façonñ", "ß", "ªº", "straßenà", "qzxjkvw", "þðæøå")


def plain_bytes(text: str) -> bytes | None:
    """A text as lower-case Latin-1 bytes with white space wherever a tokenizer cuts that lower-cases and cuts at white space and between
    letters and signs; None for one of other letters or one that may hold a special token's name."""
    if "<|" in text:
        return None
    try:
        data = text.encode("latin-1").translate(_LOWER)
    except UnicodeEncodeError:
        return None
    kinds = data.translate(_KINDS)
    if b".." in kinds or b"!." in kinds:
        return _TAIL.sub(rb" \1", data)
    for sign in (b".", b","):
        data = data.replace(sign + b" ", b" " + sign + b" ").replace(sign + b"\n", b" " + sign + b"\n")
    return data


def words_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, word numbers of all texts in a row, where each text's begin and the last one's end); cut at ASCII white space by Arrow."""
    data = pa.array(texts, pa.large_binary())
    # the kernel looks at bytes only, so that these are Latin-1 and not UTF-8 does no harm
    cut = pc.ascii_split_whitespace(data.view(pa.large_string()))
    coded = cut.flatten().view(pa.large_binary()).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), cut.offsets.to_numpy().astype(np.int64)


class WordEncoder:
    """Encodes texts part by part, if the tokenizer's file says that it lower-cases and cuts as plain_bytes() relies on, else as wholes.

    A part's ids are the library's own, kept once found. The cache has two generations: when the younger is full it
    becomes the older, and parts found in the older one move on, so what is frequent stays.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        cuts = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.by_parts = (spec["normalizer"] or {}).get("normalizers") == NORMALISER and cuts.get("pattern") == {"Regex": CUTS} and cuts.get("behavior") == "Removed"
        self.model = self.tokenizer.model
        self.direct = self.by_parts and [self._of_letters(w) for w in TRIAL] == self._whole(list(TRIAL))
        self.cache: dict[bytes | str, bytes] = {}
        self.older: dict[bytes | str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if not self.by_parts:
            return self._whole(texts)
        if len(self.cache) > CACHED_WORDS:
            self.cache, self.older = {}, self.cache
        plain = [plain_bytes(t) for t in texts]
        ids = iter(self._encode_plain([p for p in plain if p is not None]))
        return [next(ids) if p is not None else self._encode_words(t) for p, t in zip(plain, texts, strict=True)]

    def _encode_plain(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts from plain_bytes(): each distinct word is looked up once, then all places are filled by number."""
        words, numbers, bounds = words_of(texts)
        known = self.cache.get
        found = [known(w) or self._found(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        times = sizes[numbers]
        ends = np.cumsum(times)
        total = int(ends[-1]) if len(ends) else 0
        data = ids[np.arange(total) + np.repeat(starts[numbers] - ends + times, times)].tobytes()
        cuts = (4 * np.concatenate([[0], ends])[bounds]).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _encode_words(self, text: str) -> bytes:
        """The ids of any text, cut at ASCII white space and unchanged."""
        return b"".join(self._found(w.decode("utf-8", "replace")) for w in text.encode("utf-8", "surrogatepass").split())

    def _found(self, part: bytes | str) -> bytes:
        """The ids of a part that the younger generation may lack; letters are cut off from signs and digits, where no apostrophe stands with them."""
        if not part:
            return b""
        ids = self.cache.get(part) or self.older.get(part)
        if ids is None:
            word = part.decode("latin-1") if isinstance(part, bytes) else part
            short = self.direct and isinstance(part, bytes)
            if short and word.isalpha():
                ids = self._of_letters(word)
            elif short and "'" not in word and len(both := _LETTERS.split(word)) > 1:
                ids = b"".join(self._found(x.encode("latin-1")) for x in both if x)
            else:
                ids = self._whole([word])[0]
        self.cache[part] = ids
        return ids

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_letters(self, word: str) -> bytes:
        """A lower-case word of Latin-1 letters by the model alone: there is nothing to normalise or to cut in it."""
        tokens = self.model.tokenize(word.translate(_BYTES))
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])


#: Runs of Latin-1 letters: the tokenizer cuts between them and anything else, but for an apostrophe with certain letters.
_LETTERS = re.compile("([a-zªµºß-öø-ÿ]+)")


def _byte_letters() -> dict[int, str]:
    """Latin-1 characters as the characters that byte-level vocabularies have for their UTF-8 bytes: the visible ones stand for themselves, the rest are numbered from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}


_BYTES = _byte_letters()


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _write(folder: str, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, key, part = _Store(folder), TaskContext.get().partitionId(), 0
        held: list[tuple[int, bytes]] = []
        end, size = struct.pack("<I", END_ID), 0

        def flush() -> pa.RecordBatch:
            lengths, name = [len(x) // 4 for _, x in held], f"shard-{key:06d}-{part:05d}.swm"
            store.write(name, pack([d for d, _ in held], lengths, np.frombuffer(b"".join(x for _, x in held), "<u4")))
            return pa.RecordBatch.from_pylist([{"shard_range": key, "part": part, "name": name, "n_docs": len(held), "n_tokens": sum(lengths)}], schema=_MANIFEST)

        for batch in batches:
            encoded = encoder(path).encode([t.as_py() for t in batch.column("text")])
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                ids += end
                if held and size + len(ids) // 4 > SHARD_TOKENS:
                    yield flush()
                    held, size, part = [], 0, part + 1
                held.append((-1 if doc is None else doc, ids))
                size += len(ids) // 4
        if held:
            yield flush()

    return run


_MANIFEST = pa.schema([("shard_range", pa.int64()), ("part", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Encode every text, append END_ID to each, and write the ids in ascending doc_id order to shard files in folder.

    Returns the manifest (shard_range, part, name, n_docs, n_tokens), in that order the order of the ids. Each task gets
    a range of ids with about RANGE_DOCS documents and cuts it into files of up to SHARD_TOKENS ids as it streams by in
    order, so it holds one file's ids. Null texts count as empty (only END_ID). Rows without doc_id come first and read
    back as -1; rows that repeat a doc_id are ordered by their text. An empty table has no shard.
    """
    rows = texts(docs)
    ranges = max(1, -(-rows.count() // RANGE_DOCS))
    ordered = rows.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(_write(folder, tokenizer or default_tokenizer()), "shard_range long, part long, name string, n_docs long, n_tokens long")
    with batch_rows(docs.sparkSession, TEXT_ROWS):
        return materialise(written, "manifest")


_DOCS = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32", "n_end_ids")])


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _Store(folder)
        for batch in batches:
            for name, base in zip(batch.column("name"), batch.column("base"), strict=True):
                doc_ids, lengths, matrix = unpack(store.read(name.as_py()))
                ids, ends = matrix.values().astype("<u4", copy=False), np.cumsum(lengths)
                starts = ends - lengths
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                marked = matrix.ranks(END_ID, ends) - matrix.ranks(END_ID, starts)
                for at in range(0, len(doc_ids), 16 * BATCH_ROWS):
                    part = slice(at, at + 16 * BATCH_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc_ids[part], starts[part] + base.as_py(), lengths[part], crcs[part], marked[part])], schema=_DOCS)

    return run


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_end_ids) of every document, read back from the shard files; the last counts END_ID by rank.

    Where a shard starts is the sum of the ranges before its own, one row a range, and of the parts before it in its range.
    """
    ranges = manifest.groupBy("shard_range").agg(F.sum("n_tokens").alias("n"))
    before = ranges.select("shard_range", F.coalesce(F.sum("n").over(Window.orderBy("shard_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    parts = Window.partitionBy("shard_range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("own", F.coalesce(F.sum("n_tokens").over(parts), F.lit(0))).join(before, "shard_range").select("name", (F.col("own") + F.col("before")).alias("base"))
    spread = based.repartition(max(1, manifest.count()), "name")
    return spread.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long, n_end_ids long")


def op2_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "shards")
    return read_shards(write_shards(table(spark, sf_dir, "documents"), folder), folder)
