"""SentencePiece models run by the tokenizers library: the model file is parsed here and rebuilt there."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Distinct chunks whose ids a worker keeps at most; the cache starts anew beyond that.
CACHED_CHUNKS = 200_000
#: Chunks of a string that is encoded at once, and threads of the library.
GROUP, THREADS = 1_000, 2
_LETTERS = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields, in order."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            if kind not in (1, 2, 5):
                raise ValueError(f"wire type {kind}")
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # piece, score, type
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True  # remove_extra_whitespaces
    escape: bool = True
    suffix: bool = False  # treat_whitespace_as_suffix

    @classmethod
    def parse(cls, data: bytes) -> Model:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                model.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        model.kind = v
                    elif n == 24:
                        model.suffix = bool(v)
                    elif n == 35:
                        model.byte_fallback = bool(v)
                    elif n == 40:
                        model.unk_id = v
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        model.charsmap = v
                    elif n == 3:
                        model.dummy_prefix = bool(v)
                    elif n == 4:
                        model.squeeze = bool(v)
                    elif n == 5:
                        model.escape = bool(v)
        if model.kind not in (UNIGRAM, BPE) or model.suffix:
            raise ValueError("only unigram and BPE models with the space marker in front are supported")
        return model


class Codec:
    """Encodes and decodes as the model's own library does, with the tokenizers library doing the segmentation.

    The normaliser (character map, extra spaces, space marker) works on whole texts. The normalised text is then cut
    into chunks where no piece of the vocabulary crosses: in front of a run of markers and around characters that
    only ever stand alone. Neither merges nor a best path can cross such a cut, so chunks are encoded once each.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, models, normalizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        with open(path, "rb") as f:
            self.model = Model.parse(f.read())
        m = self.model
        self.pieces = [p for p, _, _ in m.pieces]
        ids = {p: i for i, p in enumerate(self.pieces)}
        self.user = sorted((p for p, _, t in m.pieces if t == USER_DEFINED), key=len, reverse=True)
        if m.kind == UNIGRAM:
            # control pieces never match text: no text holds their names once escaped away from the lattice
            core = models.Unigram([(p, s if t in (NORMAL, USER_DEFINED) else -1e9) for p, s, t in m.pieces], m.unk_id, m.byte_fallback)
        else:
            core = models.BPE(ids, self._merges(ids), unk_token=self.pieces[m.unk_id], fuse_unk=True, byte_fallback=m.byte_fallback)
        self.tokenizer = Tokenizer(core)
        self.charsmap = normalizers.Precompiled(m.charsmap) if m.charsmap else None
        self.chunk = None if self.user else self._cuts([p for p, _, t in m.pieces if t == NORMAL])
        self.mark = self._separator()
        self.bytes_of = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, t in m.pieces]
        self.is_byte = np.array([t == BYTE for _, _, t in m.pieces])
        self.fallback = np.array([t in (BYTE, UNKNOWN) for _, _, t in m.pieces])
        self.known: dict[str, bytes] = {}

    def _merges(self, ids: dict[str, int]) -> list[tuple[str, str]]:
        """Pairs that make a piece, best score of the result first; pieces are merged by the score of what they make."""
        usable = {p for p, _, t in self.model.pieces if t == NORMAL}
        found = []
        for piece, score, kind in self.model.pieces:
            if kind == NORMAL:
                for i in range(1, len(piece)):
                    if (a := piece[:i]) in usable and (b := piece[i:]) in usable:
                        found.append((-score, ids[piece], i, a, b))
        return [(a, b) for _, _, _, a, b in sorted(found)]

    def _cuts(self, pieces: list[str]) -> re.Pattern | None:
        """What finds the chunks of normalised text; none where a piece holds a marker behind other signs.

        Chunks start at a run of markers and stand around line ends and tabs that are in no longer piece. With byte fallback, where unknown
        characters never join, they also end between a letter and those signs that no piece has right behind or in front of a letter.
        """
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            return None
        joined = {c for p in pieces if len(p) > 1 for c in p}
        breaks = "".join(re.escape(c) for c in "\n\t" if c not in joined)
        beside = {c for p in pieces for x, y in zip(p, p[1:], strict=False) if _LETTERS.match(x) or _LETTERS.match(y) for c in (x, y)}
        signs = "".join(re.escape(c) for c in "!\"#$%&()*+,-./:;<=>?@[\\]_{|}" if c not in beside) if self.model.byte_fallback else ""
        end = f"[{_LETTERS.pattern[1:-1]}]+(?=[{signs}])|[{signs}]+(?=[{_LETTERS.pattern[1:-1]}])|" if signs else ""
        plain = f"[^{SPACE}{breaks}]"
        start = f"{SPACE}+(?:{end}{plain}*)" if end else f"{SPACE}+{plain}*"
        return re.compile((f"[{breaks}]|" if breaks else "") + f"{start}|{end}{plain}+")

    def _separator(self) -> int | None:
        """The id of a line end, if it is one id and no chunk but itself holds one: it parts chunks that are encoded in one string."""
        if self.chunk is None or self.chunk.findall("a\nb") != ["a", "\n", "b"]:
            return None
        ids = self._segment(["\n"])[0]
        return ids[0] if len(ids) == 1 else None

    def _ids_of(self, parts: list[str]) -> list[bytes]:
        """The ids of each chunk, encoded many to a string and multithreaded over the strings."""
        if self.mark is None or "\n" in parts:
            return [np.array(x, "<u4").tobytes() for x in self._segment(parts)]
        groups = [parts[i : i + GROUP] for i in range(0, len(parts), GROUP)]
        out: list[bytes] = []
        for group, found in zip(groups, self._segment(["\n".join(g) for g in groups]), strict=True):
            ids = np.array(found, "<u4")
            ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            if len(ends) != len(group):
                raise ValueError("a chunk's ids hold the separator")
            data, at = ids.tobytes(), 0
            for end in ends:
                out.append(data[4 * at : 4 * end])
                at = end + 1
        return out

    def normalise(self, text: str) -> str:
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if self.model.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.model.escape else text

    def _segment(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def encode_batch(self, docs: list[str]) -> list[np.ndarray]:
        return self.encode_normal([self.normalise(t) for t in docs])

    def encode_normal(self, normal: list[str]) -> list[np.ndarray]:
        """The ids of texts that are normalised already."""
        if self.chunk is None:
            return [np.array(x, np.uint32) for x in self._segment(normal)]
        parts = [self.chunk.findall(t) for t in normal]
        new = list({p for doc in parts for p in doc if p not in self.known})
        if len(self.known) + len(new) > CACHED_CHUNKS:
            self.known, new = {}, list({p for doc in parts for p in doc})
        lines = [p for p in new if p == "\n"]
        new = [p for p in new if p != "\n"]
        for some in (lines, *(new[at : at + 16 * GROUP] for at in range(0, len(new), 16 * GROUP))):
            self.known.update(zip(some, self._ids_of(some), strict=True))
        ids = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids, doc)), "<u4") for doc in parts]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 come out as U+FFFD, one each, as in the model's own library."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        if self.model.dummy_prefix and raw[:1] == b" " and len(ids) and not self.is_byte[ids[0]]:
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    return Codec(path)


@cache
def _own(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def parity(path: str, parts: list[str]) -> list[bool]:
    """Whether this codec and the model's own library give the same ids and the same text back."""
    ours = codec(path)
    own = _own(path)
    got = ours.encode_batch(parts)
    return [a.tolist() == b and ours.decode(a) == own.decode(b) for a, b in zip(got, own.encode(parts, num_threads=1), strict=True)]


def _run(path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = codec(path)
        for batch in batches:
            normal = [ours.normalise(t.as_py()) for t in batch.column("text")]
            encoded = ours.encode_normal(normal)
            decoded = [ours.decode(x) for x in encoded]
            plain = [t.replace(SPACE, " ") for t in normal]
            cut = 1 if ours.model.dummy_prefix else 0
            columns = [
                batch.column("doc_id"),
                pa.array([len(x) for x in encoded], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in encoded], pa.int64()),
                pa.array([int(ours.fallback[x].sum()) if len(x) else 0 for x in encoded], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in decoded], pa.string()),
                pa.array([t == p[cut:] for t, p in zip(decoded, plain, strict=True)], pa.bool_()),
            ]
            names = ["doc_id", "n_tokens", "ids_crc32", "n_fallback", "decoded_sha256", "round_trip"]
            if keep_ids:
                columns, names = [*columns, pa.array([x.astype(np.int32) for x in encoded], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, model: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row per document, whatever its text: doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers), n_fallback (byte and unknown ids), decoded_sha256 (of the ids' text), round_trip (that text is the
    normalised one) and, if asked for, ids.

    Null texts count as empty: no ids. Rows that repeat are encoded each; there is no shuffle and no state between rows.
    """
    kind = "doc_id long, n_tokens long, ids_crc32 long, n_fallback long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids
    return texts(docs).mapInArrow(_run(model or default_model(), keep_ids), kind)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep_ids=False)
