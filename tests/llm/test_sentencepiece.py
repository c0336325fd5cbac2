"""The tokenizers backend against the model's own library."""

import hashlib
import random
import zlib

import numpy as np
import sentencepiece
from strandline.llm import sentencepiece_codec as spc

SCHEMA = "doc_id long, text string, ids string"


def odd_texts(n=300, seed=6):
    rng = random.Random(seed)
    parts = ["the", " ", "  ", "ing", "\n", "\t", "é", "💥", "日本", "▁", "a▁b", "<s>", "</s>", "<unk>", "<0x41>", "1", "…", "ﬁ", "Ⅷ", " ", "​", "é", "\x01", "ß", "Straße", "qwxzj", "..."]
    return ["", " ", "\n", "▁", "   lead", "trail   ", "a  b", "word " * 3000] + ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(n)]


def test_parity_on_odd_texts():
    texts = odd_texts()
    assert [t for t, same in zip(texts, spc.parity(spc.default_model(), texts), strict=True) if not same] == []


def test_cache_restart(monkeypatch):
    monkeypatch.setattr(spc, "CACHED_CHUNKS", 5)
    codec, own = spc.Codec(spc.default_model()), sentencepiece.SentencePieceProcessor(model_file=spc.default_model())
    for text in odd_texts(60, 9):
        assert codec.encode_batch([text])[0].tolist() == own.encode(text)


def message(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | (5 if isinstance(value, np.float32) else 2)) + (value.tobytes() if isinstance(value, np.float32) else varint(len(value)) + value)


def unigram_model():
    """The bytes of a small unigram model with byte fallback."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [(p, s, 1) for p, s in (("▁", -2.5), ("▁the", -3.1), ("▁th", -4.2), ("e", -4.0), ("t", -4.3), ("h", -4.4), ("he", -5.1), ("▁cat", -6.0), ("c", -5.0), ("a", -4.6), ("at", -4.9), ("s", -4.1), ("▁sat", -6.5))]
    data = b"".join(message(1, message(1, p.encode()) + message(2, np.float32(s)) + message(3, k)) for p, s, k in pieces)
    return data + message(2, message(3, 1) + message(35, 1) + message(40, 0)) + message(3, message(1, b"identity") + message(3, 1) + message(4, 1) + message(5, 1))


def test_unigram_model_from_its_protobuf(tmp_path):
    path = tmp_path / "uni.model"
    path.write_bytes(unigram_model())
    own, ours = sentencepiece.SentencePieceProcessor(model_file=str(path)), spc.Codec(str(path))
    rng = random.Random(2)
    texts = ["the cat sat", " the  cats", "é", "", "that", "zzz the"] + ["".join(rng.choices("theca s z", k=rng.randrange(1, 30))) for _ in range(200)]
    for text, ids in zip(texts, ours.encode_batch(texts), strict=True):
        assert ids.tolist() == own.encode(text), text
        assert ours.decode(ids) == own.decode(ids.tolist())


def test_operator(spark):
    texts = odd_texts(40, 3)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (5, "twice", "x"), (5, "twice", "x")]
    got = spc.encode(spark.createDataFrame(rows, SCHEMA)).collect()
    own = sentencepiece.SentencePieceProcessor(model_file=spc.default_model())
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.ids == [] and r.round_trip
        elif r.doc_id != 5:
            ids = own.encode(texts[r.doc_id])
            assert r.ids == ids and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            assert r.decoded_sha256 == hashlib.sha256(own.decode(ids).encode()).hexdigest()
    assert spc.encode(spark.createDataFrame([], SCHEMA)).count() == 0
