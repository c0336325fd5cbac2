"""Token files against the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest
from strandline.llm import wavelet
from strandline.llm.common import new_path

SCHEMA = "doc_id long, text string, start string"


def direct(path, docs):
    """(doc_id, start, n, crc) of texts in ascending order, encoded one by one."""
    from tokenizers import Tokenizer

    tokenizer, at, out = Tokenizer.from_file(path), 0, []
    for doc, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((-1 if doc is None else doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids.count(2)))
        at += len(ids)
    return out


def test_matrix_equals_list():
    rng = random.Random(5)
    for n in (0, 1, 7, 600, 3000):
        values = [rng.randrange(40) for _ in range(n)]
        matrix = wavelet.WaveletMatrix.build(np.array(values, np.uint32))
        assert matrix.values().tolist() == values
        for i in rng.sample(range(n), min(n, 30)):
            assert matrix.access(i) == values[i]
            assert matrix.rank(values[i], i) == values[:i].count(values[i])
        for v in (0, 3, 39, 40, 1 << 20):
            assert matrix.rank(v) == values.count(v)
            assert matrix.occurrences(v) == [i for i, x in enumerate(values) if x == v]
    with pytest.raises(IndexError):
        matrix.access(3000)


def test_file_round_trip():
    values = np.array([5, 0, 49_407, 2, 2], np.uint32)
    ids, lengths, matrix = wavelet.unpack(wavelet.pack([3, 9], [4, 1], values))
    assert ids.tolist() == [3, 9] and lengths.tolist() == [4, 1] and matrix.values().tolist() == values.tolist()
    with pytest.raises(ValueError):
        wavelet.unpack(b"none of ours")


def test_parts_encode_like_whole_texts():
    from tokenizers import Tokenizer

    path = wavelet.default_tokenizer()
    tokenizer, encoder, rng = Tokenizer.from_file(path), wavelet.WordEncoder(path), random.Random(8)
    texts = ["it's. don't,x a.b. 'S. ...", "~ ~~ a~b", "é. Ü, ß.\n", "1. 2, 3.4", "a　b.", "<|endoftext|> a.", "x\x0bz.\x0c y.\r\n", "ª. º,", "日本, 語.", ""]
    signs = list("ab é.,!?;:'\n\t1~|<>#-_ÀÿSs") + ["ing", "The", "'t ", "💥"]
    texts += ["".join(rng.choices(signs, k=rng.randrange(1, 60))) for _ in range(400)]
    assert encoder.by_parts
    got = encoder.encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(wavelet, "CACHED_WORDS", 3)
    encoder, path = wavelet.WordEncoder(wavelet.default_tokenizer()), wavelet.default_tokenizer()
    plain = wavelet.WordEncoder(path)
    for words in ("a b c d e", "f g a", "b z y x w v", "a b c", "e e e"):
        assert encoder.encode([words]) == [b"".join(plain.encode([w])[0] for w in words.split())]


def test_another_tokenizer_gets_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models

    path, own = tmp_path / "other.json", Tokenizer(models.BPE({"a": 0, "b": 1, " ": 2, "b a": 3, "b ": 4}, [("b", " "), ("b ", "a")]))
    own.save(str(path))
    encoder = wavelet.WordEncoder(str(path))
    assert not encoder.by_parts
    assert np.frombuffer(encoder.encode(["ab ab"])[0], "<u4").tolist() == own.encode("ab ab").ids == [0, 3, 1]


def test_units_are_inflated_when_asked_for(monkeypatch):
    monkeypatch.setattr(wavelet, "UNIT", 128)
    values = np.repeat(np.arange(40, dtype=np.uint32), 300)
    matrix = wavelet.unpack(wavelet.pack([1], [len(values)], values))[2]
    packed = sum(isinstance(u, bytes) for p in matrix.planes for u in p.units)
    assert packed > 20 and matrix.access(5_000) == values[5_000]
    assert sum(isinstance(u, bytes) for p in matrix.planes for u in p.units) >= packed - len(matrix.planes)
    assert matrix.selects(7, np.array([0, 5, 299])).tolist() == [2100, 2105, 2399] and matrix.ranks(7, [0, 2101, 9999]).tolist() == [0, 1, 300]
    assert matrix.values().tolist() == values.tolist()


def test_query_equals_direct_encoding(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 40)
    monkeypatch.setattr(wavelet, "RANGE_DOCS", 5)
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(["alpha", "Beta,", "gamma.", "δ", "5"], k=rng.randrange(0, 30)))) for i in range(30)]
    docs += [(40, None), (None, "no id"), (7, "again"), (41, "long " * 500)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], SCHEMA)
    folder = new_path(spark, "test-shards")
    manifest = wavelet.write_shards(frame, folder)
    got = sorted(map(tuple, wavelet.read_shards(manifest, folder).collect()), key=lambda r: r[1])
    assert got == direct(wavelet.default_tokenizer(), docs)
    assert manifest.count() > 5


def test_empty_table(spark):
    folder = new_path(spark, "test-empty")
    assert wavelet.read_shards(wavelet.write_shards(spark.createDataFrame([], SCHEMA), folder), folder).count() == 0
