"""The corpus pipeline against a brute-force version of its stages, and its contract."""

import random
import zlib

import corpus_pipeline
import numpy as np
import sentencepiece
from strandline.llm import common, secrets, sentencepiece_codec, toxicity

from .test_decontamination import brute as contained
from .test_similarity import brute_near
from .test_simhash import brute_fingerprint
from .test_toxicity import corpus

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    rng = random.Random(11)
    docs, labels = corpus(300, 8)
    items = [(i, " ".join(f"q{rng.randrange(500)}" for _ in range(rng.randrange(15, 40)))) for i in range(6)]
    docs += [(1000 + i, docs[3 * i][1]) for i in range(20)]  # copies
    docs += [(2000 + i, f"{docs[7 * i][1]} {items[i % 6][1]} {docs[5 * i][1]}") for i in range(12)]
    docs += [(3000 + i, f"{docs[4 * i][1]} password=abc{i}defgh end") for i in range(8)] + [(4000, None), (4001, ""), (4002, "\n")]
    rows = [(d, t, "en", f"src{d % 3}", None if t is None else len(t)) for d, t in docs]
    for name, kind, values in (("documents", DOCUMENTS, rows), ("labels", "doc_id long, quality int, toxic int", [(d, 1, t) for d, t in labels]), ("benchmark", "item_id long, text string", items)):
        spark.createDataFrame(values, kind).write.parquet(f"{folder}/{name}.parquet")
    return docs, items


def brute(spark, folder, docs, items):
    lexicon = toxicity.fit(common.table(spark, folder, "documents"), common.table(spark, folder, "labels"))
    docs = [(d, t) for d, t in docs if lexicon.scores(np.array([lexicon.features(t or "")]))[0] < corpus_pipeline.TOXIC_FROM]
    least = brute_near(dict(docs), lambda x, y: (brute_fingerprint(x) ^ brute_fingerprint(y)).bit_count() <= 2)
    docs = [(d, t) for d, t in docs if least[d] == d]
    docs = [(d, t) for d, t in docs if not contained([(d, t)], items)]
    own, out = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model()), {}
    for d, t in docs:
        base = secrets.base_spans(t or "")
        ids = own.encode(secrets.redact(t or "", base + secrets.random_spans(t or "", base)))
        out[d] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    return out


def test_equals_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    docs, items = tables(spark, folder)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == brute(spark, folder, docs, items)
    assert not set(got) & {2000 + i for i in range(12)} and len(got) > 150


def test_stages_keep_the_columns_and_bear_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    empty = spark.createDataFrame([], DOCUMENTS)
    full = common.table(spark, folder, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "secret_scans", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, full, folder).schema.names == full.schema.names


def test_one_row_of_each_class_stays(spark):
    rows = [(5, "same words in here"), (3, "same words in here"), (3, "same words in here"), (3, "quite another text than that"), (None, "same words in here"), (None, "no id at all"), (None, "no id at all"), (9, None), (8, "")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()), key=repr)
    assert got == sorted([(3, "same words in here"), (3, "quite another text than that"), (None, "no id at all"), (8, "")], key=repr)


def test_columns_of_any_name_pass_through(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    names = ["_id", "_key", "_row", "_hash", "_score", "score", "row", "id", "key", "at", "stay", "hash", "hit_id", "hit_hash", "fp", "n"]
    extra = ", ".join(f"{n} string" for n in names)
    rows = [(1, "some words of a text", *names), (1, "some words of a text", *names), (2, "others that stay here", *names)]
    frame = spark.createDataFrame(rows, f"doc_id long, text string, {extra}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, frame, folder)
        assert got.columns == frame.columns, name
        assert {tuple(r[n] for n in names) for r in got.collect()} == {tuple(names)}, name
