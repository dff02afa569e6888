"""The pipeline as a whole on a small table with planted cases."""

import random

import corpus_pipeline
from tracemill.llm import packing

LINE = "This very common line is longer than forty characters."
rng = random.Random(11)
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose():
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(120))


def write(spark, path, texts):
    rows = [(k, x, "en", None if x is None else f"s{k}", len(x or "")) for k, x in texts.items()]
    spark.createDataFrame(rows, KIND).write.parquet(f"{path}/documents.parquet")


def test_pipeline(spark, tmp_path):
    own = {k: prose() for k in range(6)}
    texts = {k: f"{x}\n{LINE}" for k, x in own.items()}
    texts |= {10: own[0].rsplit(" ", 1)[0] + " changed", 11: own[1], 12: "too short", 13: "", 14: None, 15: "same words over and over again " * 30}
    write(spark, tmp_path, texts)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Short, empty and repetitive texts go, then the common line but in its last document, then copies.
    want = own | {5: texts[5]}
    encode = packing.encoder(packing.vocabulary_path(packing.VOCABULARY))
    assert {r.doc_id: r.length for r in rows} == {k: len(encode(x)) // 4 + 1 for k, x in want.items()}
    assert len(rows) == 6 and all(r.piece == 0 for r in rows)


def test_null_and_repeated_doc_ids(spark, tmp_path):
    own = [prose() for _ in range(6)]
    rows = [(None, own[0]), (None, ""), (None, None), (None, own[1]), (3, own[2]), (3, "too short"), (3, own[3]), (4, own[4]), (4, own[4]), (5, own[5])]
    docs = spark.createDataFrame([(k, x, "en", f"s{j % 2}" if x and len(x) > 20 else f"bad{j}", len(x or "")) for j, (k, x) in enumerate(rows)], KIND)
    good = [(k, x) for k, x in rows if x and len(x) > 20]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.quality_stage(spark, docs, "").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, good))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encode = packing.encoder(packing.vocabulary_path(packing.VOCABULARY))
    assert sorted(repr((r.doc_id, r.length)) for r in packed) == sorted(repr((k, len(encode(x)) // 4 + 1)) for k, x in set(good))


def test_near_stage_by_row(spark):
    own = [prose() for _ in range(6)]
    copy = own[0].rsplit(" ", 1)[0] + " changed"
    rows = [(1, own[0]), (None, own[1]), (None, own[2]), (None, copy), (5, own[3]), (5, copy), (5, own[4]), (7, own[5]), (7, own[5]), (None, own[5]), (8, ""), (9, ""), (9, "")]
    docs = spark.createDataFrame([(k, x, "en", "s", len(x)) for k, x in rows], KIND)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, docs, "").collect()]
    want = [(1, own[0]), (None, own[1]), (None, own[2]), (5, own[3]), (5, own[4]), (7, own[5]), (8, ""), (9, "")]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_empty(spark, tmp_path):
    write(spark, tmp_path, {})
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
