"""The pipeline's stages, each held against plain Python on a small corpus."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(1)
    root = str(tmp_path_factory.mktemp("tables"))
    vocab = [f"{a}{b}{c}" for a in "bdklmn" for b in "aeio" for c in ["rt", "st", "n"]]
    docs, labels = [], []
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randint(40, 80))]
        good = i % 4 != 0
        docs.append((i, " ".join(w if good else [x.upper() + "!!" for x in w]), "en", f"s{i % 3}", 0))
        labels.append((i, int(good), 0))
    docs.append((200, docs[1][1], "en", "s0", 0))  # a copy
    docs.append((201, docs[2][1] + " benchmark words that nobody else would write in this very order today", "en", "s1", 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "Benchmark words that nobody else would write in this very order today")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, tables)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and np.mean([i % 4 != 0 for i in ids if i < 120]) > 0.95 and len(ids) > 80
    one = corpus_pipeline.near_duplicate_stage(spark, docs, tables)
    left = {r.doc_id for r in one.collect()}
    assert one.columns == docs.columns and 200 not in left and 1 in left
    clean = corpus_pipeline.decontamination_stage(spark, docs, tables)
    assert clean.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == {201}
    mixed = corpus_pipeline.mixing_stage(spark, docs, tables)
    assert mixed.columns == docs.columns
    assert corpus_pipeline.token_stage(spark, docs, tables).count() == docs.count()


def test_run(spark, tables):
    from kilnwork.llm.token_shards import default_tokenizer, encoder

    rows = sorted(corpus_pipeline.run(spark, tables).collect(), key=lambda r: r.start)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    at = 0
    for r in rows:
        ids = encoder(default_tokenizer()).tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows) and not {200, 201} & {r.doc_id for r in rows}


def test_empty_documents_go_through(spark, tables):
    none = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, tables).count() == 0


def test_rows_are_judged_one_by_one(spark, tables):
    """Null and repeated doc_ids: a row goes by its own text, and one row stays of each class."""
    rng = random.Random(5)
    text = [" ".join(f"u{rng.randint(0, 9999)}" for _ in range(40)) for _ in range(6)]
    leak = text[5] + " benchmark words that nobody else would write in this very order today"
    of = lambda *rows: spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    docs = of((None, leak), (None, text[0]), (1, leak), (1, text[1]), (2, text[2]), (2, text[2]))
    assert left(corpus_pipeline.decontamination_stage(spark, docs, tables)) == sorted([(None, text[0]), (1, text[1]), (2, text[2]), (2, text[2])], key=str)
    # 9 is a copy of 3's second text only, 4's rows differ, 5 is on two equal rows, 7's first row is a copy of 6
    docs = of((9, text[1]), (3, text[0]), (3, text[1]), (4, text[2]), (4, text[3]), (5, text[4]), (5, text[4]), (7, text[5]), (7, text[5] + " and much more of other words than the five that a shingle has in it"), (6, text[5]), (None, text[0]), (None, text[0]), (8, None), (8, ""))
    want = [(3, text[0]), (3, text[1]), (4, text[2]), (4, text[3]), (5, text[4]), (6, text[5]), docs.collect()[8][:2], (None, text[0]), (None, text[0]), (8, None), (8, "")]
    assert left(corpus_pipeline.near_duplicate_stage(spark, docs, tables)) == sorted(want, key=str)
