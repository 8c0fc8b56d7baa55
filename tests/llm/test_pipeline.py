from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as C
from graphloom.llm.encode import encoder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_the_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"lang_pred": F.lit("x"), "score": F.lit(1), "c1": F.lit(2)})
    n = docs.count()
    for name, stage in C.STAGES[:-1]:
        after = C.staged(stage(spark, docs, sf), name)
        assert after.columns == docs.columns
        if name != "mixing":
            assert 0.5 * n <= after.count() <= docs.count() and after.join(docs, docs.columns, "left_anti").count() == 0
        docs = after
    got = C.STAGES[-1][1](spark, docs, sf).toPandas().sort_values("start")
    assert (got["start"].to_numpy() == np.concatenate(([0], np.cumsum(got["n_tokens"])[:-1]))).all()
    tok = encoder(str(public_tokenizers.path("word_bpe_49k.json"))).tokenizer
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(got["doc_id"]) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    for i, crc in list(zip(got["doc_id"], got["ids_crc32"], strict=True))[:40]:
        assert zlib.crc32(np.array([*tok.encode(texts[i], add_special_tokens=False).ids, 2], "<u4").tobytes()) == crc


def test_columns_of_any_name_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({n: F.lit(i) for i, n in enumerate(["_copies", "_copy", "copies", "copy", "p", "rate", "n_tokens", "h", "item", "component"])})
    for _, stage in C.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and after.where("_copy <> 1 OR copies <> 2 OR component <> 9").count() == 0


def test_stages_on_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the words of a text", None, None, 5), (3, "the words of a text and more of it", "en", "s", 9), (3, "the words of a text and more of it", "en", "s", 9), (4, "THE words of a text and more of it", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = C.language_id(spark, docs, sf)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "3", "4", "None"]
    assert {r["lang"] for r in kept.collect()} == {"en"}
    assert sorted(str(r["doc_id"]) for r in C.near_dedup(spark, kept, sf).collect()) == ["3", "3", "None"]
    empty = docs.limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, sf).count() == 0
