import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weirgate.llm import language_id as L

SF = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF)
    got = {r.doc_id: r for r in L.language_id(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    held = [d for d, r in got.items() if r.held_out]
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_teach_nothing(spark):
    docs = spark.read.parquet(SF).withColumn("lang", F.when(L.is_held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert "xx" not in L.learn(docs).languages


def test_nulls_and_odd_texts(spark):
    docs = spark.read.parquet(SF).select("doc_id", "text", "lang")
    odd = [(None, "the thing", "en"), (-1, None, "en"), (-2, "", None), (-3, " 12 %% —", None), (-4, "É", None), (-5, "中", "zz"), (-6, "a" * 2_500_000, None)]
    got = {r.doc_id: r for r in L.language_id(docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))).where("doc_id is null or doc_id < 0").collect()}
    assert [got[d].lang_pred for d in (-1, -2, -3)] == ["und"] * 3 and got[-1].score == 0
    assert all(got[d].lang_pred != "und" for d in (None, -4, -5, -6))
    assert not got[None].held_out
    nothing = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert L.language_id(nothing).first().lang_pred == "und"
    assert L.language_id(nothing.limit(0)).collect() == []


def test_filter_has_no_false_negatives_and_ngrams_are_right():
    grams = pa.table({"lang": ["a", "b", "a"], "code": [7, 7, 9], "n": [5, 5, 5]})
    model = L.build(["a", "b"], grams)
    for code, langs in ((7, 3), (9, 1)):
        bits = 255
        for s in L.slots_of(np.array([code], np.uint32)):
            bits &= model.masks[0, s[0]]
        assert bits & langs == langs
    row, code = L.ngrams(pa.array(["Ab  c", None, "d"]))
    texts = [int(c).to_bytes(4, "big").decode() for c in code]
    assert list(zip(row.tolist(), texts)) == [(0, "   a"), (0, "  ab"), (0, " ab "), (0, "ab c"), (2, "   d")]
