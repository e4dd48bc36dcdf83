import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weirgate.operators import cascade, scoring
from weirgate.sources.rules import seed_rules


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    """A protobuf field: an integer, or bytes, a text or a message with its length before it."""
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(data)) + data


def model_bytes(width):
    """An ONNX model whose output `logits` is its input `features`, float[n, width]."""
    shape = field(1, field(2, "n")) + field(1, field(1, width))
    value = lambda name: field(1, name) + field(2, field(1, field(1, 1) + field(2, shape)))
    node = field(1, "features") + field(2, "logits") + field(4, "Identity")
    graph = field(1, node) + field(2, "g") + field(11, value("features")) + field(12, value("logits"))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


def encode(width):
    def features(texts):
        if any("fail" in t for t in texts):
            raise ValueError("a text that the encoder does not take")
        told = np.array([[float(x) for x in t.split()[:width]] if t[:1] and t[0] in "-0123456789in" else [0.0] * width for t in texts], np.float32)
        return {"features": told.reshape(len(texts), width), "unknown_input": np.zeros(1)}

    return features


def scores(spark, tmp_path, width, texts):
    path = tmp_path / f"model{width}.onnx"
    path.write_bytes(model_bytes(width))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, prompt string").coalesce(1)
    return [r.score for r in scoring.onnx_scorer(str(path), encode(width))(df).orderBy("i").collect()]


def test_onnx_softmax_and_sigmoid(spark, tmp_path):
    two = scores(spark, tmp_path, 2, ["0 0", "0 3", "1000 -1000", "-1000 1000", "nan 1", "inf 0", None])
    assert np.allclose(two[:4], [0.5, 1 / (1 + np.exp(-3)), 0.0, 1.0]) and two[4] is None and two[5] is None and two[6] == 0.5
    one = scores(spark, tmp_path, 1, ["0", "2", "-1000", "1000", "inf", "nan"])
    assert np.allclose(one[:4], [0.5, 1 / (1 + np.exp(-2)), 0.0, 1.0]) and one[4:] == [None, None]


def test_a_text_that_fails_does_not_spoil_its_batch(spark, tmp_path):
    got = scores(spark, tmp_path, 2, ["0 0"] * 5 + ["fail"] + ["0 0"] * 6 + ["fail"])
    assert [i for i, s in enumerate(got) if s is None] == [5, 12] and set(got) == {0.5, None}


def test_bisection_asks_little_more_than_once():
    asked = []

    def model(texts):
        asked.append(len(texts))
        if "bad" in set(texts):
            raise ValueError
        return np.ones(len(texts))

    found = scoring.scored(model, pd.Series(["ok"] * 700 + ["bad"] + ["ok"] * 323))
    assert np.flatnonzero(np.isnan(found)).tolist() == [700] and len(asked) <= 21
    assert len(scoring.scored(model, pd.Series([], dtype=object))) == 0


def test_a_model_that_cannot_be_loaded_leaves_scores_null(spark, tmp_path):
    (tmp_path / "broken.onnx").write_bytes(b"no model")
    df = spark.createDataFrame([(1, "hello there"), (2, None)], "i int, prompt string")
    for path in ("broken.onnx", "absent.onnx"):
        assert {r.score for r in scoring.onnx_scorer(str(tmp_path / path), encode(2))(df).collect()} == {None}
    # Layer 1 decides as ever; what it leaves has no score, which is no reason to block it or to ask a judge.
    asks = spark.createDataFrame([(1, "what is the weather like")], "i int, prompt string").select("i", "prompt", F.array().cast("array<string>").alias("turns"))
    (row,) = cascade.run_cascade(asks, seed_rules(), scoring.onnx_scorer(str(tmp_path / "absent.onnx"), encode(2)), None).collect()
    assert row.action_taken == "PASSED"
