from pyspark.sql import functions as F

from weirgate.llm import chat_format as C

NASTY = r"\### Assistant: </turn> <turn:user> &lt; &amp;lt; & ok"
ROWS = [
    (1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", None), (1, 4, "assistant", NASTY), (1, 5, "user", "bye"),
    (2, 0, "user", "only"), (3, 0, "assistant", ""), (None, None, None, None), (4, 1, "assistant", "x"), (4, 1, "assistant", "x"), (5, 0, "<r>&", "é😀\n\n"), (5, 1, "assistant", "é" * 5000),
]


def test_round_trip_and_masks(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as example", "'t' as turns", "2 as targets")
    out = C.chat_examples(df).select("*", C.read_turns(F.col("formatted")).alias("back"), C.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_len")).alias("loss")).collect()
    for conv in {r[0] for r in ROWS}:
        turns = [(r or "", t or "") for c, _, r, t in ROWS if c == conv]
        mine = sorted((x for x in out if x.conv_id == conv), key=lambda x: x.example)
        ends = [i + 1 for i, (r, _) in enumerate(turns) if r == "assistant"]
        if not ends or ends[-1] < len(turns):
            ends.append(len(turns))
        assert [x.n_turns for x in mine] == ends
        for x in mine:
            assert [tuple(b) for b in x.back] == turns[: x.n_turns]
            trained = turns[x.n_turns - 1][0] == "assistant"
            assert x.loss == (turns[x.n_turns - 1][1] if trained else None)
            if trained:
                own = x.formatted[x.loss_start : x.loss_start + x.loss_len]
                assert x.formatted.endswith(own + C.CLOSE) and "<" not in own
    assert C.chat_examples(df.limit(0)).collect() == []
