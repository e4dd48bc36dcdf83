import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weirgate.functions import format as N
from weirgate.operators import cascade, decision_log, scoring
from weirgate.operators import log_analytics as A
from weirgate.plans.cache import ttl_cache
from weirgate.sources.demo import demo_logs
from weirgate.sources.rules import seed_rules


def test_demo_logs(spark):
    df = demo_logs(spark, 4000, 14, "2024-03-15")
    rows = df.select("created_at", "action_taken", "request_id").toPandas()
    assert len(rows) == 4000 and rows.request_id.is_unique
    assert rows.created_at.min() >= pd.Timestamp("2024-03-01") and rows.created_at.max() < pd.Timestamp("2024-03-15")
    share = rows.action_taken.value_counts(normalize=True)
    assert abs(share["BLOCKED"] - 0.10) < 0.03 and abs(share["REDACTED"] - 0.02) < 0.015
    by_hour = rows.created_at.dt.hour.value_counts()
    assert by_hour[10] > 2 * by_hour[2]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, demo_logs(spark, 4000, 14, "2024-03-15").collect()), key=str)


def test_pandas_scorer_and_judge(spark):
    def load():
        return lambda texts: np.array([np.nan if t == "bad" else len(t) / 10 for t in texts])

    df = spark.createDataFrame([(1, "12345"), (2, "bad"), (3, "x" * 30), (4, None), (5, "1234"), (6, "123456")], "i int, prompt string").withColumn("judge_prompt", F.col("prompt"))

    def connect():
        def ask(q):
            if q == "1234":
                raise TimeoutError
            return '{"decision":"ALLOW"}' if q == "12345" else "?"

        return ask

    got = {r.i: r for r in cascade.run_cascade(df, seed_rules(), scoring.pandas_scorer(load), scoring.text_judge(connect)).collect()}
    assert {i: (r.action_taken, r.triggered_layer) for i, r in got.items()} == {
        1: ("PASSED", "LAYER_3"), 2: ("PASSED", "NONE"), 3: ("BLOCKED", "LAYER_2"), 4: ("PASSED", "NONE"), 5: ("BLOCKED", "LAYER_3"), 6: ("BLOCKED", "LAYER_3"),
    }
    assert got[2].verdict_status == "error"


def test_formats(spark):
    df = spark.createDataFrame([(1234.5, "1704067200"), (0.5, "1704067200000"), (float("nan"), "2024-01-01T00:00:00Z"), (None, "soon")], "x double, t string")
    rows = df.select(N.number(F.col("x")).alias("n"), N.rate(F.col("x")).alias("r"), N.latency(F.col("x")).alias("l"), N.point_time(F.col("t")).cast("string").alias("t")).collect()
    assert [r.n for r in rows] == ["1,234", "0", "—", "—"] or rows[0].n == "1,235"
    assert rows[1].r == "50.0%" and rows[0].l == "1.23 s" and rows[1].l == "0.5 ms" and rows[2].l == "—"
    assert [r.t for r in rows] == ["2024-01-01 00:00:00"] * 3 + [None]


def test_failures_bypass_and_details(spark):
    df = spark.createDataFrame([("a", True), ("b", False)], "request_id string, failed boolean").selectExpr("*", "'PASSED' action_taken", "'NONE' triggered_layer", "false is_blocked", "'{}' layer_details", "cast(null as double) risk_score", "cast(null as string) rule_id")
    closed = {r.request_id: r for r in decision_log.failure_entry(df, F.col("failed"), "pipeline").collect()}
    assert closed["a"].is_blocked and closed["a"].layer_details == '{"error":"pipeline_failure_fail_closed"}' and closed["b"].action_taken == "PASSED"
    assert not decision_log.failure_entry(df, F.col("failed"), "scanner", fail_open=True).where("is_blocked").count()
    row = decision_log.entry_from_result(df).first()
    assert row.risk_score == 0.0 and row.detected_patterns == []
    past = decision_log.bypass_entry(df, F.lit(502), F.lit("http")).select(A.bypassed().alias("b"), "layer_details").first()
    assert past.b and '"upstream_status":502' in past.layer_details
    one = F.struct(F.lit(None).cast("string").alias("rule_id"), F.lit(False).alias("matched"))
    got = df.select(decision_log.layer_details(one, F.lit(None).cast("struct<a:int>"), F.lit(None).cast("struct<a:int>"), F.lit(None).cast("struct<a:int>")).alias("d")).first().d
    assert got == '{"layer_1":{"rule_id":null,"matched":false}}'


def test_ttl_cache():
    now, calls = [0.0], []

    @ttl_cache(10, size=2, clock=lambda: now[0])
    def f(x):
        calls.append(x)
        if x < 0:
            raise ValueError
        return [x]

    f(1).append(9)
    assert f(1) == [1] and calls == [1]
    now[0] = 11
    assert f(1) == [1] and calls == [1, 1]
    f(2), f(3), f(1)
    assert calls == [1, 1, 2, 3, 1]
    for _ in range(2):
        try:
            f(-1)
        except ValueError:
            pass
    assert calls[-2:] == [-1, -1]
