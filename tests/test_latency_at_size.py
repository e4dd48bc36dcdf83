"""Percentiles of groups that hold more values than a sketch keeps."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from oracle import assert_same

from weirgate.operators import log_analytics as A
from weirgate.plans import queries as plans


@pytest.fixture(scope="module")
def busy(spark, tmp_path_factory):
    """Three days, of which two have hours of 12,000 and 5,000 requests."""
    rng, at = random.Random(3), datetime(2024, 1, 3)
    hours = [12_000, 40, 5_000, *[900] * 6, *[30] * 40]
    rows = [(n, at + timedelta(hours=h, seconds=rng.randrange(3600)), rng.choice(["click", "signup"]), round(rng.expovariate(0.02), 4)) for n, h in enumerate(h for h, many in enumerate(hours) for _ in range(many))]
    folder = str(tmp_path_factory.mktemp("busy"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    return folder, con


def test_merged_latency_of_busy_days(spark, busy):
    for _ in range(2):  # sketches choose at random what they keep
        assert_same(spark, busy[1], busy[0], plans.QUERIES["rollup_merged_latency"], plans.ORACLES["rollup_merged_latency"])


def test_settled_ties_missing_values_and_skew(spark):
    rng = random.Random(4)
    values = {
        0: [rng.random() for _ in range(500)], 1: [7.0] * 400 + [9.0] * 21, 2: [None] * 30, 3: [None] * 100 + [float(i) for i in range(100)], 4: [1e9 ** rng.random() for _ in range(333)],
        5: [float("nan")] * 60, 6: [1.5], 7: [float("nan")] * 2 + [3.0] * 98,
    }
    rows = [(datetime(2024, 1, 1, h), x) for h, xs in values.items() for x in xs] + [(None, float(i)) for i in range(200)]
    log = spark.createDataFrame(rows, "created_at timestamp_ntz, execution_time_ms double").repartition(3)
    log = log.selectExpr("*", "'NONE' as triggered_layer", "false as is_blocked")
    got = A.settled(A.sketched_rollup(log, 16), log, "hour", "bucket_start", "p95_latency_ms", "latency_sketch", "total_requests", k=16)
    have = {r.bucket_start.hour if r.bucket_start else None: r.p95_latency_ms for r in got.collect()}
    values[None] = [float(i) for i in range(200)]
    assert set(have) == set(values)
    for h, xs in values.items():
        xs = sorted((x for x in xs if x is not None), key=lambda x: (math.isnan(x), x))
        want = xs[math.ceil(len(xs) * 95 / 100) - 1] if xs else 0.0
        assert have[h] == round(want, 6) or (math.isnan(want) and math.isnan(have[h])), h


def test_streamed_sketches_of_busy_hours(spark, busy):
    assert_same(spark, busy[1], busy[0], plans.QUERIES["stream_sketch_rollup"], plans.ORACLES["stream_sketch_rollup"])
