import json
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weirgate.operators import cascade as C
from weirgate.operators import log_analytics as A
from weirgate.operators import scoring
from weirgate.sources import rule_store as S
from weirgate.sources import rules as R
from weirgate.sources.snapshots import Conflict, SnapshotTable, VersionLog, remove_rows, retire_hours
from weirgate.sources.tables import read, threat_logs
from weirgate.streaming import rollup

SF = "/root/testdata/sf0.001"
AT = "2024-01-01 00:00:00"
COLUMNS = ("request_id", "created_at", "application_id", "triggered_layer", "is_blocked", "execution_time_ms")


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id string, at string, v int").withColumn("created_at", F.col("at").cast("timestamp_ntz")).drop("at")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_one_of_many_writers_publishes_a_version(spark, tmp_path):
    log, won = VersionLog(spark, f"{tmp_path}/v"), []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if log.publish(1, {"by": i}) else None) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and log.versions() == [1] and log.read(1) == {"by": won[0]}
    assert [p.name for p in (tmp_path / "v").iterdir() if not p.name.startswith(".")] == ["v-000000000001.json"]


def test_changes_of_a_table(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        t.read()
    assert t.append(rows(spark, ("a", "2024-01-01 00:10:00", 1), ("b", "2024-01-01 05:00:00", 2), ("n", None, 3)), ("job", 0))
    assert not t.append(rows(spark, ("x", "2024-01-01 00:10:00", 1)), ("job", 0)) and ids(t.read()) == ["a", "b", "n"]
    t.append(rows(spark, ("a", "2024-01-01 00:59:00", 9), ("c", "2024-01-01 00:20:00", 1), ("c", "2024-01-01 00:20:00", 1)), unique="id")
    assert ids(t.read()) == ["a", "b", "c", "n"] and ids(t.read(version=1)) == ["a", "b", "n"]
    assert ids(t.between("2024-01-01 00:15:00", "2024-01-01 05:00:00")) == ["c"]
    t.merge(rows(spark, ("a", "2024-01-01 00:10:00", 7), ("d", "2024-01-02 00:00:00", 8)), "id")
    assert sorted((r.id, r.v) for r in t.read().collect()) == [("a", 7), ("b", 2), ("c", 1), ("d", 8), ("n", 3)]
    assert t.delete_where(F.col("v") > 7) == 1 and t.delete_where(F.col("v") > 7) == 0 and ids(t.read()) == ["a", "b", "c", "n"]
    t.replace(rows(spark, ("z", "2024-01-01 00:00:00", 0)), ["2024-01-01-05"])
    assert ids(t.read()) == ["n", "z"]
    assert t.drop_before("2024-01-01 00:30:00") == 0 and t.drop_before("2024-01-01 01:00:00") == 1 and ids(t.read()) == ["n"]
    before = ids(t.read())
    assert t.vacuum() > 0 and ids(t.read()) == before and len(t.log.versions()) == 1 and t.vacuum() == 0
    t.delete_where(F.lit(True))
    assert t.read().count() == 0 and t.read().columns == ["id", "v", "created_at"]


def test_a_crash_at_any_step_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.append(rows(spark, ("a", "2024-01-01 00:10:00", 1), ("b", "2024-01-01 05:00:00", 2)))
    changes = [
        lambda: t.append(rows(spark, ("c", "2024-01-01 00:10:00", 1))), lambda: t.merge(rows(spark, ("a", "2024-01-01 00:10:00", 5)), "id"), lambda: t.replace(rows(spark, ("q", "2024-01-01 00:10:00", 5))),
        lambda: t.delete_where(F.col("id") == "a"), lambda: t.drop_before("2024-01-01 03:00:00"),
    ]
    for step in ("_write", "_commit"):
        for change in changes:
            with monkeypatch.context() as m:
                whole = getattr(SnapshotTable, step)
                m.setattr(SnapshotTable, step, (lambda self, *a: (whole(self, *a), 1 / 0)) if step == "_write" else (lambda self, *a: 1 / 0))
                if step == "_write" and change is changes[-1]:
                    continue  # writes no data
                with pytest.raises(ZeroDivisionError):
                    change()
            assert sorted((r.id, r.v) for r in t.read().collect()) == [("a", 1), ("b", 2)]
    with monkeypatch.context() as m:
        m.setattr("os.link", lambda *a: 1 / 0)
        for change in changes:
            with pytest.raises(ZeroDivisionError):
                change()
    assert ids(t.read()) == ["a", "b"] and t.vacuum() > 0 and ids(t.read()) == ["a", "b"]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    tables = [SnapshotTable(spark, str(tmp_path / "t")) for _ in range(3)]
    failed = []

    def work(i):
        try:
            for j in range(3):
                tables[i].append(rows(spark, (f"{i}-{j}", "2024-01-01 00:10:00", i)))
            tables[i].merge(rows(spark, (f"{i}-0", "2024-01-01 00:10:00", 100 + i)), "id")
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    got = {r.id: r.v for r in tables[0].read().collect()}
    assert got == {f"{i}-{j}": 100 + i if j == 0 else i for i in range(3) for j in range(3)}


def test_a_change_that_never_wins_is_a_conflict(spark, tmp_path, monkeypatch):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    monkeypatch.setattr(VersionLog, "publish", lambda *a: False)
    monkeypatch.setattr("weirgate.sources.snapshots.TRIES", 3)
    with pytest.raises(Conflict):
        t.drop_before("2024-01-01 00:00:00")


def test_two_writers_of_rules_lose_no_change(spark, tmp_path):
    stores = [S.RuleStore(spark, str(tmp_path / "rules")) for _ in range(4)]
    stores[0].seed(R.seed_rules(), "root", AT)
    refused = []

    def work(i):
        for j in range(4):
            stores[i].create(R.Rule(f"W{i}_{j}", "KEYWORD", "PII", "LOW", "x"), f"u{i}", AT)
        try:
            stores[i].create(R.Rule("SAME", "KEYWORD", "PII", "LOW", "x"), f"u{i}", AT)
        except S.RuleError:
            refused.append(i)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert {r.rule_id for r in stores[0].rules()} == {r.rule_id for r in R.seed_rules()} | {f"W{i}_{j}" for i in range(4) for j in range(4)} | {"SAME"} and len(refused) == 3
    audit = stores[1].audit()
    assert audit.count() == 24 + 17 and audit.where("admin_user = 'u2'").count() in (4, 5)
    assert json.loads(audit.where("target_rule_id = 'W1_1'").first().change_details)["after"]["pattern"] == "x"


def test_retention_by_hour_and_removal_after_a_crash(spark, tmp_path, monkeypatch):
    log, hours = SnapshotTable(spark, str(tmp_path / "log")), SnapshotTable(spark, str(tmp_path / "rollup"), "bucket_start", "day")
    events = threat_logs(read(spark, SF, "events")).select(*COLUMNS).withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).where("created_at < timestamp_ntz'2024-01-04 00:00:00'")
    demo = events.limit(30).withColumn("application_id", F.lit("demo"))
    log.append(events.unionByName(demo))
    hours.replace(A.hourly_rollup(log.read()))
    rollup_of = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = rollup_of(A.hourly_rollup(events))
    assert rollup_of(hours.read()) != want
    with monkeypatch.context() as m:  # the log is changed, the rollup not yet
        m.setattr(SnapshotTable, "replace", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            remove_rows(log, hours, F.col("application_id") == "demo", A.hourly_rollup)
    assert log.manifest()["pending"] and log.read().count() == events.count()
    assert remove_rows(log, hours, F.col("application_id") == "demo", A.hourly_rollup) == 0
    assert rollup_of(hours.read()) == want and not log.manifest()["pending"]
    first = events.agg(F.min("created_at")).first()[0]
    assert retire_hours(log, hours, "2024-01-02 07:45:00", A.hourly_rollup) > 0
    assert log.read().agg(F.min("created_at")).first()[0] >= pd.Timestamp("2024-01-02 07:00:00") > first
    assert rollup_of(hours.read()) == want and retire_hours(log, hours, "2024-01-02 07:45:00", A.hourly_rollup) == 0


def run(query):
    query.trigger(availableNow=True).start().awaitTermination()


def test_a_replayed_batch_and_a_failing_log(spark, tmp_path, monkeypatch):
    """A crash between the sink and the stream's own commit; repeated requests; a log that cannot be written."""
    source = tmp_path / "in"
    rows(spark, *((f"r{i % 9}", f"2024-01-01 00:{i:02d}:00", i) for i in range(12))).withColumnRenamed("id", "request_id").coalesce(1).write.parquet(str(source))
    store = S.RuleStore(spark, str(tmp_path / "rules"))
    store.seed(R.seed_rules()[:2], "root", AT)
    answers, log = SnapshotTable(spark, str(tmp_path / "answers")), SnapshotTable(spark, str(tmp_path / "log"))
    stream = lambda: spark.readStream.schema("request_id string, v int, created_at timestamp_ntz").parquet(str(source))
    path = tmp_path / "config.json"
    path.write_text(json.dumps({"layer_2": {"high_confidence_threshold": 0.9}}))
    config = C.ConfigFile(str(path))
    handle = lambda df, rules, config: df.withColumns({"n": F.lit(len(rules)), "high": F.lit(config.high)})
    start = lambda: rollup.score_stream(stream(), store.frame, handle, answers, str(tmp_path / "cp"), config, log)
    whole = SnapshotTable.append

    def dies(self, *a, **k):
        whole(self, *a, **k)
        if self is answers:
            raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "append", dies)
        with pytest.raises(Exception, match="killed"):
            run(start())
    assert answers.read().count() == 12
    run(start())  # the batch comes again
    assert answers.read().count() == 12 and log.read().count() == 9 and answers.read().select("n", "high").distinct().collect() == [(2, 0.9)]
    rows(spark, ("r1", "2024-01-01 00:30:00", 50), ("new", "2024-01-01 02:00:00", 51)).withColumnRenamed("id", "request_id").coalesce(1).write.mode("append").parquet(str(source))
    path.write_text(json.dumps({"layer_2": {"high_confidence_threshold": 0.8}}))

    def fails(self, *a, **k):
        if self is log:
            raise OSError("disk full")
        return whole(self, *a, **k)

    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "append", fails)
        run(start())
    assert answers.read().count() == 14 and log.read().count() == 9 and answers.read().where("v = 51").first().high == 0.8


def test_stream_keeps_the_rollup_in_a_snapshot_table(spark, tmp_path):
    log = threat_logs(read(spark, SF, "events"))
    log.select(*COLUMNS).coalesce(1).write.parquet(str(tmp_path / "in"))
    kept = SnapshotTable(spark, str(tmp_path / "rollup"), "bucket_start", "day")
    stream = spark.readStream.schema(log.select(*COLUMNS).schema).parquet(str(tmp_path / "in"))
    run(rollup.keep_rollup(stream, kept, str(tmp_path / "cp"), exact=False))
    counts = lambda df: sorted((r.bucket_start, r.total_requests, r.blocked_requests) for r in df.collect())
    assert counts(kept.read()) == counts(A.hourly_rollup(log))
    total = A.merged_latency(kept.read(), []).first()
    assert total.total == log.count() and total.max_p95_ms >= total.p95_ms


def test_judges_that_are_slow_hang_or_fail(spark):
    def ask(q):
        if q == "hang":
            time.sleep(60)
        if q == "down":
            raise ConnectionError
        time.sleep(0.05)
        return q.upper()

    begin = time.monotonic()
    got = scoring.Calls(ask, at_once=8, timeout=0.6, retries=0).run([f"q{i}" for i in range(40)] + ["hang", "down", "last"])
    assert time.monotonic() - begin < 3 and got[:40] == [f"Q{i}" for i in range(40)] and got[42] == "LAST"
    assert isinstance(got[40], TimeoutError) and isinstance(got[41], ConnectionError)
    tries = []

    def flaky(q):
        tries.append(q)
        if len(tries) < 3:
            raise ConnectionError
        return "ok"

    assert scoring.Calls(flaky, retries=2).run(["a"]) == ["ok"] and len(tries) == 3
    begin = time.monotonic()
    assert scoring.Calls(lambda q: q, per_second=50, at_once=4).run(["x"] * 11) == ["x"] * 11 and time.monotonic() - begin >= 0.19
    dead = scoring.Calls(ask, at_once=2, timeout=0.1, lost_most=4).run(["hang"] * 50)
    assert all(isinstance(x, TimeoutError) for x in dead)
    assert scoring.Calls(ask).run([]) == []


def test_judge_keeps_the_order_of_rows(spark):
    def connect():
        def ask(q):
            if "hang" in q:
                time.sleep(60)
            time.sleep(0.03 if "7" in q else 0.0)
            return json.dumps({"decision": "ALLOW", "rationale": q})

        return ask

    df = spark.range(60).selectExpr("id", "case when id = 13 then 'hang' when id % 10 = 0 then null else concat('q', id) end judge_prompt").withColumn("undecided", F.col("judge_prompt").isNotNull()).coalesce(2)
    got = {r.id: r.verdict for r in scoring.text_judge(connect, timeout=0.5, retries=0)(df).collect()}
    assert got[13].rationale == "degraded: timeout" and got[13].decision == "BLOCK" and got[20].decision is None
    assert all(got[i].rationale == f"q{i}" for i in range(60) if i % 10 and i != 13)
