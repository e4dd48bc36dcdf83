import json

import pytest
from pyspark.sql import functions as F

from weirgate.operators import log_analytics as A
from weirgate.sources import exports
from weirgate.sources import rule_store as S
from weirgate.sources import rules as R
from weirgate.sources.tables import read, threat_logs, violations
from weirgate.streaming import rollup

SF = "/root/testdata/sf0.001"
AT = "2024-01-01 00:00:00"


def test_rule_store(spark, tmp_path):
    store = S.RuleStore(spark, str(tmp_path / "rules"))
    assert store.rules() == [] and store.seed(R.seed_rules(), "root", AT) == {"inserted": 24, "updated": 0, "unchanged": 0}
    assert store.seed(R.seed_rules(), "root", AT)["unchanged"] == 24
    first = R.rules_fingerprint(store.frame()).first()[0]
    store.update("RULE_JAILBREAK_03", {"description": "other"}, "root", AT)
    assert R.rules_fingerprint(store.frame()).first()[0] == first
    store.update("RULE_JAILBREAK_03", {"pattern": "other words"}, "root", AT)
    store.update("RULE_JAILBREAK_03", {"pattern": "other words"}, "root", AT)
    assert R.rules_fingerprint(store.frame()).first()[0] != first
    store.create(R.Rule("NEW", "KEYWORD", "PII", "LOW", "x"), "root", AT)
    for bad in (lambda: store.create(R.Rule("NEW", "KEYWORD", "PII", "LOW", "x"), "root", AT), lambda: store.update("NEW", {"rule_id": "y"}, "root", AT), lambda: store.update("NEW", {"severity": "?"}, "root", AT), lambda: store.delete("none", "root", AT)):
        with pytest.raises(S.RuleError):
            bad()
    store.delete("NEW", "root", AT)
    assert store.add_deny_phrase("Bad words", "root", AT).rule_id == "RULE_DENY_01"
    with pytest.raises(S.RuleError):
        store.add_deny_phrase("bad WORDS", "root", AT)
    store.save_settings({"firewall_enabled": True}, {"firewall_enabled": False}, str(tmp_path / "runtime.json"), "root", AT)
    assert json.load(open(tmp_path / "runtime.json")) == {"firewall_enabled": False}
    audit = store.audit()
    counts = {r.action: r["count"] for r in audit.groupBy("action").count().collect()}
    assert counts == {"RULE_CREATED": 26, "RULE_UPDATED": 2, "RULE_DELETED": 1, "THRESHOLD_CHANGED": 1}
    assert S.latest_master_change(audit).select(S.audit_message(F.col("action"), F.col("target_rule_id"), F.col("change_details")).alias("m")).first().m == "Firewall switched off"
    diff = S.seed_difference(store.frame(), R.rules_frame(spark, R.seed_rules())).groupBy("state").count().collect()
    assert {r.state: r["count"] for r in diff} == {"unchanged": 23, "updated": 1}


def test_load_rules(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"rules": [{"rule_id": "A", "rule_type": "REGEX", "category": "PII", "pattern": "x", "severity": "LOW"}]}))
    assert R.load_rules(str(tmp_path / "a.json"))[0].is_active
    with pytest.raises(ValueError):
        R.load_rules(str(tmp_path / "a.json"), str(tmp_path / "a.json"))


def test_log_sink_retention_and_csv(spark, tmp_path):
    log = threat_logs(read(spark, SF, "events")).drop("kind")
    odd = log.limit(1).withColumns({"action_taken": F.lit("LOST"), "request_id": F.lit("odd")})
    path = str(tmp_path / "log")
    exports.write_logs(log.union(odd), path)
    back = spark.read.parquet(path)
    assert back.count() == log.count() and spark.read.parquet(f"{path}_quarantine").first().violated == ["action_taken"]
    assert violations(log).count() == 0
    assert S.delete_before(spark, path, "2024-01-10") == 9
    assert spark.read.parquet(path).agg(F.min("created_at")).first()[0].day == 10
    rows = spark.createDataFrame([("=1+1", [1], None), ("ok", [], "-x")], "`=a` string, b array<int>, c string")
    exports.write_csv(rows, str(tmp_path / "csv"))
    got = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"')
    assert all(f.read_bytes().startswith(b"\xef\xbb\xbf") for f in (tmp_path / "csv").glob("*.csv"))
    assert got.columns == ["'=a", "b", "c"] and sorted(r[0] for r in got.collect()) == ["'=1+1", "ok"]


def test_stream_equals_batch_and_is_kept(spark, tmp_path):
    events = read(spark, SF, "events")
    log = threat_logs(events)
    want = sorted(map(tuple, A.hourly_rollup(log).collect()))
    assert sorted(map(tuple, rollup.stream_rollup(spark, f"{SF}/events.parquet").collect())) == want
    source, kept = tmp_path / "in", str(tmp_path / "rollup")
    for part in (events.where("ts < timestamp_ntz'2024-01-15 12:30:00'"), events.where("ts >= timestamp_ntz'2024-01-15 12:30:00'")):
        part.coalesce(1).write.mode("append").parquet(str(source))
        stream = threat_logs(spark.readStream.schema(events.schema).parquet(str(source)))
        rollup.keep_rollup(stream, kept, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(kept).drop("day").select(A.hourly_rollup(log).columns)
    assert sorted(map(tuple, got.collect())) == want


def test_rules_follow_the_stream(spark, tmp_path):
    store = S.RuleStore(spark, str(tmp_path / "rules"))
    store.seed(R.seed_rules()[:3], "root", AT)
    spark.range(3).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    rollup.score_stream(stream, store.frame, lambda rows, rules: rows.withColumn("n", F.lit(len(rules))), lambda df: seen.extend(r.n for r in df.collect()), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [3, 3, 3]


def test_kpi_mix(spark):
    row = "created_at timestamp_ntz, is_blocked boolean, execution_time_ms double, layer_details string"
    rows = [(None, False, 1.0, "{}")] * 4 + [(None, True, 1.0, "{}")] * 3 + [(None, False, 1.0, '{"firewall_master":"OFF"}')] * 3
    k = A.kpis(spark.createDataFrame(rows, row)).first()
    assert (k.total, k.blocked, k.bypassed, k.safe) == (10, 3, 3, 4) and k.block_rate == round(3 / 7, 6)
    assert abs(A.kpis(spark.range(1, 101).selectExpr("timestamp_ntz'2024-01-01' created_at", "false is_blocked", "cast(id as double) execution_time_ms", "'{}' layer_details"), exact=False).first().p95_latency_ms - 95) <= 1
    empty = A.kpis(spark.createDataFrame([], row)).first()
    assert empty.total == 0 and empty.block_rate == 0 and empty.p95_latency_ms == 0


def test_union_of_columns_in_first_seen_order(spark):
    out = exports.with_all_columns([spark.range(1).selectExpr("1 b", "2 a"), spark.range(1).selectExpr("3 c", "4 a")])
    assert out.columns == ["b", "a", "c"] and sorted(map(str, map(tuple, out.collect()))) == ["(1, 2, None)", "(None, 4, 3)"]


def test_bad_rows_go_without_those_that_share_their_id(spark, tmp_path):
    log = threat_logs(read(spark, SF, "events")).drop("kind").limit(1)
    exports.write_logs(log.union(log.withColumn("action_taken", F.lit("LOST"))), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1 == spark.read.parquet(str(tmp_path / "log_quarantine")).count()


def test_demo_reset_and_retention_keep_the_rollup(spark, tmp_path):
    from weirgate.sources.demo import demo_logs

    path, kept = str(tmp_path / "log"), str(tmp_path / "rollup")
    log = threat_logs(read(spark, SF, "events")).drop("kind")
    demo = demo_logs(spark, 200, 5, "2024-01-12").drop("kind").withColumn("application_id", F.lit("demo"))
    exports.write_logs(log.unionByName(demo), path)
    exports.write_rollup(A.hourly_rollup(spark.read.parquet(path)), kept)
    assert S.reset_demo(spark, path, kept, F.col("application_id") == "demo", str(tmp_path / "scratch")) == 200
    assert S.reset_demo(spark, path, kept, F.col("application_id") == "demo", str(tmp_path / "scratch")) == 0
    left = spark.read.parquet(path)
    assert sorted(r.request_id for r in left.collect()) == sorted(r.request_id for r in log.collect())
    counts = lambda df: sorted((r.bucket_start, r.total_requests) for r in df.collect())
    want = counts(A.hourly_rollup(log))
    assert counts(spark.read.parquet(kept)) == want
    assert S.retire(spark, path, kept, "2024-01-10") == 9
    assert counts(spark.read.parquet(kept)) == want and spark.read.parquet(path).agg(F.min("created_at")).first()[0].day == 10


def test_each_request_of_a_stream_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:10:00")], "request_id string, created_at string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rollup.unique_requests(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("unique_requests").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.request_id for r in spark.table("unique_requests").collect()) == ["a", "b"]


def test_pages_snap_and_points_have_aliases(spark):
    from weirgate.functions import format as N

    log = threat_logs(read(spark, SF, "events"))
    rows, page, pages = A.search_snapped(log, A.LogFilters(), 10**6, 200)
    assert page == pages == -(-log.count() // 200) and rows.count() == log.count() - 200 * (pages - 1)
    assert A.search_snapped(log, A.LogFilters(client_ip="none"), 7)[1:] == (1, 1)
    df = spark.createDataFrame([(None, 2), (1, 3)], "time int, bucket_start int")
    assert [r[0] for r in df.select(N.first_of(df.columns, "time", "bucket_start", "x")).collect()] == [2, 1]


def test_config_follows_its_files(tmp_path):
    from weirgate.operators import cascade as C
    from weirgate.operators.scoring import positive

    path, overlay = tmp_path / "c.json", tmp_path / "o.json"
    config = C.ConfigFile(str(path), str(overlay))
    assert config.current() == C.CascadeConfig()
    path.write_text(json.dumps({"layer_2": {"high_confidence_threshold": 0.9}}))
    assert config.current().high == 0.9
    overlay.write_text(json.dumps({"output_scanner": {"on_detect": "block"}}))
    assert (config.current().high, config.current().on_detect) == (0.9, "block")
    for bad in ("{nope", "[1]", '{"layer_2": {"high_confidence_threshold": 7.0}}'):
        path.write_text(bad)
        assert (config.current().high, config.current().on_detect) == (0.9, "block")
    path.write_text("{}")
    overlay.unlink()
    assert config.current() == C.CascadeConfig()
    assert [positive(x, 5.0) for x in (2, 0.5, 0, -1, float("inf"), float("nan"), True, "3", None)] == [2.0, 0.5] + [5.0] * 7
