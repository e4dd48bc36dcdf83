"""Table reads, the schemas and domains of the log tables, and the threat log derived from `events`."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas and domains of the four tables.
THREAT_LOGS = (
    "request_id string, client_ip string, application_id string, target_model string, raw_prompt string, system_instruction string, "
    "action_taken string, triggered_layer string, created_at timestamp, is_blocked boolean, output_flagged boolean, risk_score double, "
    "execution_time_ms double, layer_details string, detected_patterns array<string>, output_completion string"
)
FIREWALL_RULES = "rule_id string, rule_type string, category string, pattern string, description string, severity string, is_active boolean"
SYSTEM_METRICS = (
    "bucket_start timestamp, total_requests bigint, blocked_requests bigint, layer_1_blocks bigint, layer_2_blocks bigint, "
    "layer_3_blocks bigint, output_blocks bigint, avg_latency_ms double, p95_latency_ms double"
)
AUDIT_LOGS = "timestamp timestamp, admin_user string, action string, target_rule_id string, change_details string"
DOMAINS = {
    "action_taken": ("PASSED", "BLOCKED", "REDACTED"),
    "triggered_layer": ("NONE", "LAYER_1", "LAYER_2", "LAYER_3", "OUTPUT_SCANNER"),
    "rule_type": ("REGEX", "KEYWORD", "EXCLUSION"),
    "category": ("JAILBREAK", "PROMPT_LEAK", "PII", "SYSTEM_OVERRIDE"),
    "severity": ("LOW", "MEDIUM", "HIGH", "CRITICAL"),
    "action": ("RULE_CREATED", "RULE_UPDATED", "RULE_DELETED", "THRESHOLD_CHANGED"),
}
#: The kinds of demo traffic with their weights in thousandths (action, layer, blocked, flagged).
WEIGHTS = (
    ("pass_l2", 810, "PASSED", "NONE", False, False),
    ("pass_l3", 60, "PASSED", "LAYER_3", False, False),
    ("pass_flagged", 10, "PASSED", "NONE", False, True),
    ("redact_l3", 10, "REDACTED", "LAYER_3", False, False),
    ("redact_out", 10, "REDACTED", "OUTPUT_SCANNER", False, True),
    ("block_l1", 45, "BLOCKED", "LAYER_1", True, False),
    ("block_l2", 25, "BLOCKED", "LAYER_2", True, False),
    ("block_l3", 20, "BLOCKED", "LAYER_3", True, False),
    ("block_out", 10, "BLOCKED", "OUTPUT_SCANNER", True, True),
)
#: The same by the upper bound of k, which runs through the thousandths.
KINDS = tuple((row[0], upto, *row[2:]) for row, upto in zip(WEIGHTS, accumulate(w for _, w, *_ in WEIGHTS), strict=True))
DEMO_RULES = (
    "RULE_SYSTEM_OVERRIDE_01", "RULE_SYSTEM_OVERRIDE_02", "RULE_SYSTEM_OVERRIDE_03", "RULE_JAILBREAK_01", "RULE_JAILBREAK_02", "RULE_PROMPT_LEAK_01", "RULE_PROMPT_LEAK_02",
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _by_kind(kind: Column, field: int) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for row in KINDS:
        out = out.when(kind == row[0], F.lit(row[field]))
    return out


def _details(kind: Column) -> Column:
    """The JSON document of each layer's outcome, nulls included."""
    l1_hit = kind == "block_l1"
    to_l3 = kind.isin("pass_l3", "redact_l3", "block_l3")
    layer_1 = F.struct(
        l1_hit.alias("matched"), F.when(l1_hit, F.get("detected_patterns", F.lit(0))).alias("rule_id"), F.when(l1_hit, F.lit("JAILBREAK")).alias("category"),
        F.when(l1_hit, F.lit("HIGH")).alias("severity"), F.lit(0.4).alias("time_ms"),
    )
    layer_2 = F.struct(
        F.lit("ok").alias("status"), F.round("risk_score", 4).alias("score"), F.lit(24.0).alias("time_ms"), F.lit(0).alias("context_turns"),
        F.when(kind == "block_l2", "BLOCK").when(to_l3, "ESCALATE").otherwise("PASS").alias("decision"),
    )
    layer_3 = F.when(to_l3, F.struct(
        F.lit("ok").alias("status"), F.when(kind == "block_l3", "BLOCK").when(kind == "redact_l3", "REDACT").otherwise("ALLOW").alias("decision"),
        F.lit(1200.0).alias("time_ms"), F.lit(False).alias("degraded"), F.lit("").alias("rationale"),
    ))
    flagged = F.col("output_flagged")
    scanner = F.when(flagged, F.struct(
        F.when(kind == "block_out", "BLOCK").when(kind == "redact_out", "REDACT").otherwise("WARN").alias("action"), F.array(F.lit("PII_LEAK")).alias("categories")))
    whole = F.to_json(F.struct(layer_1.alias("layer_1"), F.when(~l1_hit, layer_2).alias("layer_2"), layer_3.alias("layer_3"), scanner.alias("output_scanner")), {"ignoreNullFields": "false"})
    return F.when(kind == "bypass", '{"firewall_master":"OFF","bypassed":true}').otherwise(whole)


def threat_logs(events: DataFrame) -> DataFrame:
    """A deterministic threat log with the demo traffic's mixture, one row for each event."""
    k = F.pmod(F.col("event_id") * 37, F.lit(1000))
    kind = F.when((F.col("event_type") == "signup") & (k < 200), "bypass")
    for name, upto, *_ in KINDS:
        kind = kind.when(k < upto, name)
    named = events.select("event_id", "ts", "value", "event_type", kind.alias("kind"))
    kind, n = F.col("kind"), F.col("event_id")
    thousandths = (
        F.when(kind == "bypass", F.lit(0.0)).when(kind == "block_l1", F.lit(1000.0)).when(kind == "block_l2", (860 + n % 139).cast("double"))
        .when(kind.endswith("_l3"), (360 + n % 480).cast("double")).otherwise((n % 301).cast("double"))
    )
    rule = F.element_at(F.array(*map(F.lit, DEMO_RULES)), (n % len(DEMO_RULES) + 1).cast("int"))
    logs = named.select(
        F.concat(F.lit("req-"), n.cast("string")).alias("request_id"), F.concat(F.lit("203.0.113."), (n % 40 + 1).cast("string")).alias("client_ip"),
        F.col("event_type").alias("application_id"), F.col("ts").alias("created_at"), F.col("value").alias("execution_time_ms"),
        F.when(kind == "bypass", "PASSED").otherwise(_by_kind(kind, 2)).alias("action_taken"), F.when(kind == "bypass", "NONE").otherwise(_by_kind(kind, 3)).alias("triggered_layer"),
        F.coalesce(_by_kind(kind, 4), F.lit(False)).alias("is_blocked"), F.coalesce(_by_kind(kind, 5), F.lit(False)).alias("output_flagged"),
        (thousandths / 1000.0).alias("risk_score"), F.when(kind == "block_l1", F.array(rule)).otherwise(F.array().cast("array<string>")).alias("detected_patterns"),
        F.concat(F.lit("demo prompt "), n.cast("string"), F.lit(" 100%_of\\"), F.col("event_type")).alias("raw_prompt"), "kind",
    )
    return logs.withColumn("layer_details", _details(F.col("kind")))


def violated(columns: list[str], domains: dict[str, tuple[str, ...]] = DOMAINS) -> Column:
    """The names of the columns whose value is outside its domain."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(F.col(c).isin(*values), F.lit(False)), F.lit(c)) for c, values in domains.items() if c in columns)))


def violations(rows: DataFrame, columns: dict[str, tuple[str, ...]] = DOMAINS) -> DataFrame:
    """Rows outside a domain, with the names of the offending columns: the quarantine side of a write."""
    return rows.withColumn("violated", violated(rows.columns, columns)).where(F.size("violated") > 0)
