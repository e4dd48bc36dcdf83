"""One log row for each request: from the cascade and the scan, from failures, and past the switched-off firewall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Error codes and statuses of answers.
OUTCOMES = {
    "invalid_json": 400, "invalid_request": 400, "streaming_not_supported": 400, "blocked_input": 403, "blocked_output": 403, "pipeline_failure": 503, "scanner_failure": 503,
    "upstream_error": 502, "upstream_timeout": 504,
}
LAYER_KEYS = ("layer_1", "layer_2", "layer_3", "output_scanner")


def entry_from_result(rows: DataFrame) -> DataFrame:
    """Log columns with the defaults of a result: no risk is 0, no patterns are none."""
    patterns = F.when(F.col("rule_id").isNotNull(), F.array("rule_id")).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"risk_score": F.coalesce("risk_score", F.lit(0.0)), "detected_patterns": patterns})


def failure_entry(rows: DataFrame, failed: Column, stage: str, fail_open: bool = False) -> DataFrame:
    """Rows whose stage (pipeline or scanner) raised: passed if failing open, else blocked, and named so in the details."""
    mode = "open" if fail_open else "closed"
    details = F.to_json(F.struct(F.lit(f"{stage}_failure_fail_{mode}").alias("error")))
    layer = "OUTPUT_SCANNER" if stage == "scanner" and not fail_open else "NONE"
    new = {"action_taken": F.lit("PASSED" if fail_open else "BLOCKED"), "triggered_layer": F.lit(layer), "is_blocked": F.lit(not fail_open), "layer_details": details}
    return rows.withColumns({k: F.when(failed, v).otherwise(F.col(k)) for k, v in new.items()})


def bypass_entry(rows: DataFrame, upstream_status: Column, upstream_error: Column) -> DataFrame:
    """Rows that went past the firewall: always PASSED, with what the provider answered."""
    details = F.to_json(F.struct(F.lit("OFF").alias("firewall_master"), F.lit(True).alias("bypassed"), F.when(upstream_status >= 400, upstream_status).alias("upstream_status"), upstream_error.alias("upstream_error")))
    return rows.withColumns({
        "action_taken": F.lit("PASSED"), "triggered_layer": F.lit("NONE"), "is_blocked": F.lit(False), "output_flagged": F.lit(False), "risk_score": F.lit(0.0), "layer_details": details,
    })


def outcome(request_error: Column, failure: Column, is_blocked: Column, triggered_layer: Column, upstream_error: Column, upstream_status: Column, bypassed: Column, action: Column) -> Column:
    """struct(status_code, error_code, firewall_action): the answer's status, first cause first."""
    code = F.coalesce(
        request_error, F.when(~bypassed, failure), F.when(~bypassed & is_blocked & (triggered_layer != "OUTPUT_SCANNER"), "blocked_input"),
        F.when(upstream_error == "timeout", "upstream_timeout"), F.when(upstream_error.isNotNull(), "upstream_error"), F.when(~bypassed & is_blocked, "blocked_output"),
    )
    status = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in OUTCOMES.items() for x in pair)), F.coalesce(code, F.lit(""))), upstream_status, F.lit(200))
    return F.struct(status.alias("status_code"), code.alias("error_code"), F.when(bypassed, "BYPASSED").otherwise(action).alias("firewall_action"))


def layer_details(layer_1: Column, layer_2: Column, layer_3: Column, scanner: Column) -> Column:
    """The JSON document of the layers that ran; fields inside a layer are written even if null."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f'"{k}":'), F.to_json(c, {"ignoreNullFields": "false"}))) for k, c in zip(LAYER_KEYS, (layer_1, layer_2, layer_3, scanner), strict=True)]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def full_trace(logs: DataFrame) -> DataFrame:
    """(request_id, layer, state) by the details: BLOCKED, ESCALATED, CLEAR, SKIPPED (ran, said nothing) or NOT EXECUTED."""
    at = lambda path: F.get_json_object("layer_details", f"$.{path}")
    hit = {
        "layer_1": F.when(at("layer_1.matched") == "true", "BLOCKED").when(at("layer_1").isNotNull(), "CLEAR"),
        "layer_2": F.when(at("layer_2.decision") == "BLOCK", "BLOCKED").when(at("layer_2.decision") == "ESCALATE", "ESCALATED").when(at("layer_2.status") != "ok", "SKIPPED").when(at("layer_2").isNotNull(), "CLEAR"),
        "layer_3": F.when(at("layer_3.decision") == "BLOCK", "BLOCKED").when(at("layer_3.status") == "disabled", "SKIPPED").when(at("layer_3").isNotNull(), "CLEAR"),
        "output_scanner": F.when(at("output_scanner.action") == "BLOCK", "BLOCKED").when(F.col("output_flagged"), "ESCALATED").when(F.col("is_blocked"), "NOT EXECUTED").otherwise("CLEAR"),
    }
    steps = F.array(*(F.struct(F.lit(k).alias("layer"), F.coalesce(v, F.lit("NOT EXECUTED")).alias("state")) for k, v in hit.items()))
    return logs.select("request_id", F.explode(steps).alias("s")).select("request_id", "s.layer", "s.state")


def threat_estimate(distribution: DataFrame) -> DataFrame:
    """Threat kinds estimated from the blocked counts by layer, in whole rows: fixed shares of the rules' and the other layers' blocks."""
    total = lambda *layers: F.coalesce(F.sum(F.when(F.col("layer").isin(*layers), F.col("blocked"))), F.lit(0))
    sums = distribution.agg(total("LAYER_1").alias("l1"), total("LAYER_2").alias("l2"), total("LAYER_3").alias("l3"), total("OUTPUT_SCANNER").alias("out"))
    part = lambda c: F.floor(c + F.lit(1e-9)).cast("long")
    return sums.select(
        part(F.col("l1") * 0.6 + F.col("l2") * 0.4).alias("prompt_injection"), part(F.col("l1") * 0.4 + F.col("l2") * 0.2).alias("jailbreak"),
        part(F.col("l3") * 0.3).alias("system_override"), F.col("out").cast("long").alias("data_leak"),
    )
