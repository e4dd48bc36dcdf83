"""The input cascade: rules, then a score with two thresholds, then a judge for what lies between.

One pass over the rows. A column `undecided` tells a scorer or judge which rows the layers before it have
left to it, so that a costly one is called once for such a row and never for another.
"""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.functions.matching import first_match
from weirgate.functions.text import once
from weirgate.sources.rules import Rule, active_layer_1

LOG = logging.getLogger(__name__)

#: Fixed values of the verdict format.
VERDICTS = ("ALLOW", "BLOCK", "REDACT")
MAX_REPLY, MAX_RATIONALE = 10_000, 300
VERDICT = T.StructType().add("decision", T.StringType()).add("rationale", T.StringType()).add("sanitized_prompt", T.StringType())
DECISION = ("action_taken", "triggered_layer", "is_blocked", "risk_score", "rule_id", "verdict_status", "sanitized_prompt")

#: True where no layer before has decided.
UNDECIDED = "undecided"

#: A scorer or judge adds its columns to the rows it is given.
Scorer = Callable[[DataFrame], DataFrame]
Judge = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class CascadeConfig:
    firewall_enabled: bool = True
    layer_1_enabled: bool = True
    layer_2_enabled: bool = True
    layer_3_enabled: bool = True
    output_scanner_enabled: bool = True
    high: float = 0.85
    low: float = 0.30
    context_turns: int = 5
    context_chars: int = 2000
    on_detect: str = "redact"
    l1_exclude_categories: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if not 0 <= self.low <= self.high <= 1:
            raise ValueError("thresholds must satisfy 0 <= low <= high <= 1")
        if self.on_detect not in ("block", "redact", "warn"):
            raise ValueError("on_detect must be block, redact or warn")
        if self.context_turns < 0 or self.context_chars < 1:
            raise ValueError("context limits must be positive")

    #: What a runtime overlay may set.
    OVERLAY = {
        "pipeline": ("firewall_enabled", "layer_1_enabled", "layer_2_enabled", "layer_3_enabled", "output_scanner_enabled"),
        "layer_2": {"high_confidence_threshold": "high", "low_confidence_threshold": "low"},
        "output_scanner": ("on_detect",),
    }

    def overlaid(self, overlay: dict) -> CascadeConfig:
        """With the overlay's known keys; unknown ones are an error, so that a typo is not silently ignored."""
        changes = {}
        for section, values in overlay.items():
            known = self.OVERLAY.get(section)
            if known is None:
                raise ValueError(f"unknown section {section!r}")
            for key, value in values.items():
                if key not in known:
                    raise ValueError(f"unknown setting {section}.{key}")
                name = known[key] if isinstance(known, dict) else key
                if type(value) is not type(getattr(self, name)) and not (isinstance(value, int) and isinstance(getattr(self, name), float)) or isinstance(value, bool) != isinstance(getattr(self, name), bool):
                    raise ValueError(f"{section}.{key} has the wrong type")
                changes[name] = value
        return replace(self, **changes)


def load_config(path: str, overlay: str | None = None, base: CascadeConfig = CascadeConfig()) -> CascadeConfig:
    """The config of a JSON file and an optional overlay file."""
    for name in filter(None, (path, overlay)):
        with open(name, encoding="utf-8") as f:
            base = base.overlaid(json.load(f))
    return base


class ConfigFile:
    """A config that follows its files: read again when path, time or size of one changes; an invalid file is ignored."""

    def __init__(self, path: str, overlay: str | None = None, base: CascadeConfig = CascadeConfig()):
        self.path, self.overlay, self.base = path, overlay, base
        self._seen: tuple | None = None
        self._config = base

    def _signature(self) -> tuple:
        found = []
        for name in filter(None, (self.path, self.overlay)):
            try:
                stat = os.stat(name)
                found.append((name, stat.st_mtime_ns, stat.st_size))
            except OSError:
                found.append((name, None, None))
        return tuple(found)

    def current(self) -> CascadeConfig:
        now = self._signature()
        if now != self._seen:
            self._seen = now
            there = [name for name, at, _ in now if at is not None]
            try:
                self._config = load_config(there[0], there[1] if len(there) > 1 else None, self.base) if there else self.base
            except (OSError, ValueError, TypeError, AttributeError) as e:
                LOG.warning("config stays as it was: %s", e)
        return self._config


def evaluate_rules(rows: DataFrame, rules: list[Rule], prompt: str = "prompt", system: str | None = None) -> DataFrame:
    """rows with a struct column `layer_1`: the first matching rule, by rule_id, of the normalised prompt (and system text); null without one."""
    text = F.coalesce(F.col(prompt), F.lit(""))
    if system:
        text = F.concat(text, F.lit(" "), F.coalesce(F.col(system), F.lit("")))
    return rows.withColumn("layer_1", once(first_match(active_layer_1(rules), text)))


def threshold(score: Column, config: CascadeConfig) -> Column:
    return F.when(score >= config.high, "BLOCK").when(score <= config.low, "PASS").when(score.isNotNull(), "ESCALATE")


def run_cascade(rows: DataFrame, rules: list[Rule], scorer: Scorer | None, judge: Judge | None, config: CascadeConfig = CascadeConfig()) -> DataFrame:
    """rows (a column prompt) with the columns of DECISION, in one pass.

    scorer adds `score`, null where it cannot tell; judge adds `verdict`, a struct of VERDICT, null where
    it cannot tell, which blocks. Both see all rows, and only what they say of rows with `undecided` counts;
    the ones of `scoring` leave the others out.
    """
    none = F.lit(None).cast("string")
    if not config.firewall_enabled:
        risk, passed = F.lit(0.0), F.struct(F.lit("PASSED").alias("action"), F.lit("NONE").alias("layer"), F.lit("bypassed").alias("status"))
        return _with_decision(rows, rows.columns, passed, risk, none, none)
    made = evaluate_rules(rows, [r for r in rules if r.category not in config.l1_exclude_categories] if config.layer_1_enabled else [])
    undecided, said = F.col("layer_1").isNull(), lambda action, layer, status=None: F.struct(F.lit(action).alias("action"), F.lit(layer).alias("layer"), F.lit(status).cast("string").alias("status"))
    decision = F.when(~undecided, said("BLOCKED", "LAYER_1"))
    risk, cleaned = F.when(~undecided, F.lit(1.0)), none
    if not config.layer_2_enabled or scorer is None:
        decision, risk = decision.otherwise(said("PASSED", "NONE", "unavailable")), F.coalesce(risk, F.lit(0.0))
        return _with_decision(made, rows.columns, decision, risk, F.col("layer_1.rule_id"), cleaned)
    made = scorer(made.withColumn(UNDECIDED, undecided)).withColumn("score", once(F.col("score")))
    layer_2 = threshold(F.col("score"), config)
    decision = decision.when(layer_2.isNull(), said("PASSED", "NONE", "error")).when(layer_2 == "BLOCK", said("BLOCKED", "LAYER_2")).when(layer_2 == "PASS", said("PASSED", "NONE"))
    risk = F.coalesce(risk, F.col("score"), F.lit(0.0))
    if not config.layer_3_enabled or judge is None:
        decision = decision.otherwise(said("PASSED", "NONE", "disabled"))
    else:
        unsure = undecided & F.coalesce(layer_2 == "ESCALATE", F.lit(False))
        made = judge(made.withColumn(UNDECIDED, unsure)).withColumn("verdict", once(F.col("verdict")))
        verdict, cleaned = F.col("verdict.decision"), F.col("verdict.sanitized_prompt")
        decision = (
            decision.when(verdict.isNull(), said("BLOCKED", "LAYER_3", "degraded")).when(verdict == "ALLOW", said("PASSED", "LAYER_3", "ok"))
            .when((verdict == "REDACT") & (F.trim(F.coalesce(cleaned, F.lit(""))) != ""), said("REDACTED", "LAYER_3", "ok")).otherwise(said("BLOCKED", "LAYER_3", "ok"))
        )
    return _with_decision(made, rows.columns, decision, risk, F.col("layer_1.rule_id"), cleaned)


def _with_decision(rows: DataFrame, keep: list[str], decision: Column, risk: Column, rule_id: Column, cleaned: Column) -> DataFrame:
    """The kept columns and those of DECISION, from a struct of action, layer and status."""
    action = F.col("_decision.action")
    return rows.withColumn("_decision", decision).select(
        *keep, action.alias("action_taken"), F.col("_decision.layer").alias("triggered_layer"), (action == "BLOCKED").alias("is_blocked"), risk.alias("risk_score"),
        rule_id.alias("rule_id"), F.col("_decision.status").alias("verdict_status"), F.when(action == "REDACTED", cleaned).alias("sanitized_prompt"),
    )


def json_objects(text: str) -> list[dict]:
    """The objects that stand at top level in free text, whatever is around them."""
    found, at, reader = [], text.find("{"), json.JSONDecoder()
    while at >= 0:
        try:
            value, end = reader.raw_decode(text, at)
        except (ValueError, RecursionError):
            end = at + 1
        else:
            found.append(value)
        at = text.find("{", end)
    return found


def shortened(text: str) -> str:
    text = text.strip()
    return text if len(text) <= MAX_RATIONALE else text[: MAX_RATIONALE - 3] + "..."


def read_verdict(reply: str | None, most: int | None = MAX_REPLY) -> tuple[str, str, str | None] | None:
    """(decision, rationale, sanitised prompt) of a judge's reply, of which `most` characters are read; None if it is not to be trusted."""
    said = [x for x in json_objects((reply or "")[:most]) if "decision" in x]
    named = {x["decision"].strip().upper() if isinstance(x["decision"], str) else None for x in said}
    if len(named) != 1 or not named <= set(VERDICTS):
        return None
    (decision,) = named
    why, cleaned = said[0].get("rationale"), said[0].get("sanitized_prompt")
    why = shortened(why) if isinstance(why, str) else ""
    if decision != "REDACT":
        return decision, why, None
    if not isinstance(cleaned, str) or not cleaned.strip():
        return "BLOCK", shortened("REDACT without sanitized_prompt, downgraded to BLOCK. " + why), None
    return decision, why, cleaned


@F.pandas_udf(VERDICT)
def verdict_of(replies: pd.Series) -> pd.DataFrame:
    rows = [read_verdict(x) or (None, None, None) for x in replies]
    return pd.DataFrame(rows, columns=["decision", "rationale", "sanitized_prompt"])


def parsed_verdict(reply: Column) -> Column:
    """The verdict struct of a reply, null if it is not to be trusted."""
    verdict = verdict_of(reply)
    return F.when(verdict["decision"].isNotNull(), verdict)


def judge_prompt(prompt: Column, system: Column, turns: Column) -> Column:
    """What a judge is asked: context, system text, and the input between delimiters."""
    lines = F.transform(turns, lambda t: F.concat(F.lit("- "), t))
    context = F.when(F.size(turns) > 0, F.concat(F.lit("Conversation context:\n"), F.array_join(lines, "\n"), F.lit("\n\n"))).otherwise("")
    told = F.when(F.coalesce(system, F.lit("")) != "", F.concat(F.lit("Application system prompt:\n"), system, F.lit("\n\n"))).otherwise("")
    return F.concat(context, told, F.lit("<<<INPUT>>>\n"), prompt, F.lit("\n<<<END_INPUT>>>"))


def failure_label(status: Column, error: Column) -> Column:
    return F.when(status.between(400, 599), F.concat(F.lit("http_status_"), status.cast("string"))).when(error.isin("timeout", "connection_error", "malformed_response"), error).otherwise("unexpected_error")
