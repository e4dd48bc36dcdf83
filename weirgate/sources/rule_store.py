"""Mutable rules with an audit trail, as numbered versions.

A change reads the newest version and publishes the next one, rules and audit rows in one file; of two writers
that come at once, one publishes and the other applies its change to what the first has made. So no change is
lost, and readers see the rules before or after a change, never between. Rules are few: the store keeps them on
the driver and hands out frames; the audit trail is read by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.operators.log_analytics import hourly_rollup
from weirgate.sources.exports import replace_file, write_rollup
from weirgate.sources.rules import Rule, rules_frame
from weirgate.sources.snapshots import VersionLog
from weirgate.sources.tables import AUDIT_LOGS

UPDATABLE = ("rule_type", "category", "pattern", "description", "severity", "is_active")


class RuleError(ValueError):
    """A change that the store refuses."""


#: What a version holds, as Spark reads it; details of an audit row are JSON.
VERSION = "audit array<struct<timestamp:string,admin_user:string,action:string,target_rule_id:string,change_details:string>>"
TRIES = 100

Change = Callable[[list[Rule]], tuple[list[Rule], list[dict]] | None]


class RuleStore:
    """Rules in a folder of any Hadoop file system that several writers may change at once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder, VersionLog(spark, f"{folder}/versions")

    def _at(self, version: int) -> list[Rule]:
        return [Rule(**x) for x in self.log.read(version)["rules"]] if version else []

    def rules(self) -> list[Rule]:
        return self._at(self.log.latest())

    def frame(self) -> DataFrame:
        return rules_frame(self.spark, self.rules())

    def audit(self) -> DataFrame:
        """The audit rows of all changes, read by Spark from the versions."""
        if not self.log.latest():
            return self.spark.createDataFrame([], AUDIT_LOGS)
        rows = self.spark.read.schema(VERSION).json(f"{self.folder}/versions").select(F.explode("audit").alias("a")).select("a.*")
        return rows.withColumn("timestamp", F.col("timestamp").cast("timestamp"))

    def _change(self, change: Change) -> None:
        """Publish what `change` makes of the newest rules; if another writer was first, of what they have made. None: nothing changes."""
        for _ in range(TRIES):
            version = self.log.latest()
            made = change(self._at(version))
            if made is None:
                return
            rules, audit = made
            if self.log.publish(version + 1, {"rules": [asdict(r) for r in sorted(rules, key=lambda r: r.rule_id)], "audit": audit}):
                return
        raise RuleError("too many writers at once")

    @staticmethod
    def _entry(at: str, user: str, action: str, target: str | None, before: dict | None, after: dict | None, **details) -> dict:
        return {"timestamp": at, "admin_user": user, "action": action, "target_rule_id": target, "change_details": json.dumps({"before": before, "after": after, **details}, default=str)}

    def create(self, rule: Rule, user: str, at: str) -> Rule:
        if found := rule.problems():
            raise RuleError(f"invalid {', '.join(found)}")

        def change(rules: list[Rule]):
            if any(r.rule_id == rule.rule_id for r in rules):
                raise RuleError(f"{rule.rule_id} exists")
            return [*rules, rule], [self._entry(at, user, "RULE_CREATED", rule.rule_id, None, asdict(rule))]

        self._change(change)
        return rule

    def update(self, rule_id: str, changes: dict, user: str, at: str) -> Rule:
        """The rule with the changes; without a difference nothing is written."""
        if unknown := set(changes) - set(UPDATABLE):
            raise RuleError(f"cannot change {sorted(unknown)}")
        result: list[Rule] = []

        def change(rules: list[Rule]):
            by_id = {r.rule_id: r for r in rules}
            if rule_id not in by_id:
                raise RuleError(f"no rule {rule_id}")
            old, new = by_id[rule_id], replace(by_id[rule_id], **changes)
            result[:] = [new]
            if new == old:
                return None
            if found := new.problems():
                raise RuleError(f"invalid {', '.join(found)}")
            return [*(r for r in rules if r.rule_id != rule_id), new], [self._entry(at, user, "RULE_UPDATED", rule_id, asdict(old), asdict(new))]

        self._change(change)
        return result[0]

    def delete(self, rule_id: str, user: str, at: str) -> None:
        def change(rules: list[Rule]):
            old = next((r for r in rules if r.rule_id == rule_id), None)
            if old is None:
                raise RuleError(f"no rule {rule_id}")
            return [r for r in rules if r.rule_id != rule_id], [self._entry(at, user, "RULE_DELETED", rule_id, asdict(old), None)]

        self._change(change)

    def seed(self, wanted: list[Rule], user: str, at: str) -> dict[str, int]:
        """Insert what is missing and update what differs, in one version; counts of each."""
        if bad := [r.rule_id for r in wanted if r.problems()]:
            raise RuleError(f"invalid rules {bad}")
        counts: dict[str, int] = {}

        def change(rules: list[Rule]):
            have = {r.rule_id: r for r in rules}
            new = [r for r in wanted if r.rule_id not in have]
            changed = [r for r in wanted if r.rule_id in have and have[r.rule_id] != r]
            counts.update(inserted=len(new), updated=len(changed), unchanged=len(wanted) - len(new) - len(changed))
            if not new and not changed:
                return None
            audit = [self._entry(at, user, "RULE_CREATED", r.rule_id, None, asdict(r)) for r in new] + [self._entry(at, user, "RULE_UPDATED", r.rule_id, asdict(have[r.rule_id]), asdict(r)) for r in changed]
            return list((have | {r.rule_id: r for r in wanted}).values()), audit

        self._change(change)
        return counts

    def save_settings(self, before: dict, after: dict, path: str, user: str, at: str) -> None:
        """Replace a settings file and record the change."""
        if before != after:
            replace_file(path, after)
            self._change(lambda rules: (rules, [self._entry(at, user, "THRESHOLD_CHANGED", None, before, after)]))

    def add_deny_phrase(self, phrase: str, user: str, at: str) -> Rule:
        """A keyword rule with the next free number; a phrase that exists in any case is refused."""
        result: list[Rule] = []

        def change(rules: list[Rule]):
            if any(r.rule_type == "KEYWORD" and r.pattern.lower() == phrase.strip().lower() for r in rules):
                raise RuleError("the phrase exists")
            used = {r.rule_id for r in rules}
            name = next(f"RULE_DENY_{n:02d}" for n in range(1, len(used) + 2) if f"RULE_DENY_{n:02d}" not in used)
            rule = Rule(name, "KEYWORD", "JAILBREAK", "HIGH", phrase.strip())
            if found := rule.problems():
                raise RuleError(f"invalid {', '.join(found)}")
            result[:] = [rule]
            return [*rules, rule], [self._entry(at, user, "RULE_CREATED", name, None, asdict(rule))]

        self._change(change)
        return result[0]


def audit_message(action: Column, target: Column, details: Column) -> Column:
    """What an audit row says in words; the master switch is looked for under `after` and at top level."""
    master = F.coalesce(F.get_json_object(details, "$.after.firewall_enabled"), F.get_json_object(details, "$.firewall_enabled"))
    return (
        F.when(action == "RULE_CREATED", F.concat(F.lit("Created rule "), target)).when(action == "RULE_UPDATED", F.concat(F.lit("Updated rule "), target))
        .when(action == "RULE_DELETED", F.concat(F.lit("Deleted rule "), target)).when(master == "true", "Firewall switched on").when(master == "false", "Firewall switched off")
        .otherwise("Changed settings")
    )


def latest_master_change(audit: DataFrame, newest: int = 50) -> DataFrame:
    """The last change of the master switch among the newest settings changes."""
    rows = audit.where("action = 'THRESHOLD_CHANGED'").orderBy(F.desc("timestamp")).limit(newest)
    return rows.where(F.get_json_object("change_details", "$.after.firewall_enabled").isNotNull()).orderBy(F.desc("timestamp")).limit(1)


def seed_difference(have: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted rules with a state: inserted, updated or unchanged against the rules that exist."""
    same = F.lit(True)
    for c in UPDATABLE:
        same = same & F.col(f"w.{c}").eqNullSafe(F.col(f"h.{c}"))
    joined = wanted.alias("w").join(have.alias("h"), F.col("w.rule_id") == F.col("h.rule_id"), "left")
    state = F.when(F.col("h.rule_id").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    return joined.select("w.*", state.alias("state"))


def delete_before(spark: SparkSession, path: str, cutoff_day: str) -> int:
    """Retention: drop the log's day partitions before cutoff_day, and say how many. The rollup must be up to date first."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("log_date=") and s.getPath().getName()[9:] < cutoff_day]
    for p in old:
        fs.delete(p, True)
    return len(old)


def retire(spark: SparkSession, path: str, rollup_path: str, cutoff_day: str) -> int:
    """Retention in order: the rollup of the days to go is made from the log once more, then they are deleted.

    Later rollups read the log as it is then, so no deleted hour is ever made anew.
    """
    write_rollup(hourly_rollup(spark.read.parquet(path).where(F.col("log_date") < F.lit(cutoff_day).cast("date"))), rollup_path)
    return delete_before(spark, path, cutoff_day)


def reset_demo(spark: SparkSession, path: str, rollup_path: str, is_demo: Column, scratch: str) -> int:
    """Delete the log's demo rows and make the rollup of their days anew; the number of deleted rows.

    Only days with demo rows are rewritten: what stays of them is written to `scratch`, compared by count and
    fingerprint with the log's other rows, and then takes the days' place.
    """
    log = spark.read.parquet(path)
    demo = log.where(F.coalesce(is_demo, F.lit(False)))
    days = [r[0] for r in demo.select("log_date").distinct().collect()]  # days of a log are few
    if not days:
        return 0
    n = demo.count()
    other = log.where(~F.coalesce(is_demo, F.lit(False)) & F.col("log_date").isin(days))
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*sorted(set(log.columns) - {"log_date"})).cast("decimal(38,0)"))).first()
    other.write.mode("overwrite").partitionBy("log_date").parquet(scratch)
    kept = spark.read.schema(log.schema).option("basePath", scratch).parquet(scratch)
    if print_of(kept) != print_of(other):
        raise RuntimeError("the rows that stay differ from those of the log; nothing was deleted")
    fs, jvm = _files(spark, path)
    for day in days:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/log_date={day}"), True)
    kept.write.mode("append").partitionBy("log_date").parquet(path)
    for day in days:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{rollup_path}/day={day}"), True)
    write_rollup(hourly_rollup(spark.read.schema(log.schema).parquet(path).where(F.col("log_date").isin(days))), rollup_path)
    return n


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


__all__ = ["RuleError", "RuleStore", "audit_message", "delete_before", "latest_master_change", "reset_demo", "retire", "seed_difference"]
