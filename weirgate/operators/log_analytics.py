"""Questions about the threat log: each is one scan with conditional aggregates.

Times are compared half-open, [start, end). `as_of` stands for "now"; ratios and means are rounded to
six decimals. A null or missing value never counts as blocked, flagged or bypassed.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAYERS = ("LAYER_1", "LAYER_2", "LAYER_3", "OUTPUT_SCANNER")
BUCKETS = ("minute", "hour", "day")
#: Up to so many hours a question reads the log, beyond it the hourly rollup.
RAW_HOURS = 48


def ts(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def since(as_of: str, hours: int) -> Column:
    return ts(as_of) - F.make_dt_interval(hours=F.lit(hours))


def within(as_of: str, hours: int, offset: int = 0) -> Column:
    """[as_of - offset - hours, as_of - offset)."""
    if hours < 1 or offset < 0:
        raise ValueError("hours must be at least 1 and offset at least 0")
    return (F.col("created_at") >= since(as_of, hours + offset)) & (F.col("created_at") < since(as_of, offset))


def bypassed() -> Column:
    return F.coalesce(F.get_json_object("layer_details", "$.firewall_master") == "OFF", F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(0.0), 6)


def truncated(bucket: str, column: str = "created_at") -> Column:
    if bucket not in BUCKETS:
        raise ValueError(f"bucket must be one of {BUCKETS}")
    return F.date_trunc(bucket, column).cast("timestamp_ntz")


def _latency(exact: bool = True, p: float = 0.95) -> tuple[Column, Column]:
    """Mean and percentile. An exact percentile keeps all distinct values of a group in memory; exact=False takes a sketch."""
    high = F.percentile("execution_time_ms", p) if exact else F.percentile_approx("execution_time_ms", p, 10_000)
    return F.round(F.coalesce(F.avg("execution_time_ms"), F.lit(0.0)), 6), F.round(F.coalesce(high, F.lit(0.0)), 6)


def hourly_rollup(logs: DataFrame, exact: bool = True) -> DataFrame:
    """One row of metrics for each hour with traffic."""
    avg, p95 = _latency(exact)
    layer = lambda name: F.count_if((F.col("triggered_layer") == name) & F.col("is_blocked"))
    return logs.groupBy(truncated("hour").alias("bucket_start")).agg(
        F.count("*").alias("total_requests"), F.count_if("is_blocked").alias("blocked_requests"), layer("LAYER_1").alias("layer_1_blocks"),
        layer("LAYER_2").alias("layer_2_blocks"), layer("LAYER_3").alias("layer_3_blocks"), layer("OUTPUT_SCANNER").alias("output_blocks"),
        avg.alias("avg_latency_ms"), p95.alias("p95_latency_ms"),
    )


#: Values that a latency sketch keeps; up to so many its percentiles are exact, beyond them their rank errs by about 2.3 / SKETCH**0.9 (0.0013),
#: and `settled` makes them exact from the log.
SKETCH = 4096


def latency_sketch(k: int = SKETCH) -> Column:
    """A mergeable sketch (KLL) of the latencies of a group."""
    return F.kll_sketch_agg_double(F.col("execution_time_ms").cast("double"), F.lit(k))


def sketch_percentile(sketch: Column, p: float) -> Column:
    """The percentile by nearest rank; null of an empty sketch."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(p))))


def sketched_rollup(logs: DataFrame, k: int = SKETCH) -> DataFrame:
    """hourly_rollup with p95 from a sketch, and the sketch, which later questions merge over any hours."""
    avg, _ = _latency(exact=False)
    layer = lambda name: F.count_if((F.col("triggered_layer") == name) & F.col("is_blocked"))
    sums = logs.groupBy(truncated("hour").alias("bucket_start")).agg(
        F.count("*").alias("total_requests"), F.count_if("is_blocked").alias("blocked_requests"), layer("LAYER_1").alias("layer_1_blocks"),
        layer("LAYER_2").alias("layer_2_blocks"), layer("LAYER_3").alias("layer_3_blocks"), layer("OUTPUT_SCANNER").alias("output_blocks"),
        avg.alias("avg_latency_ms"), latency_sketch(k).alias("latency_sketch"),
    )
    p95 = F.round(F.coalesce(sketch_percentile(F.col("latency_sketch"), 0.95), F.lit(0.0)), 6)
    return sums.withColumn("p95_latency_ms", p95).select(*[c for c in sums.columns if c != "latency_sketch"], "p95_latency_ms", "latency_sketch")


def merged_latency(rollup: DataFrame, by: list[Column], k: int = SKETCH) -> DataFrame:
    """Traffic-weighted mean, largest hourly p95, and the p95 of all requests from the merged sketches of a sketched_rollup."""
    weighted = F.sum(F.col("avg_latency_ms") * F.col("total_requests")) / F.nullif(F.sum("total_requests"), F.lit(0))
    sums = rollup.where("total_requests > 0").groupBy(*by).agg(
        F.sum("total_requests").alias("total"), F.round(weighted, 4).alias("avg_ms"), F.max("p95_latency_ms").alias("max_p95_ms"), F.kll_merge_agg_double("latency_sketch", F.lit(k)).alias("sketch")
    )
    return sums.withColumn("p95_ms", F.round(sketch_percentile(F.col("sketch"), 0.95), 6))


def settled(rollup: DataFrame, logs: DataFrame, bucket: str, key: str, high: str, sketch: str, total: str, p: float = 0.95, k: int = SKETCH, proposals: DataFrame | None = None) -> DataFrame:
    """`rollup` with the exact percentile by nearest rank as `high`, for groups of any size: `key` is the time cut to `bucket`.

    A sketch answers for a group that it holds whole. The others are read twice more from the log: counts between
    values that the sketch proposes tell which stretch the rank lies in, and only that stretch is sorted. A sketch
    that errs makes the stretch longer, not the result wrong. `proposals` has the same groups, where they are cheaper to make.
    """
    held = F.kll_sketch_get_n_double(sketch)
    steps = sorted({round(i / 10, 1) for i in range(1, 10)} | {round(p + d, 4) for d in (-0.03, -0.004, 0.004, 0.03) if 0 < p + d < 1})
    cuts = F.when(held > 0, F.kll_sketch_get_quantile_double(F.col(sketch), F.array(*map(F.lit, steps))))
    wide = (rollup if proposals is None else proposals).where((held > k) | (held != F.col(total))).select(F.col(key).alias("wide"), cuts.alias("cuts"))
    rows = logs.select(truncated(bucket).alias("at"), F.col("execution_time_ms").cast("double").alias("x")).where("x is not null")
    below = reduce(lambda a, b: a + b, (F.coalesce((F.get("cuts", F.lit(i)) < F.col("x")).cast("int"), F.lit(0)) for i in range(len(steps))))
    parts = rows.join(F.broadcast(wide), F.col("at").eqNullSafe(F.col("wide"))).select("at", "cuts", below.alias("below"))
    # The stretch is named by its ends, as a sketch that is made anew may propose others.
    counts = parts.groupBy("at", F.get("cuts", F.col("below") - 1).alias("low"), F.get("cuts", "below").alias("upper")).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("at").orderBy("low"))
    rank = F.greatest(F.lit(1), F.ceil(F.sum("n").over(Window.partitionBy("at")).cast("decimal(20,0)") * F.lit(Decimal(str(p)))).cast("long"))
    chosen = counts.select(F.col("at").alias("chosen"), "low", "upper", (rank - so_far + F.col("n")).alias("rank"), "n").where("rank between 1 and n").drop("n")
    inside = (F.col("low").isNull() | (F.col("x") > F.col("low"))) & (F.col("upper").isNull() | (F.col("x") <= F.col("upper")))
    values = rows.join(F.broadcast(chosen), F.col("at").eqNullSafe(F.col("chosen")) & inside).groupBy("at", "rank", "x").agg(F.count("*").alias("n"))
    reached = values.select("at", "x", "rank", F.sum("n").over(Window.partitionBy("at").orderBy("x")).alias("upto")).where("upto >= rank")
    exact = reached.groupBy("at").agg(F.round(F.min("x"), 6).alias("exact"))
    return rollup.join(F.broadcast(exact), F.col(key).eqNullSafe(F.col("at")), "left").withColumn(high, F.coalesce("exact", high)).select(*rollup.columns)


def backfill(logs: DataFrame, start: str, end: str, deleted_before: str | None = None) -> DataFrame:
    """The rollup of every hour in [start, end), hours without traffic as zeros; never of hours that retention has deleted."""
    first = F.greatest(ts(start), ts(deleted_before)) if deleted_before else ts(start)
    hours = logs.sparkSession.range(1).select(F.explode(F.sequence(F.date_trunc("hour", first), ts(end).cast("timestamp") - F.expr("interval 1 second"), F.expr("interval 1 hour"))).alias("h")).select(F.col("h").cast("timestamp_ntz").alias("bucket_start"))
    have = hourly_rollup(logs.where((F.col("created_at") >= F.date_trunc("hour", first).cast("timestamp_ntz")) & (F.col("created_at") < ts(end))))
    return hours.join(have, "bucket_start", "left").na.fill(0)


def kpis(logs: DataFrame, exact: bool = True) -> DataFrame:
    """total, blocked, bypassed, safe, block_rate, avg and p95 of all given rows."""
    avg, p95 = _latency(exact)
    sums = logs.agg(F.count("*").alias("total"), F.count_if("is_blocked").alias("blocked"), F.count_if(bypassed()).alias("bypassed"), avg.alias("avg_latency_ms"), p95.alias("p95_latency_ms"))
    safe = F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("blocked") - F.col("bypassed"))
    return sums.select("*", safe.alias("safe"), ratio(F.col("blocked"), F.col("total") - F.col("bypassed")).alias("block_rate"))


def kpi_summary(logs: DataFrame, as_of: str, hours: int, offset: int = 0) -> DataFrame:
    return kpis(logs.where(within(as_of, hours, offset)))


def kpi_delta(logs: DataFrame, as_of: str, hours: int) -> DataFrame:
    """This period against the one before, in one scan: change of total in percent, of block rate in points."""
    now = F.col("created_at") >= since(as_of, hours)
    both = logs.where((F.col("created_at") >= since(as_of, 2 * hours)) & (F.col("created_at") < ts(as_of)))
    count = lambda cond: F.count_if(cond)
    sums = both.agg(*(
        count(period & cond).alias(f"{name}_{what}")
        for name, period in (("now", now), ("before", ~now))
        for what, cond in (("total", F.lit(True)), ("blocked", F.col("is_blocked")), ("bypassed", bypassed()))
    ))
    rate = lambda n: ratio(F.col(f"{n}_blocked"), F.col(f"{n}_total") - F.col(f"{n}_bypassed"))
    change = F.when(F.col("before_total") > 0, F.round(100.0 * (F.col("now_total") - F.col("before_total")) / F.col("before_total"), 6))
    return sums.select("now_total", "before_total", change.alias("total_change_pct"), F.round(100 * (rate("now") - rate("before")), 4).alias("block_rate_points"))


def timeseries(logs: DataFrame, rollup: DataFrame | None, as_of: str, hours: int, bucket: str) -> DataFrame:
    """total and blocked by bucket: from the log up to RAW_HOURS, else from the rollup (then minutes are hours)."""
    if hours <= RAW_HOURS or rollup is None:
        rows = logs.where(F.col("created_at") >= since(as_of, hours))
        return rows.groupBy(truncated(bucket).alias("bucket")).agg(F.count("*").alias("total"), F.count_if("is_blocked").alias("blocked"))
    rows = rollup.where(F.col("bucket_start") >= since(as_of, hours))
    at = truncated("day" if bucket == "day" else "hour", "bucket_start")
    return rows.groupBy(at.alias("bucket")).agg(F.sum("total_requests").alias("total"), F.sum("blocked_requests").alias("blocked"))


def latency_by_bucket(logs: DataFrame, rollup: DataFrame | None, as_of: str, hours: int, bucket: str) -> DataFrame:
    """Mean and p95: from the log, or traffic-weighted means and the largest p95 of the rollup's hours."""
    if hours <= RAW_HOURS or rollup is None:
        avg, p95 = _latency()
        return logs.where(F.col("created_at") >= since(as_of, hours)).groupBy(truncated(bucket).alias("bucket")).agg(avg.alias("avg_ms"), p95.alias("p95_ms"))
    rows = rollup.where((F.col("bucket_start") >= since(as_of, hours)) & (F.col("total_requests") > 0))
    at = truncated("day" if bucket == "day" else "hour", "bucket_start")
    weighted = F.sum(F.col("avg_latency_ms") * F.col("total_requests")) / F.nullif(F.sum("total_requests"), F.lit(0))
    return rows.groupBy(at.alias("bucket")).agg(F.round(weighted, 4).alias("avg_ms"), F.max("p95_latency_ms").alias("p95_ms"))


def layer_distribution(logs: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Blocked rows by layer; the four layers always appear, others if they occur."""
    spark = logs.sparkSession
    zeros = spark.range(1).select(F.explode(F.array(*map(F.lit, LAYERS))).alias("layer"), F.lit(0).cast("long").alias("blocked"))
    have = logs.where((F.col("created_at") >= since(as_of, hours)) & F.col("is_blocked")).groupBy(F.col("triggered_layer").alias("layer")).agg(F.count("*").alias("blocked"))
    return zeros.union(have).groupBy("layer").agg(F.sum("blocked").alias("blocked"))


def risk_histogram(logs: DataFrame, as_of: str, hours: int, bins: int) -> DataFrame:
    """Exactly `bins` rows over [0, 1]; scores outside fall in the first or last bin."""
    if not 1 <= bins <= 100:
        raise ValueError("bins must be 1 to 100")
    place = F.greatest(F.lit(0), F.least(F.floor(F.col("risk_score") * bins), F.lit(bins - 1))).cast("long")
    have = logs.where(within(as_of, hours) & F.col("risk_score").isNotNull()).groupBy(place.alias("bin")).count()
    edge = lambda i: F.round(i / F.lit(float(bins)), 4)
    every = logs.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(have, "bin", "left").select(edge(F.col("bin")).alias("bin_start"), edge(F.col("bin") + 1).alias("bin_end"), F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(high, n))


def top_patterns(logs: DataFrame, as_of: str, hours: int, limit: int) -> DataFrame:
    hits = logs.where(within(as_of, hours)).select(F.explode("detected_patterns").alias("rule_id"))
    return hits.groupBy("rule_id").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "rule_id").limit(clamp(limit, 1, 50))


def top_clients(logs: DataFrame, as_of: str, hours: int, limit: int) -> DataFrame:
    sums = logs.where(within(as_of, hours)).groupBy("client_ip").agg(F.count("*").alias("total"), F.count_if("is_blocked").alias("blocked"))
    return sums.orderBy(F.desc("blocked"), F.desc("total"), "client_ip").limit(clamp(limit, 1, 50))


def client_bands(logs: DataFrame) -> DataFrame:
    """Clients with the band of their block rate."""
    sums = logs.groupBy("client_ip").agg(F.count("*").alias("total"), F.count_if("is_blocked").alias("blocked"))
    rate = F.col("blocked") / F.col("total")
    return sums.select("*", F.when(rate >= 0.55, "danger").when(rate >= 0.35, "gold").otherwise("safe").alias("band"))


def latency_series(rollup: DataFrame, as_of: str, hours: int) -> DataFrame:
    return rollup.where((F.col("bucket_start") >= since(as_of, hours)) & (F.col("total_requests") > 0)).select("bucket_start", F.col("avg_latency_ms").alias("avg_ms"), F.col("p95_latency_ms").alias("p95_ms")).orderBy("bucket_start")


def output_flag_counts(logs: DataFrame, as_of: str, hours: int) -> DataFrame:
    sums = logs.where(within(as_of, hours)).agg(
        F.count("*").alias("total"), F.count_if("output_flagged").alias("flagged"), F.count_if((F.col("triggered_layer") == "OUTPUT_SCANNER") & F.col("is_blocked")).alias("blocked_by_scanner")
    )
    return sums.select("*", ratio(F.col("flagged"), F.col("total")).alias("flag_rate"))


def output_flags_by_action(logs: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Flagged rows by action, with a row "TOTAL"."""
    rows = logs.where(within(as_of, hours) & F.col("output_flagged"))
    return rows.rollup("action_taken").agg(F.count("*").alias("flagged"), F.grouping("action_taken").alias("g")).select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("action_taken")).alias("action_taken"), "flagged")


def action_layer_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("action_taken", "triggered_layer").agg(F.count("*").alias("n"), F.count_if("output_flagged").alias("flagged")).orderBy("action_taken", "triggered_layer")


def layer_3_share(logs: DataFrame) -> DataFrame:
    judged = F.count_if(F.get_json_object("layer_details", "$.layer_3").isNotNull())
    return logs.agg(F.count("*").alias("total"), judged.alias("judged"), F.round(100.0 * judged / F.nullif(F.count("*"), F.lit(0)), 2).alias("judged_pct"))


def critical_recent(logs: DataFrame, as_of: str, newest: int = 50) -> DataFrame:
    """Critical rows among the newest blocked ones of the last hour; the cap is part of the question."""
    rows = logs.where(within(as_of, 1) & F.col("is_blocked")).orderBy(F.desc("created_at"), F.desc("request_id")).limit(newest)
    return rows.agg(F.count_if((F.col("risk_score") >= 0.9) | (F.col("triggered_layer") == "LAYER_1")).alias("critical"))


def stage_share(logs: DataFrame) -> DataFrame:
    """Where requests were decided, in whole percent (half to even), and the bar's width."""
    total = logs.agg(F.count("*").alias("total"))
    counts = logs.groupBy("triggered_layer").agg(F.count("*").alias("n"))
    share = F.bround(100.0 * F.col("n") / F.greatest(F.lit(1), F.col("total")), 0)
    return counts.crossJoin(F.broadcast(total)).select("triggered_layer", "n", share.cast("long").alias("share_pct"), F.least(F.lit(100), F.greatest(F.lit(2), share)).cast("long").alias("bar_width"))


def latency_percentiles(logs: DataFrame) -> DataFrame:
    """Nearest-rank percentiles for each application."""
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by execution_time_ms)")
    return logs.groupBy("application_id").agg(disc(0.5).alias("p50"), disc(0.95).alias("p95"), disc(0.99).alias("p99"), F.max("execution_time_ms").alias("max"))


def latency_stats(logs: DataFrame, last: int = 1000) -> DataFrame:
    """count, p50, p95 and max of each application's last samples, by nearest index (half to even).

    The newest rows are found in three steps: of each task (up to 1,000, Spark's limit for groups that it cuts before
    a shuffle), of each of 256 shares of the tasks, and of the application, which gets 256 times `last` rows at most.
    """
    from pyspark.sql import Window

    order = (F.desc("created_at"), F.desc("request_id"))
    shares = logs.select("application_id", "execution_time_ms", "created_at", "request_id", (F.spark_partition_id() % 256).alias("share"))
    rows = shares.withColumn("r", F.row_number().over(Window.partitionBy("application_id", "share").orderBy(*order))).where(F.col("r") <= last)
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("application_id").orderBy(*order))).where(F.col("r") <= last)
    sums = rows.groupBy("application_id").agg(F.array_sort(F.collect_list("execution_time_ms")).alias("x"))
    at = lambda p: F.round(F.element_at("x", (F.rint(F.lit(p) * (F.size("x") - 1)) + 1).cast("int")), 3)
    return sums.select("application_id", F.size("x").cast("long").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.round(F.element_at("x", F.lit(-1)), 3).alias("max"))


def table_fingerprint(rows: DataFrame, key: str, digits: int = 3) -> DataFrame:
    """md5 over the keys in order, in two levels so that no task holds all keys: by hash bucket (16**digits), then over the buckets."""
    buckets = rows.groupBy(F.substring(F.md5(key), 1, digits).alias("bucket")).agg(F.count("*").alias("n"), F.md5(F.expr(f"listagg({key}, ',') within group (order by {key})")).alias("part"))
    return buckets.agg(F.sum("n").alias("n"), F.md5(F.expr("listagg(part, ',') within group (order by bucket)")).alias("fingerprint"))


def app_counts(logs: DataFrame, app: str) -> DataFrame:
    return logs.agg(F.count_if(F.col("application_id") == app).alias("own"), F.count_if(F.col("application_id") != app).alias("other"), F.min("created_at").alias("oldest"))


def retention_preview(logs: DataFrame, as_of: str, days: int) -> DataFrame:
    cutoff = F.date_trunc("hour", ts(as_of) - F.make_dt_interval(days=F.lit(days))).cast("timestamp_ntz")
    return logs.agg(F.count_if(F.col("created_at") < cutoff).alias("expired"), F.min("created_at").alias("oldest")).select("*", cutoff.alias("cutoff"))


@dataclass(frozen=True)
class LogFilters:
    start: str | None = None
    end: str | None = None
    is_blocked: bool | None = None
    triggered_layer: str | None = None
    client_ip: str | None = None
    min_risk: float | None = None
    text: str | None = None
    bypassed_only: bool = False
    action_taken: str | None = None

    def predicate(self) -> Column:
        if self.triggered_layer is not None and self.triggered_layer not in ("NONE", *LAYERS):
            raise ValueError(f"unknown layer {self.triggered_layer!r}")
        parts = [F.lit(True)]
        if self.start:
            parts.append(F.col("created_at") >= ts(self.start))
        if self.end:
            parts.append(F.col("created_at") < ts(self.end))
        if self.is_blocked is not None:
            parts.append(F.col("is_blocked") == self.is_blocked)
        for name in ("triggered_layer", "client_ip", "action_taken"):
            if getattr(self, name):
                parts.append(F.col(name) == getattr(self, name))
        if self.min_risk is not None:
            parts.append(F.col("risk_score") >= self.min_risk)
        if self.text:
            escaped = self.text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
            parts.append(F.col("raw_prompt").ilike(f"%{escaped}%"))
        if self.bypassed_only:
            parts.append(bypassed())
        return reduce(lambda a, b: a & b, parts)


def status_filter(status: str) -> LogFilters:
    """The filter behind a status of the log view; "Redacted" filters by the action taken."""
    return {"Blocked": LogFilters(is_blocked=True), "Passed": LogFilters(is_blocked=False), "Bypassed": LogFilters(bypassed_only=True), "Redacted": LogFilters(action_taken="REDACTED")}.get(status, LogFilters())


SEARCH_COLUMNS = ("request_id", "created_at", "client_ip", "application_id", "action_taken", "triggered_layer", "is_blocked", "risk_score", "execution_time_ms")


def search(logs: DataFrame, filters: LogFilters, page: int = 1, size: int = 50) -> tuple[DataFrame, DataFrame]:
    """(one page, newest first; one row with the number of all matches)."""
    size, page = clamp(size, 1, 200), max(1, page)
    found = logs.where(filters.predicate())
    rows = found.orderBy(F.desc("created_at"), F.desc("request_id")).offset((page - 1) * size).limit(size)
    return rows.select(*SEARCH_COLUMNS, F.left("raw_prompt", F.lit(200)).alias("prompt_preview")), found.agg(F.count("*").alias("matches"))


def page_count(total: int, size: int) -> int:
    return max(1, -(-total // size))


def search_snapped(logs: DataFrame, filters: LogFilters, page: int = 1, size: int = 50) -> tuple[DataFrame, int, int]:
    """(the page, its number, number of pages): a page beyond the last one is the last one. Counts the matches first."""
    size = clamp(size, 1, 200)
    pages = page_count(logs.where(filters.predicate()).count(), size)
    page = clamp(page, 1, pages)
    return search(logs, filters, page, size)[0], page, pages


def export(logs: DataFrame, filters: LogFilters, limit: int = 10_000) -> DataFrame:
    return logs.where(filters.predicate()).orderBy(F.desc("created_at"), F.desc("request_id")).limit(clamp(limit, 1, 10_000))


def detail(logs: DataFrame, request_id: str) -> DataFrame:
    return logs.where(F.col("request_id") == request_id).limit(1)


def display(logs: DataFrame) -> DataFrame:
    """What the log view derives: action and direction shown, evidence, risk band, preview."""
    layer = F.col("triggered_layer")
    return logs.select(
        "request_id", F.when(bypassed(), "BYPASSED").otherwise(F.col("action_taken")).alias("display_action"), F.when(layer == "OUTPUT_SCANNER", "OUTPUT").otherwise("INPUT").alias("direction"),
        F.coalesce(F.get_json_object("layer_details", "$.layer_1.rule_id"), F.get("detected_patterns", F.lit(0))).alias("evidence"), risk_band(F.col("risk_score")).alias("risk_band"),
        preview(F.col("raw_prompt")).alias("preview"),
    )


def preview(text: Column, width: int = 80) -> Column:
    flat = F.regexp_replace(text, "\n", " ")
    return F.when(F.length(flat) > width, F.concat(F.left(flat, F.lit(width)), F.lit("…"))).otherwise(flat)


def risk_band(score: Column) -> Column:
    return F.when(score >= 0.85, "danger").when(score >= 0.35, "gold").otherwise("safe")


def layer_trace(logs: DataFrame) -> DataFrame:
    """One row for each request and layer: Clear before the deciding layer, its action, Not reached after it."""
    order = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("triggered_layer"))
    steps = logs.select("request_id", "action_taken", order.alias("stop"), F.posexplode(F.array(*map(F.lit, LAYERS))).alias("i", "layer"))
    here = F.col("i") + 1
    state = F.when((F.col("stop") == 0) | (here < F.col("stop")), "Clear").when(here == F.col("stop"), F.col("action_taken")).otherwise("Not reached")
    return steps.select("request_id", "layer", state.alias("state"))


def categories_of_hits(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """Hits by the category and severity of their rules."""
    hits = logs.select(F.explode("detected_patterns").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"))
    return hits.join(rules.select("rule_id", "category", "severity"), "rule_id").groupBy("category", "severity").agg(F.sum("n").alias("hits"))
