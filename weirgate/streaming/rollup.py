"""The hourly rollup as a stream, and the cascade over a stream of requests."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.operators.cascade import ConfigFile
from weirgate.operators.log_analytics import hourly_rollup, latency_sketch, sketch_percentile
from weirgate.sources.exports import write_rollup
from weirgate.sources.rules import Rule, rules_fingerprint, rules_from
from weirgate.sources.snapshots import SnapshotTable
from weirgate.sources.tables import threat_logs

LOG = logging.getLogger(__name__)
#: Rows later than that are left to a backfill.
LATENESS = "3 hours"


def windowed_rollup(stream: DataFrame, exact: bool = True) -> DataFrame:
    """hourly_rollup over a stream of log rows, with a watermark. Where requests may repeat, unique_requests comes first.

    An exact p95 keeps all distinct latencies of an hour as state. With exact=False the state is bounded: the
    latencies are a sketch, which stays as a column and from which p95 comes, by nearest rank.
    """
    layer = lambda name: F.count_if((F.col("triggered_layer") == name) & F.col("is_blocked"))
    timed = stream.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", LATENESS)
    high = F.round(F.percentile("execution_time_ms", 0.95), 6).alias("p95_latency_ms") if exact else latency_sketch().alias("latency_sketch")
    sums = timed.groupBy(F.window("created_at", "1 hour")).agg(
        F.count("*").alias("total_requests"), F.count_if("is_blocked").alias("blocked_requests"), layer("LAYER_1").alias("layer_1_blocks"), layer("LAYER_2").alias("layer_2_blocks"),
        layer("LAYER_3").alias("layer_3_blocks"), layer("OUTPUT_SCANNER").alias("output_blocks"), F.round(F.avg("execution_time_ms"), 6).alias("avg_latency_ms"), high,
    )
    out = sums.select(F.col("window.start").cast("timestamp_ntz").alias("bucket_start"), *[c for c in sums.columns if c != "window"])
    return out if exact else out.withColumn("p95_latency_ms", F.round(sketch_percentile(F.col("latency_sketch"), 0.95), 6))


def unique_requests(stream: DataFrame) -> DataFrame:
    """The first row of each request_id that comes within LATENESS; append mode."""
    timed = stream.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return timed.withWatermark("created_at", LATENESS).dropDuplicatesWithinWatermark(["request_id"])


def keep_rollup(stream: DataFrame, target: str | SnapshotTable, checkpoint: str, name: str = "rollup", exact: bool = True):
    """Start the query that keeps the rollup at `target` up to date.

    In a snapshot table changed hours are merged, each batch once; in a plain folder changed days are written anew.
    """

    def upsert(changed: DataFrame, batch: int) -> None:
        spark = changed.sparkSession
        changed = changed.persist()
        try:
            if isinstance(target, SnapshotTable):
                target.merge(changed, "bucket_start", (name, batch))
                return
            days = changed.select(F.col("bucket_start").cast("date").alias("day")).distinct()
            try:
                old = spark.read.parquet(target).join(F.broadcast(days), "day", "left_semi").drop("day").join(changed, "bucket_start", "left_anti")
                old = spark.createDataFrame(old.collect(), old.schema)  # at most 24 rows for each changed day; the files are replaced below
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
                old = changed.limit(0)
            write_rollup(old.unionByName(changed), target)
        finally:
            changed.unpersist()

    return windowed_rollup(stream, exact).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(upsert)


def stream_rollup(spark: SparkSession, events_path: str, exact: bool = True) -> DataFrame:
    """The rollup of a table of events, read as one stream to its end into memory."""
    schema = spark.read.parquet(events_path).schema
    folder, _, name = events_path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if _is_file(spark, events_path) else spark.readStream.schema(schema).parquet(events_path)
    table = f"rollup_{uuid.uuid4().hex}"
    query = windowed_rollup(threat_logs(stream), exact).writeStream.outputMode("complete").format("memory").queryName(table).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(table)


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def score_stream(
    stream: DataFrame, rules_table: Callable[[], DataFrame], handle: Callable[..., DataFrame], sink: Callable[[DataFrame], None] | SnapshotTable, checkpoint: str,
    config: ConfigFile | None = None, log: SnapshotTable | None = None, entries: Callable[[DataFrame], DataFrame] = lambda rows: rows, unique: bool = False, name: str = "scores",
):
    """Run `handle(rows, rules[, config])` over each micro-batch with the rules, and the config, of that moment.

    The last good rules stay if a reload fails, and the last good config if its file is broken. A sink that is a
    snapshot table takes each batch once, even if it is replayed after a crash. `log` takes `entries` of the batch, once
    too, and each request_id once in its hour; if that fails, the answers still go out and the failure is only
    written down. `unique` lets each request_id of the stream pass once within LATENESS.
    """
    state: dict = {"fingerprint": None, "rules": []}

    def batch(rows: DataFrame, number: int) -> None:
        try:
            table = rules_table()
            now = rules_fingerprint(table).first()[0]
            if now != state["fingerprint"]:
                state.update(rules=rules_from(table), fingerprint=now)
        except Exception:
            if state["fingerprint"] is None:
                raise
        done = handle(rows, state["rules"], *([config.current()] if config else []))
        if log is not None:
            done = done.persist()
        try:
            if isinstance(sink, SnapshotTable):
                sink.append(done, (name, number))
            else:
                sink(done)
            if log is not None:
                try:
                    log.append(entries(done), (name, number), unique="request_id")
                except Exception as e:
                    LOG.warning("the log of batch %d was not written: %s", number, e)
        finally:
            if log is not None:
                done.unpersist()

    return (unique_requests(stream) if unique else stream).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)


__all__ = ["hourly_rollup", "keep_rollup", "score_stream", "stream_rollup", "unique_requests", "windowed_rollup"]
