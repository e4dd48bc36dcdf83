"""Writers: the threat log, its export as CSV, and files that are replaced at once."""

from __future__ import annotations

import json
import os
import tempfile
from functools import reduce

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.functions.text import neutralize_formula
from weirgate.sources.tables import violated, violations


#: Columns that single rows are looked up by: their Bloom filters let a scan pass over row groups.
LOOKUPS = ("request_id", "client_ip")


def with_lookups(writer: DataFrameWriter, columns: tuple[str, ...] = LOOKUPS, distinct: int = 1_000_000) -> DataFrameWriter:
    """A Parquet writer that adds a Bloom filter for each column to each row group, made for `distinct` values (about 1.2 MB for a million)."""
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", distinct)
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    return writer


def write_logs(rows: DataFrame, path: str, max_rows: int = 0) -> None:
    """Append rows, partitioned by day; rows outside the log's domains go to `path`_quarantine instead. Lookups have Bloom filters."""
    bad = violations(rows)
    ok = rows.where(F.size(violated(rows.columns)) == 0)
    day = F.col("created_at").cast("date")
    writer = ok.withColumn("log_date", day).sortWithinPartitions("log_date", "created_at").write.mode("append").option("maxRecordsPerFile", max_rows)
    with_lookups(writer, tuple(c for c in LOOKUPS if c in rows.columns)).partitionBy("log_date").parquet(path)
    bad.write.mode("append").parquet(f"{path}_quarantine")


def write_rollup(rows: DataFrame, path: str) -> None:
    """Replace the days that rows hold, and no other: the upsert of hourly buckets."""
    days = rows.withColumn("day", F.col("bucket_start").cast("date"))
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def csv_ready(rows: DataFrame) -> DataFrame:
    """All columns as text: nested ones as JSON, times in ISO form, strings safe from spreadsheets."""
    out = []
    for f in rows.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = neutralize_formula(c)
        elif isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType):
            c = neutralize_formula(F.to_json(c))
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        name = f"'{f.name}" if f.name[:1] in "=+-@\t\r" else f.name
        out.append(c.alias(name))
    return rows.select(*out)


def with_all_columns(frames: list[DataFrame]) -> DataFrame:
    """The rows of all frames with the columns of all, in the order in which they first occur; null where a frame has none."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv(rows: DataFrame, path: str, mark: bool = True) -> None:
    """CSV files in UTF-8; each begins with a byte order mark, by which spreadsheets tell the encoding, unless `mark` is off."""
    out = csv_ready(rows)
    if mark and out.columns:
        out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0])
    out.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', encoding="UTF-8")


def replace_file(path: str, value: dict) -> None:
    """Write JSON beside `path`, flush it, and rename it over `path`: readers see the old or the new file."""
    fd, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".tmp")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(value, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise
