"""Searches of a long log: pages that read only the days they show, and substrings looked up in an index of its files.

Newest first: `created_at`, then `request_id`, both descending. A missing time comes last, a missing id counts as the
empty one. Two rows with the same time and id have no order between them, and a cursor steps over both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.operators.log_analytics import SEARCH_COLUMNS, LogFilters, clamp, page_count

#: A page is cut out of at most so many rows by skipping; a longer stretch of the log is first narrowed by counts.
STRETCH = 100_000
#: Bits of a bitmap that Spark joins at a time (its fixed size), and of a file's signature.
BITMAP, BITS = 32_768, 1 << 20
#: Bytes of text that one numpy step works on.
STEP = 1 << 20


@dataclass(frozen=True)
class Cursor:
    """The place of a row in the log: the next page begins behind it."""

    created_at: datetime | None
    request_id: str


def cursor_of(row) -> Cursor:
    return Cursor(row["created_at"], row["request_id"] or "")


def day_counts(logs: DataFrame, filters: LogFilters) -> list[tuple[date | None, int]]:
    """How many matches each day has, newest first: the directory of pages, one entry for a day of the log."""
    found = logs.where(filters.predicate()).groupBy(F.col("created_at").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return sorted(((r.day, r.n) for r in found.collect()), key=lambda x: x[0] or date.min, reverse=True)


def _in_days(logs: DataFrame, first: date | None, last: date | None) -> Column:
    """Rows from the day `first` to the day `last`, as a filter that reaches the scan; a log by day is read in these folders only."""
    if first is None:
        return F.col("created_at").isNull() if last is None else F.col("created_at").isNull() | (F.col("created_at") < F.lit(last + timedelta(days=1)).cast("timestamp_ntz"))
    at = (F.col("created_at") >= F.lit(first).cast("timestamp_ntz")) & (F.col("created_at") < F.lit(last + timedelta(days=1)).cast("timestamp_ntz"))
    return at & F.col("log_date").between(F.lit(first), F.lit(last)) if "log_date" in logs.columns else at


def _page(found: DataFrame, skip: int, size: int) -> DataFrame:
    rows = found.orderBy(F.desc_nulls_last("created_at"), F.coalesce("request_id", F.lit("")).desc()).offset(skip).limit(size)
    return rows.select(*SEARCH_COLUMNS, F.left("raw_prompt", F.lit(200)).alias("prompt_preview"))


def _narrowed(found: DataFrame, skip: int, size: int, rows: int, stretch: int) -> tuple[DataFrame, int]:
    """`found` without stretches before and behind the page, by counts of ever finer parts of the order, until `stretch` rows are left."""
    rid = F.coalesce("request_id", F.lit(""))
    steps = [F.date_trunc(unit, "created_at").cast("timestamp_ntz") for unit in ("hour", "minute", "second")] + [F.col("created_at")]
    longest, level = None, 0
    while rows > stretch:
        if level == len(steps):
            longest = longest if longest is not None else found.agg(F.max(F.length(rid))).first()[0] or 0
            if level - 4 >= longest:
                break
            # Strings that share a beginning stand together, so ids are told apart letter by letter.
            steps.append(F.left(rid, F.lit(level - 3)))
        part = steps[level]
        counts = sorted(((r.part, r.n) for r in found.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect() if r.part is not None), key=lambda x: x[0].encode() if isinstance(x[0], str) else x[0], reverse=True)
        before = first = last = None
        done, count_of = 0, dict(counts)
        for value, n in counts:
            if done + n > skip and last is None:
                last, before = value, done
            done += n
            if last is not None and done >= skip + size:
                first = value
                break
        if last is None:
            break
        first = counts[-1][0] if first is None else first
        if first != last:
            # The page crosses a border: what it shows of the part before it are that part's last rows, counted from its end.
            tail = count_of[last] - (skip - before)
            end = found.where(part == F.lit(last)).orderBy(F.asc("created_at"), rid.asc()).limit(tail)
            return end.unionByName(found.where((part < F.lit(last)) & (part >= F.lit(first))).orderBy(F.desc("created_at"), rid.desc()).limit(size - tail)), 0
        found, skip, rows = found.where(part == F.lit(last)), skip - before, count_of[last]
        level += 1
    return found, skip


def page_at(logs: DataFrame, filters: LogFilters, page: int = 1, size: int = 50, days: list[tuple[date | None, int]] | None = None, stretch: int = STRETCH) -> tuple[DataFrame, int, int]:
    """(the page, its number, number of pages): only the days are read that the page shows. Beyond the last page comes the last one.

    `days` is the directory of the same filters, made once for all pages. Rows are skipped inside a stretch only; a
    day with more rows is narrowed by counts, one aggregation for each unit of time, and for each letter of the id
    if a moment is that full.
    """
    size = clamp(size, 1, 200)
    days = day_counts(logs, filters) if days is None else days
    pages = page_count(sum(n for _, n in days), size)
    page = clamp(page, 1, pages)
    skip, shown, seen, before = (page - 1) * size, [], 0, 0
    for day, n in days:
        if seen + n > skip and seen < skip + size:
            before = before if shown else seen
            shown.append((day, n))
        seen += n
    found = logs.where(filters.predicate())
    if not shown:
        return _page(found.limit(0), 0, size), page, pages
    found = found.where(_in_days(logs, shown[-1][0], shown[0][0]))
    rows = sum(n for _, n in shown)
    if rows > stretch and shown[-1][0] is not None:
        found, less = _narrowed(found, skip - before, size, rows, stretch)
        return _page(found, less, size), page, pages
    return _page(found, skip - before, size), page, pages


def page_after(logs: DataFrame, filters: LogFilters, cursor: Cursor, size: int = 50, days: list[tuple[date | None, int]] | None = None) -> DataFrame:
    """The page behind the cursor's row. A task keeps `size` rows, however far back the page lies; with a directory, days further back are not read."""
    size = clamp(size, 1, 200)
    rid = F.coalesce("request_id", F.lit(""))
    if cursor.created_at is None:
        behind = F.col("created_at").isNull() & (rid < cursor.request_id)
    else:
        at = F.lit(cursor.created_at).cast("timestamp_ntz")
        behind = F.col("created_at").isNull() | (F.col("created_at") < at) | ((F.col("created_at") == at) & (rid < cursor.request_id))
    found = logs.where(filters.predicate()).where(behind)
    if days is not None:
        here, left, oldest = cursor.created_at.date() if cursor.created_at else None, size, None
        for day, n in days:
            if here is not None and (day is None or day < here):
                left, oldest = left - n, day
                if left <= 0:
                    break
        if here is not None and left <= 0 and oldest is not None:
            found = found.where(_in_days(logs, oldest, here))
    return _page(found, 0, size)


def _bits(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits of a signature: one for each run of three bytes within a text; the texts stand one after another."""
    three = data[:-2].astype(np.uint32) | data[1:-1].astype(np.uint32) << np.uint32(8) | data[2:].astype(np.uint32) << np.uint32(16)
    whole = np.ones(len(three), bool)
    for back in (2, 1):  # the runs that cross the end of a text
        at = ends - back
        whole[at[(at >= 0) & (at < len(three))]] = False
    return (three[whole] * np.uint32(0x9E3779B1)) >> np.uint32(12)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, bucket, bits) over rows (file, text), which come file after file; a file's bits are held at a time."""
    now, seen = None, np.zeros(BITS, bool)

    def given(file: str) -> pa.RecordBatch:
        pieces = seen.reshape(-1, BITMAP)
        full = np.flatnonzero(pieces.any(axis=1))
        bits = [np.packbits(pieces[i], bitorder="little").tobytes() for i in full]
        return pa.RecordBatch.from_arrays([pa.array([file] * len(full), pa.string()), pa.array(full + 1, pa.int64()), pa.array(bits, pa.binary())], names=["file", "bucket", "bits"])

    for batch in batches:
        if not batch.num_rows:
            continue
        files = batch.column(0).dictionary_encode()
        codes = files.indices.to_numpy()
        starts = np.append(0, np.flatnonzero(np.diff(codes)) + 1)
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(codes)], strict=True):
            file = files.dictionary[int(codes[start])].as_py()
            if file != now:
                if now is not None:
                    yield given(now)
                now = file
                seen[:] = False
            texts = batch.column(1).slice(start, end - start).cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            if offsets[-1] == offsets[0]:
                continue
            data = np.frombuffer(texts.buffers()[2], np.uint8)
            for at in range(int(offsets[0]), int(offsets[-1]), STEP):
                to = min(at + STEP + 2, int(offsets[-1]))
                inner = offsets[np.searchsorted(offsets, at, side="right") : np.searchsorted(offsets, to, side="left")]
                seen[_bits(data[at:to], inner - at)] = True
    if now is not None:
        yield given(now)


def file_signatures(rows: DataFrame, column: str) -> DataFrame:
    """(file, bucket, bits): for each file of a table the trigrams (of bytes, in lower case) of a column, as a Bloom filter in pieces of 32,768 bits.

    A file's bits are set where it is read, so that a piece, not a text, crosses the network. Null and short texts set none.
    """
    made = rows.select(F.col("_metadata.file_path").alias("file"), F.lower(column).alias("text")).mapInArrow(_pieces, "file string, bucket long, bits binary")
    return made.groupBy("file", "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))


def files_that_may_hold(signatures: DataFrame, *texts: str) -> DataFrame:
    """(file): those that have all trigrams of one of the texts; only the pieces that these lie in are read. Each text needs three characters."""
    lowered = signatures.sparkSession.range(1).select(F.array(*(F.lower(F.lit(t)) for t in texts)).alias("t")).first().t
    tests = []
    for text in lowered:
        wanted: dict[int, list[int]] = {}
        for bit in np.unique(_bits(np.frombuffer(text.encode(), np.uint8), np.zeros(0, np.int64))).tolist():
            wanted.setdefault(bit // BITMAP + 1, []).append(bit % BITMAP)
        if not wanted:
            raise ValueError("a text needs three characters")
        all_set = F.lit(False)
        for bucket, positions in wanted.items():
            set_here = F.col("bucket") == bucket
            for p in positions:
                byte = F.conv(F.hex(F.substring("bits", p // 8 + 1, 1)), 16, 10).cast("int")
                set_here &= F.shiftright(byte, p % 8).bitwiseAND(F.lit(1)) == 1
            all_set |= set_here
        tests.append((all_set, len(wanted)))
    any_set = reduce(lambda a, b: a | b, (all_set for all_set, _ in tests))
    counts = signatures.where(any_set).groupBy("file").agg(*(F.count_if(all_set).alias(f"n{i}") for i, (all_set, _) in enumerate(tests)))
    return counts.where(reduce(lambda a, b: a | b, (F.col(f"n{i}") == n for i, (_, n) in enumerate(tests)))).select("file")


def indexed_search(spark: SparkSession, path: str, signatures: DataFrame, filters: LogFilters) -> DataFrame:
    """The rows of the log at `path` that match: of files with a signature those only that may hold `filters.text`, and all that are newer than the index.

    What a signature lets through is compared as without it. The driver holds names of files, as it does in any listing.
    """
    logs = spark.read.parquet(path)
    if filters.text and len(filters.text) >= 3:
        hopeless = {r.file for r in signatures.select("file").distinct().join(files_that_may_hold(signatures, filters.text), "file", "left_anti").collect()}
        kept = [f for f in logs.inputFiles() if f not in hopeless]
        logs = spark.read.schema(logs.schema).option("basePath", path).parquet(*kept) if kept else logs.limit(0)
    return logs.where(filters.predicate())
