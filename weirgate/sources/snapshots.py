"""Tables as snapshots: data files that are only added, and numbered manifests that say which of them count.

A change writes its files first and then publishes the next manifest, which no two writers can both do: the
name is taken by an exclusive rename (a hard link on local disks). A reader follows the newest manifest and so
sees a table before or after a change, never between; a writer that comes second reads the newer manifest and
tries again. A crash at any step leaves files that no manifest names, which vacuum() removes.

Changes may carry a transaction (name, number): of one name, a number is applied once and never after a larger
one, so a stream's replayed batch changes nothing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Format of a unit's name by its kind, and the column of the data folders that holds it.
UNITS = {"hour": "yyyy-MM-dd-HH", "day": "yyyy-MM-dd"}
UNIT = "snapshot_unit"
TRIES = 50


class Conflict(RuntimeError):
    """Another writer has changed what this change was made from, again and again."""


class VersionLog:
    """Numbered JSON documents in a folder of any Hadoop file system, each published by one writer."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.jvm = spark, folder, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(folder).getFileSystem(self.conf)
        self.fs.mkdirs(self._path(folder))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _name(self, version: int) -> str:
        return f"{self.folder}/v-{version:012d}.json"

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self.fs.listStatus(self._path(self.folder)))
        return sorted(int(n[2:-5]) for n in names if n.startswith("v-") and n.endswith(".json"))

    def latest(self) -> int:
        return max(self.versions(), default=0)

    def read(self, version: int) -> dict:
        stream = self.fs.open(self._path(self._name(version)))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, version: int, value: dict) -> bool:
        """Whether this call has published the version; false if it exists."""
        draft, final = self._path(f"{self.folder}/_draft-{uuid.uuid4().hex}"), self._path(self._name(version))
        out = self.fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(value).encode()))
            out.hsync()
        finally:
            out.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                os.link(self.fs.makeQualified(draft).toUri().getPath(), self.fs.makeQualified(final).toUri().getPath())
                return True
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
            none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            context.rename(draft, final, none)
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            if self.fs.exists(draft):
                self.fs.delete(draft, False)

    def drop(self, version: int) -> None:
        self.fs.delete(self._path(self._name(version)), False)


class SnapshotTable:
    """A table of rows with a time, cut into units (hours or days) that changes replace as wholes."""

    def __init__(self, spark: SparkSession, path: str, time_column: str = "created_at", unit: str = "hour"):
        self.spark, self.path, self.time, self.unit = spark, path, time_column, unit
        self.log = VersionLog(spark, f"{path}/manifests")

    # Reading

    def manifest(self, version: int | None = None) -> dict:
        version = self.log.latest() if version is None else version
        return self.log.read(version) if version else {"schema": None, "units": {}, "transactions": {}, "pending": []}

    def _of(self, time: Column) -> Column:
        return F.coalesce(F.date_format(time, UNITS[self.unit]), F.lit("null"))

    def read(self, units: list[str] | None = None, version: int | None = None, manifest: dict | None = None) -> DataFrame:
        """The rows of a version (the newest by default), or of some of its units."""
        manifest = manifest or self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError(f"{self.path} has no rows and no schema yet")
        schema = T.StructType.fromJson(manifest["schema"])
        wanted = manifest["units"] if units is None else [u for u in units if u in manifest["units"]]
        paths = [f"{self.path}/data/{folder}/{UNIT}={u}" for u in sorted(wanted) for folder in manifest["units"][u]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def between(self, start: str, end: str) -> DataFrame:
        """Rows with start <= time < end; units outside are not opened."""
        first, last = (x[:13].replace(" ", "-") if self.unit == "hour" else x[:10] for x in (start, end))
        manifest = self.manifest()
        rows = self.read([u for u in manifest["units"] if first <= u <= last], manifest=manifest)
        return rows.where((F.col(self.time) >= F.lit(start).cast("timestamp_ntz")) & (F.col(self.time) < F.lit(end).cast("timestamp_ntz")))

    # Changing

    def _write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """A new data folder with the rows by unit, and the units in it."""
        folder = uuid.uuid4().hex
        path = self.log._path(f"{self.path}/data/{folder}")
        rows.withColumn(UNIT, self._of(F.col(self.time))).sortWithinPartitions(UNIT, self.time).write.partitionBy(UNIT).parquet(path.toString())
        names = [s.getPath().getName() for s in self.log.fs.listStatus(path)]
        return folder, [n.removeprefix(f"{UNIT}=") for n in names if n.startswith(f"{UNIT}=")]

    def _done(self, manifest: dict, transaction: tuple[str, int] | None) -> bool:
        return transaction is not None and manifest["transactions"].get(transaction[0], -1) >= transaction[1]

    def _commit(self, change: Callable[[dict], dict | None], transaction: tuple[str, int] | None = None) -> bool:
        """Publish what `change` makes of the newest manifest. False if the transaction was applied before; change gives None to begin anew."""
        for _ in range(TRIES):
            version = self.log.latest()
            manifest = self.manifest(version)
            if self._done(manifest, transaction):
                return False
            new = change(json.loads(json.dumps(manifest)))
            if new is None:
                raise Conflict(self.path)
            if transaction:
                new["transactions"][transaction[0]] = transaction[1]
            if self.log.publish(version + 1, new):
                return True
        raise Conflict(self.path)

    def _again(self, attempt: Callable[[], object]):
        for _ in range(TRIES):
            try:
                return attempt()
            except Conflict:
                continue
        raise Conflict(self.path)

    def append(self, rows: DataFrame, transaction: tuple[str, int] | None = None, unique: str | None = None) -> bool:
        """Add rows. With `unique`, a row whose key stands in its unit already, or came before it among the rows, is left out."""

        def attempt() -> bool:
            base = self.manifest()
            if self._done(base, transaction):
                return False
            new = rows
            if unique:
                new = new.dropDuplicates([unique])
                touched = [r[0] for r in rows.select(self._of(F.col(self.time))).distinct().collect()] if base["schema"] else []  # units of one change
                there = [u for u in touched if u in base["units"]]
                if there:
                    new = new.join(self.read(there, manifest=base).select(unique), unique, "left_anti").select(*rows.columns)
            folder, units = self._write(new)

            def change(now: dict) -> dict | None:
                if unique and any(now["units"].get(u) != base["units"].get(u) for u in units):
                    return None  # what was read is not what stands there any more
                for u in units:
                    now["units"].setdefault(u, []).append(folder)
                now["schema"] = now["schema"] or rows.schema.jsonValue()
                return now

            return self._commit(change, transaction)

        return self._again(attempt)

    def _replace(self, base: dict, rows: DataFrame, units: list[str], transaction: tuple[str, int] | None = None, pending: list[str] | None = None) -> bool:
        folder, written = self._write(rows)
        touched = sorted({*units, *written})

        def change(now: dict) -> dict | None:
            if any(now["units"].get(u) != base["units"].get(u) for u in touched):
                return None
            for u in touched:
                now["units"].pop(u, None)
                if u in written:
                    now["units"][u] = [folder]
            now["schema"] = now["schema"] or rows.schema.jsonValue()
            now["pending"] = sorted({*now["pending"], *(pending or [])})
            return now

        return self._commit(change, transaction)

    def replace(self, rows: DataFrame, units: list[str] = (), transaction: tuple[str, int] | None = None) -> bool:
        """The units that rows hold, and those named, hold these rows and no others from now on."""
        return self._again(lambda: self._replace(self.manifest(), rows, list(units), transaction))

    def merge(self, rows: DataFrame, key: str, transaction: tuple[str, int] | None = None) -> bool:
        """Upsert by key, of which the time is a function: equal keys are replaced, others stay."""

        def attempt() -> bool:
            base = self.manifest()
            if self._done(base, transaction):
                return False
            units = [r[0] for r in rows.select(self._of(F.col(self.time))).distinct().collect()]  # units of one change
            there = [u for u in units if u in base["units"]]
            both = self.read(there, manifest=base).join(rows.select(key), key, "left_anti").select(*rows.columns).unionByName(rows) if there else rows
            return self._replace(base, both, units, transaction)

        return self._again(attempt)

    def delete_where(self, condition: Column, note: Callable[[str], str] | None = None) -> int:
        """Delete the rows that match; only units with such rows are written anew. `note` turns a touched unit into a pending one."""

        def attempt() -> int:
            base = self.manifest()
            rows = self.read(manifest=base)
            matched = F.coalesce(condition, F.lit(False))
            counts = rows.where(matched).groupBy(self._of(F.col(self.time)).alias("u")).count().collect()  # a row for each unit
            units = [r.u for r in counts]
            if units:
                self._replace(base, self.read(units, manifest=base).where(~matched), units, pending=[note(u) for u in units] if note else None)
            return sum(r["count"] for r in counts)

        return self._again(attempt)

    def drop_before(self, cutoff: str) -> int:
        """Drop whole units before the one that cutoff (yyyy-MM-dd HH...) falls in; how many. No data is read."""
        last = cutoff[:13].replace(" ", "-") if self.unit == "hour" else cutoff[:10]
        dropped: list[str] = []

        def change(now: dict) -> dict:
            dropped[:] = [u for u in now["units"] if u < last]
            for u in dropped:
                del now["units"][u]
            return now

        self._commit(change)
        return len(dropped)

    def settle(self, units: list[str]) -> None:
        """Take units off the pending ones."""

        def change(now: dict) -> dict:
            now["pending"] = [u for u in now["pending"] if u not in units]
            return now

        self._commit(change)

    def vacuum(self, keep: int = 1) -> int:
        """Delete data that none of the newest `keep` manifests names, and older manifests. Not while a writer is at work."""
        versions = self.log.versions()
        named = {(folder, u) for v in versions[-keep:] for u, folders in self.manifest(v)["units"].items() for folder in folders}
        fs, root, gone = self.log.fs, self.log._path(f"{self.path}/data"), 0
        for folder in fs.listStatus(root) if fs.exists(root) else []:
            name = folder.getPath().getName()
            if not any(f == name for f, _ in named):
                gone += fs.delete(folder.getPath(), True)
                continue
            for unit in fs.listStatus(folder.getPath()):
                u = unit.getPath().getName()
                if u.startswith(f"{UNIT}=") and (name, u.removeprefix(f"{UNIT}=")) not in named:
                    gone += fs.delete(unit.getPath(), True)
        for v in versions[:-keep]:
            self.log.drop(v)
        return gone


def retire_hours(log: SnapshotTable, rollup: SnapshotTable, cutoff: str, make_rollup: Callable[[DataFrame], DataFrame]) -> int:
    """Retention of a log by hour: the rollup of the hours to go is made first, then they are dropped; how many.

    A crash between leaves a rollup that is right and hours that the next call drops.
    """
    if log.unit != "hour":
        raise ValueError("retention by hour needs a log by hour")
    manifest = log.manifest()
    old = [u for u in manifest["units"] if u < cutoff[:13].replace(" ", "-")]
    if not old:
        return 0
    rollup.merge(make_rollup(log.read(old, manifest=manifest)), "bucket_start")
    return log.drop_before(cutoff)


def remove_rows(log: SnapshotTable, rollup: SnapshotTable, condition: Column, make_rollup: Callable[[DataFrame], DataFrame]) -> int:
    """Delete log rows that match and make the rollup of their days anew; the number of deleted rows.

    The days stand as pending in the manifest that deletes the rows, until their rollup is made; a call after a
    crash makes it first. The rollup is one by day.
    """
    deleted = log.delete_where(condition, note=lambda unit: unit[:10])
    manifest = log.manifest()
    if days := manifest["pending"]:
        rows = log.read([u for u in manifest["units"] if u[:10] in set(days)], manifest=manifest)
        rollup.replace(make_rollup(rows), days)
        log.settle(days)
    return deleted
