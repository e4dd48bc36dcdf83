"""Exact dedup by Grace hashing: partition by content hash until a bucket fits a table, then compare contents.

Every task first merges its own equal records in a bounded open-addressing table, so that a content that
a third of all rows share leaves each task once (once more for each 400,000 ids that have it). One shuffle deals the representatives, with their whole
contents, by hash. A receiving task takes them into an open-addressing table; what exceeds the task's
memory is partitioned by further hash bits into spill files, and each file is treated likewise. Two
records are equal only if their complete contents are; of equal ones a table holds one record, the
smallest id and a count, however many there are. What stays is told to the senders' keys by a join of
small rows on the content's hash, and from there to the members by a join on the sender's key, which holds
one task's rows at most.

Content: the text with each run of [\x20\x09-\x0D] replaced by one space; null counts as empty.

Defined results: the smallest doc_id stays, null ids last; repeated rows of a doc_id are rows like any
others, all but one of them marked as dropped; other columns pass through `survivors` unchanged,
whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weirgate.llm.common import cut, text_chunks

#: Bytes of content that a task's table holds before it hands on (sender) or spills (receiver).
SEND_BYTES, TABLE_BYTES = 16 << 20, 64 << 20
#: What an id in a sender's list takes.
ID_BYTES = 40
FAN_OUT = 8
#: doc_ids in a row that tells which records a sender has merged.
MEMBERS = 4096


def normalised(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    middle = b" ".join(raw.split())  # bytes.split() knows the six ASCII space characters only
    if not middle:
        return b" " if raw else b""
    return b" " * raw[:1].isspace() + middle + b" " * raw[-1:].isspace()


def content_hash(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little")


class ContentTable:
    """Open addressing with linear probing; entry numbers are in `slots`, equality is that of whole contents."""

    def __init__(self):
        self.slots = np.full(1 << 10, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.contents)

    def find(self, h: int, content: bytes) -> tuple[int, int]:
        """The entry of this content or -1, and its slot or the one it would take."""
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := int(self.slots[at])) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                break
            at = (at + 1) & mask
        return entry, at

    def find_or_add(self, h: int, content: bytes) -> tuple[int, bool]:
        """The entry of this content, and whether it is new."""
        if 2 * len(self.contents) >= len(self.slots):
            self._grow()
        entry, at = self.find(h, content)
        if entry >= 0:
            return entry, False
        self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 200
        return len(self.contents) - 1, True

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def both(a: list, b: list) -> list:
    a += b
    return a


def grace(records: Iterator[tuple[int, bytes, tuple]], most: int, level: int = 0, one: Callable = lambda x: [x], fold: Callable = both) -> Iterator:
    """What `fold` makes of the payloads of equal contents (`one` of each), from (hash, content, payload) in any order.

    By default these are lists of the payloads; where contents are hot, `fold` gives something of bounded size.

    Once a table is full, contents that it knows still join it and all others are spilled by the next
    three bits of their hash; each spill file then goes through a table of its own. At the last bits the
    table takes what remains.
    """
    table, groups, spills = ContentTable(), [], None
    for h, content, payload in records:
        if spills is None and (table.bytes < most or level > 18):
            entry, new = table.find_or_add(h, content)
            if new:
                groups.append(one(payload))
            else:
                groups[entry] = fold(groups[entry], one(payload))
            continue
        if spills is None:
            spills = [tempfile.TemporaryFile() for _ in range(FAN_OUT)]
        entry, _ = table.find(h, content)
        if entry >= 0:
            groups[entry] = fold(groups[entry], one(payload))
        else:
            pickle.dump((h, content, payload), spills[(h >> (61 - 3 * level)) % FAN_OUT], protocol=5)
    yield from groups
    del table, groups
    for file in spills or ():
        file.seek(0)
        yield from grace(unpickled(file), most, level + 1, one, fold)
        file.close()


def unpickled(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _order(doc_id: int | None) -> tuple[bool, int]:
    return doc_id is None, doc_id or 0


def _sender(record: pa.StructType, tell: bool):
    """One row for each distinct content of a task, and, if `tell`, rows with the doc_ids that have it.

    A content is known by (task, mark) until the receivers have decided. `bucket` deals the contents by
    hash and the rows of doc_ids evenly; `rows` counts a content's records, or the doc_ids told before.
    """
    schema = pa.schema([("bucket", pa.int64()), ("task", pa.int32()), ("mark", pa.binary()), ("rows", pa.int64()), ("members", pa.list_(pa.int64())), ("record", record)])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, flushes = TaskContext.get().partitionId(), 0
        table, kept, ids, n_ids = ContentTable(), [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            size = 0
            for entry, content in enumerate(table.contents):
                mark = hashlib.sha256(content).digest() + flushes.to_bytes(4, "little")
                h = table.hashes[entry]
                rows.append((h - (h >> 63 << 64), task, mark, len(ids[entry]), None, kept[entry]))
                own = sorted(ids[entry], key=_order) if tell else []
                for i in range(0, len(own), MEMBERS):
                    rows.append((int.from_bytes(mark[:6], "little") + 31 * task + i, task, mark, i, own[i : i + MEMBERS], None))
                size += len(content)
                if size > 4 << 20 or len(rows) > 8192:
                    yield _batch(rows, schema)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, schema)

        for batch in text_chunks(batches, "text"):
            for row in batch.to_pylist():
                content = normalised(row["text"])
                entry, new = table.find_or_add(content_hash(content), content)
                if new:
                    kept.append(row)
                    ids.append([row["doc_id"]])
                else:
                    ids[entry].append(row["doc_id"])
                    n_ids += 1
                    if _order(row["doc_id"]) < _order(kept[entry]["doc_id"]):
                        kept[entry] = row
                if table.bytes + ID_BYTES * n_ids > SEND_BYTES:
                    yield from flush()
                    flushes += 1
                    table, kept, ids, n_ids = ContentTable(), [], [], 0
        yield from flush()

    return send


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _kept(batches: Iterator[pa.RecordBatch], wanted: Callable[[dict], tuple]) -> Iterator[tuple]:
    """(order, what is wanted of the record that stays, records in all) of each content."""

    def records() -> Iterator[tuple[int, bytes, tuple]]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                for x in batch.slice(i, 1000).to_pylist():
                    content = normalised(x["record"]["text"])
                    yield content_hash(content), content, ((_order(x["record"]["doc_id"]), x["task"], x["mark"]), wanted(x), x["rows"])

    def smaller(a: tuple, b: tuple) -> tuple:
        return (*min(a, b, key=lambda z: z[0])[:2], a[2] + b[2])

    return grace(records(), TABLE_BYTES, one=lambda x: x, fold=smaller)


def _survivors(record: pa.StructType):
    schema = pa.schema(list(record))

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, record, _ in _kept(batches, lambda x: x["record"]):
            held.append(record)
            size += 200 + len(held[-1]["text"] or "")
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return receive


#: Of a content: its hash and which sender's mark stays (members null); of doc_ids: their sender's key and their number.
DECISION = pa.schema([("task", pa.int32()), ("mark", pa.binary()), ("sha", pa.binary()), ("keep_id", pa.int64()), ("at", pa.int64()), ("group_size", pa.int64()), ("members", pa.list_(pa.int64()))])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What becomes of each content; the rows of doc_ids go on as they are."""
    told = tempfile.TemporaryFile()  # a bucket's ids; contents are decided only once all have been read
    writer = pa.ipc.new_stream(told, DECISION)

    def sorted_out() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.filter(batch.column("record").is_null())
            if ids.num_rows:
                marks, none = ids.column("mark"), pa.nulls(ids.num_rows, pa.int64())
                writer.write_batch(pa.RecordBatch.from_arrays([ids.column("task"), marks, pc.binary_slice(marks, 0, 32), none, ids.column("rows"), none, ids.column("members")], schema=DECISION))
            yield batch.filter(batch.column("record").is_valid())

    held: list[tuple] = []
    for (_, task, mark), keep_id, total in _kept(sorted_out(), lambda x: x["record"]["doc_id"]):
        held.append((task, mark, mark[:32], keep_id, None, total, None))
        if len(held) > 8192:
            yield _batch(held, DECISION)
            held = []
    if held:
        yield _batch(held, DECISION)
    writer.close()
    told.seek(0)
    yield from pa.ipc.open_stream(told)
    told.close()


def _dealt(docs: DataFrame, tell: bool) -> tuple[DataFrame, pa.StructType]:
    record = pa.struct(list(to_arrow_schema(docs.schema)))
    schema = T.StructType.fromDDL("bucket long, task int, mark binary, rows long, members array<long>").add("record", docs.schema)
    sent = docs.mapInArrow(_sender(record, tell), schema)
    return sent.repartition(F.col("bucket")), record


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which one stays for each content."""
    dealt, record = _dealt(docs, tell=False)
    return dealt.mapInArrow(_survivors(record), docs.schema)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs."""
    dealt, _ = _dealt(docs.select("doc_id", "text"), tell=True)
    rows = cut(dealt.mapInArrow(_decide, "task int, mark binary, sha binary, keep_id long, at long, group_size long, members array<long>"))
    decided = rows.where("members is null").select("sha", F.struct("task", "mark").alias("keeper"), "keep_id", "group_size")
    told = rows.where("members is not null")
    # One small row for each content of a sender meets the decision; a hot content has one for each time a sender handed on.
    senders = told.where("at = 0").select("task", "mark", "sha").join(decided, "sha").select("task", "mark", "keep_id", "group_size", (F.struct("task", "mark") == F.col("keeper")).alias("keeper"))
    # A sender tells of its smallest doc_id first: if its content stays, that row does, and no repetition of it.
    members = told.select("task", "mark", (F.col("at") == 0).alias("first"), F.posexplode("members").alias("i", "doc_id"))
    members = members.select("task", "mark", "doc_id", (F.col("first") & (F.col("i") == 0)).alias("keeps"))
    kept = F.col("keeper") & F.col("keeps")
    return members.join(senders, ["task", "mark"]).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex(F.substring("mark", 1, 32))).alias("text_sha256"))
