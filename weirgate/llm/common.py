"""Shared pieces: checkpoints, bounded Arrow chunks, vectorised words, connected components."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; its arrays take about 40 times as much. Larger steps are no faster.
CHUNK_BYTES = 512 << 10
#: White space of the operators' contracts: [\x20\x09-\x0D].
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; only where that is unset, as in tests, to a local folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="weirgate-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and forget how it was made."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint()


def sent(spark: SparkSession, value: object) -> Broadcast[bytes]:
    """value for all tasks; received() there. Pickled with its classes, as executors need no copy of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(broadcast: Broadcast[bytes]):
    return pickle.loads(broadcast.value)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written once as Parquet in the shared checkpoint folder and read from there, and its folder, for discard()."""
    shared_checkpoints(df.sparkSession)
    folder = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a table of stored() that nothing will read again."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_rows(df: DataFrame) -> DataFrame:
    """df, materialised, with a unique long `row` that stays the same however often it is read."""
    return cut(df.withColumn("row", F.monotonically_increasing_id()))


def small_side(df: DataFrame, n: int, most: int = 200_000) -> DataFrame:
    """Broadcast if its n rows are few enough."""
    return F.broadcast(df) if n <= most else df


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose `column` holds about `most` bytes; a longer text gets a slice of its own.

    Workers live on from task to task, so memory that a batch took is handed back after it.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another (null: none), and where each text ends."""
    binary = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(binary.buffers()[1], dtype=np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = binary.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (the constants of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> dict[str, np.ndarray]:
    word = np.zeros(256, bool)
    word[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    solid = np.ones(256, bool)
    solid[list(ASCII_SPACE)] = False
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return {"word": word, "solid": solid, "lower": lower, "letter": mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[lower]}


class Words:
    """The words of many texts: maximal runs of ASCII letters, digits and all bytes of non-ASCII characters,
    or, if `spaced`, of anything but ASCII white space.

    `row`, `start`, `end` (byte offsets in `data`) and `hash` (64 bits, blind to the case of A-Z) have an
    entry for each word; words of one text stand together.
    """

    def __init__(self, texts: pa.Array, spaced: bool = False):
        tables = _tables()
        self.data, self.text_end = text_bytes(texts)
        n = len(self.data)
        inside = tables["solid" if spaced else "word"][self.data]
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        cuts = self.text_end[:-1]
        before[cuts[cuts < n]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[cuts[(cuts > 0) & (cuts <= n)] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(self.text_end, self.start, side="right")
        # A polynomial hash: prefix sums of letter * base**i, brought to the word's start by the inverse's power.
        base, inverse = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(tables["letter"][self.data] * powers(base, n), out=sums[1:])
        self.hash = mix64((sums[self.end] - sums[self.start]) * powers(inverse, n + 1)[self.start])

    def first(self) -> np.ndarray:
        """For each text, the index of its first word; one more entry for the end."""
        return np.searchsorted(self.row, np.arange(len(self.text_end) + 1))

    def rolling(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within a text, and the index of each run's first word."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            total = total * np.uint64(0xD6E8FEB86659FD93) + self.hash[i : n - k + 1 + i]
        at = np.flatnonzero(self.row[: n - k + 1] == self.row[k - 1 :])
        return mix64(total[at]), at


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept for the next chunk."""
    if len(have := _POWERS.get(base, np.zeros(0, np.uint64))) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.cumprod(have)
    return have[:n]


def arrow_map(df: DataFrame, chunk: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str, most: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow of `chunk` over slices with at most `most` bytes of `column`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, column, most):
            if (out := chunk(part)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) over edges a-b, for nodes that are not the smallest."""
    names, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = len(names)
    low, high = np.minimum(where[: len(a)], where[len(a) :]), np.maximum(where[: len(a)], where[len(a) :])
    pairs = np.unique(low * n + high)
    pairs = pairs[pairs // max(n, 1) != pairs % max(n, 1)]
    root = list(range(n))
    for x, y in zip((pairs // max(n, 1)).tolist(), (pairs % max(n, 1)).tolist(), strict=True):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
    for x in range(n):  # a root is smaller than what it roots, so it is final already
        root[x] = root[root[x]]
    tops = np.array(root, np.int64)
    keep = tops != np.arange(n)
    return names[keep], names[tops[keep]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's edges, in pieces: each piece gives (node, smallest node of its piece)."""
    for batch in gathered(batches, 1 << 19):
        a, b = forest(*(np.asarray(batch.column(i)) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least `size` rows, but for the last one."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (a, b: long) reach, for each node that has an edge.

    Alternating large-star and small-star rounds over DataFrames. Each round first shrinks every
    partition's edges to a forest in place. Minima are aggregated before they are shuffled, and joined
    back to the edges, so that a hub's edges may be split among tasks. Loops and null ends are ignored.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut(edges.mapInArrow(_forest, "a long, b long"))
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).union(least)
        edges = cut(small.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
