"""SimHash near-dedup with a generalised pigeonhole join.

Fingerprints have 64 bits. Two fingerprints link if they differ in at most `radius` bits. The 64 bits are
grouped into parts of correlated bits, and a dynamic program over estimated candidate counts gives every
part a threshold t (-1: never looked at) with sum(t + 1) = radius + 1. Two fingerprints within the radius
are then within t of one another in some part, so probing every part's ball of radius t finds each link;
candidates are verified on all 64 bits.

Equal fingerprints are one row of the join. Rows and probes of a bucket meet in one task (a bucket of
more than TILE rows in several, each with a tile of its rows), where pairs that one component holds
already are left out and only a spanning forest of the links goes on. So what leaves a task is linear in
what it reads, however dense a bucket is, and no link between different components is lost.

`simhash_dedup` links fingerprints over shingles, as they are. `near_copies` takes fingerprints over
words as candidates only: within a component of candidates, texts link if their sets of word shingles
are similar enough, which is computed on the whole sets (hashed to 32 bits a shingle).

Defined results: null and empty texts have fingerprint zero and link like any other (`near_copies`: texts
without a word are never similar); a text with fewer words than a shingle has one shingle; very long texts
are read whole, a chunk of hashes at a time; null doc_ids come last in the choice of component_id, which is
null if nothing else is in the component; repeated rows stay rows, in one component; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.llm.common import Words, connected_components, cut, forest, gathered, mix64, small_side, text_bytes, text_chunks

SEED, BITS = 42, 64
#: What a probe costs beside a candidate: it is shuffled, a candidate is compared in place.
PROBE_COST = 4.0
#: Buckets with more rows are searched by leaders, not in all pairs; with more than TILE they are dealt to several tasks.
DENSE, TILE = 64, 8192
#: Rows that a task takes up at once, and pairs that one numpy step compares.
CHUNK_ROWS, PAIRS = 1 << 18, 1 << 21
#: near_copies: fingerprints of a text, and of one with fewer than FEW_WORDS distinct words, whose fingerprints an edit moves further.
SEEDS, SEEDS_OF_FEW, FEW_WORDS = 2, 6, 64
#: Shingles of a component that one task compares, and rows that every task of a larger component sees first.
TILE_SHINGLES, HUBS = 1 << 21, 8


def fingerprint(text: str | None, shingle: int) -> int:
    """A bit is 1 if set in over half of the shingles' XXH64 (UTF-8, seed 42), repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    return majority(shingle_hashes(words, shingle))


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    n = len(words) - k + 1
    pieces = map(joined.__getitem__, map(slice, starts[:n].tolist(), ends[k - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def word_fingerprints(text: str | None) -> list[int]:
    """SimHashes of the distinct words under one seed after the other.

    An edit changes one word but as many shingles as it has words, so texts whose five-word shingles are 0.8
    similar differ in about four bits here and in about ten of a fingerprint over shingles.
    """
    distinct = set((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not distinct:
        return []
    seeds = range(SEED, SEED + (SEEDS_OF_FEW if len(distinct) < FEW_WORDS else SEEDS))
    return [majority(np.fromiter(map(xxhash.xxh64_intdigest, distinct, repeat(s)), np.uint64, len(distinct))) for s in seeds]


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp: long) of each row; the fingerprint's 64 bits are those of the signed fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            found = [fingerprint(x, shingle) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and in how many of them each pair of bits is set, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 14):
                values = np.asarray(batch.column(0).slice(i, 1 << 14)).view(np.uint64)
                bits = np.unpackbits(values.byteswap().view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
                total += bits.T @ bits
                n += len(values)
        cells = np.concatenate([total.ravel(), [n]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells)], names=["cell", "n"])

    cells = np.zeros(BITS * BITS + 1, np.int64)
    for row in fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").sum("n").collect():  # 4,097 rows
        cells[row[0]] = row[1]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS).astype(float)


def group_bits(n: int, together: np.ndarray, parts: int) -> tuple[list[list[int]], list[list[float]]]:
    """Parts of about equal size, each grown by the bit most correlated with it, and for each bit the
    chance that two fingerprints agree in it if they agree in the part's closest earlier bit."""
    n = max(n, 1)
    p = np.diag(together) / n
    cov = together / n - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    agree = p**2 + (1 - p) ** 2
    pair = together / n
    both = pair**2 + (p[:, None] - pair) ** 2 + (p[None, :] - pair) ** 2 + (1 - p[:, None] - p[None, :] + pair) ** 2
    free, groups, chances = set(range(BITS)), [], []
    for k in range(parts):
        own: list[int] = []
        chance: list[float] = []
        while len(own) < BITS * (k + 1) // parts - BITS * k // parts:
            score = (lambda b: corr[b, own].mean()) if own else (lambda b: corr[b, sorted(free)].sum())
            bit = max(sorted(free), key=score)
            near = max(own, key=lambda b: corr[bit, b]) if own else None
            chance.append(float(agree[bit] if near is None else min(1.0, both[bit, near] / max(agree[near], 1e-9))))
            own.append(bit)
            free.remove(bit)
        groups.append(own)
        chances.append(chance)
    return groups, chances


def allocate(n: int, chances: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost for a probing fingerprint, by dynamic programming over the parts."""
    costs = []
    for chance in chances:
        differ = np.zeros(radius + 2)  # chance that two fingerprints differ in exactly so many of the part's bits
        differ[0] = 1.0
        for c in chance:
            differ[1:] = differ[1:] * c + differ[:-1] * (1 - c)
            differ[0] *= c
        costs.append([0.0, *(sum(comb(len(chance), d) for d in range(t + 1)) * PROBE_COST + n * differ[: t + 1].sum() for t in range(radius + 1))])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t, c in enumerate(cost):  # t stands for the threshold t - 1
                if used + t <= radius + 1 and (used + t not in new or total + c < new[used + t][0]):
                    new[used + t] = total + c, [*chosen, t - 1]
        best = new
    return best[radius + 1]


def pigeonhole(n: int, together: np.ndarray, radius: int) -> list[tuple[int, list[int]]]:
    """(bit mask, masks of the ball to probe) of each part with a threshold of 0 or more."""
    plans = []
    for parts in range(2, radius + 2):
        groups, chances = group_bits(n, together, parts)
        cost, thresholds = allocate(n, chances, radius)
        plans.append((cost, groups, thresholds))
    _, groups, thresholds = min(plans, key=lambda x: x[0])
    signed = lambda bits: int(np.uint64(sum(1 << b for b in bits)).view(np.int64))
    return [(signed(g), [signed(c) for d in range(t + 1) for c in combinations(g, d)]) for g, t in zip(groups, thresholds, strict=True) if t >= 0]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, probe, fp, c) of a task's rows, sorted by key and rows before probes, in pieces.

    A piece that ends inside a bucket hands the bucket's rows on to the next one.
    """
    held: tuple[np.ndarray, ...] | None = None
    for batch in gathered(batches, CHUNK_ROWS):
        key, probe, fp, c = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
        piece = key, probe, fp.view(np.uint64), c
        if held is not None:
            piece = tuple(np.concatenate(x) for x in zip(held, piece, strict=True))
        yield piece
        key, probe, *_ = piece
        open_ = np.flatnonzero((key == key[-1]) & ~probe)
        held = tuple(x[open_] for x in piece)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return starts, np.diff(np.append(starts, len(key)))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges starts[i] ... starts[i] + counts[i] - 1, one after another."""
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(starts - before, counts)


class _Links:
    """Links of a task, kept down to a forest."""

    def __init__(self):
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.n = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.n += len(a)
        if self.n > 1 << 20:
            self.shrink()

    def shrink(self) -> None:
        a, b = forest(np.concatenate(self.a or [np.zeros(0, np.int64)]), np.concatenate(self.b or [np.zeros(0, np.int64)]))
        self.a, self.b, self.n = [a], [b], len(a)

    def batch(self) -> pa.RecordBatch:
        self.shrink()
        return pa.RecordBatch.from_arrays([pa.array(self.a[0], pa.int64()), pa.array(self.b[0], pa.int64())], names=["a", "b"])


def _by_leaders(near, n: int):
    """Links among n items: near(i) is one item's mask of all it links with.

    Items become leaders until all others are in one component, so a group of near copies takes few
    leaders and every pair of different components has had one as a leader.
    """
    component, waiting = np.arange(n), np.ones(n, bool)
    while True:
        largest = np.bincount(component, minlength=n).argmax()
        outside = waiting & (component != largest)
        if not outside.any():
            return component
        i = int(outside.argmax())
        waiting[i] = False
        hit = np.unique(component[near(i)])
        component[np.isin(component, hit)] = component[i]


def _inside_buckets(radius: int):
    """Links among the rows of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, fp, node in _chunks(batches):
            links = _Links()
            starts, sizes = _groups(key)
            small = (sizes > 1) & (sizes <= DENSE)
            _compare(links, fp, node, starts[small], sizes[small], starts[small], sizes[small], radius)
            for at, size in zip(starts[sizes > DENSE].tolist(), sizes[sizes > DENSE].tolist(), strict=True):
                own, names = fp[at : at + size], node[at : at + size]
                component = _by_leaders(lambda i, own=own: np.bitwise_count(own ^ own[i]) <= radius, size)
                links.add(names, names[component])
            yield links.batch()

    return run


def _compare(links: _Links, fp, c, row_start, rows, probe_start, probes, radius: int) -> None:
    """Links between the rows and the probes of many small buckets, as many buckets at once as PAIRS allows."""
    pairs = np.cumsum(rows * probes)
    at = 0
    while at < len(pairs):
        to = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + PAIRS, side="right")))
        own_rows = np.repeat(rows[at:to], probes[at:to])
        i = np.repeat(_spread(probe_start[at:to], probes[at:to]), own_rows)
        j = _spread(np.repeat(row_start[at:to], probes[at:to]), own_rows)
        hit = (np.bitwise_count(fp[i] ^ fp[j]) <= radius) & (c[i] != c[j])
        links.add(c[i[hit]], c[j[hit]])
        at = to


def _rows_and_probes(radius: int):
    """Links between rows and probes of a bucket that are in different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, probe, fp, c in _chunks(batches):
            links = _Links()
            starts, sizes = _groups(key)
            rows = np.add.reduceat((~probe).astype(np.int64), starts)
            probes = sizes - rows
            live = (rows > 0) & (probes > 0) & (np.minimum.reduceat(c, starts) != np.maximum.reduceat(c, starts))
            small = live & (rows * probes <= PAIRS)
            _compare(links, fp, c, starts[small], rows[small], starts[small] + rows[small], probes[small], radius)
            for g in np.flatnonzero(live & ~small).tolist():
                row, other = slice(starts[g], starts[g] + rows[g]), slice(starts[g] + rows[g], starts[g] + sizes[g])
                names, counts = np.unique(c[row], return_counts=True)
                top = names[counts.argmax()]
                # Rows of the largest component need not meet probes of the same.
                inside = c[other] == top
                for x, y in ((np.flatnonzero(inside), np.flatnonzero(c[row] != top)), (np.flatnonzero(~inside), np.arange(rows[g]))):
                    for i in range(0, len(x), step := max(1, PAIRS // max(1, len(y)))):
                        p = other.start + x[i : i + step]
                        hit = (np.bitwise_count(fp[p][:, None] ^ fp[row][y]) <= radius) & (c[p][:, None] != c[row][y])
                        a, b = np.nonzero(hit)
                        links.add(c[p[a]], c[row][y[b]])
            yield links.batch()

    return run


def _sorted_by_key(df: DataFrame, kernel) -> DataFrame:
    return df.repartition(F.col("key")).sortWithinPartitions("key", "probe").mapInArrow(kernel, "a long, b long")


def linked_nodes(entries: DataFrame, radius: int, same: DataFrame | None = None) -> DataFrame:
    """(node, component) of the nodes that links join, from distinct (seed, fp, node: longs); only equal seeds meet.

    `same` (a, b: nodes) are links known before.
    """
    parts = pigeonhole(*bit_counts(entries), radius)
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, (m, _) in enumerate(parts))))
    index = lambda df, name: df.select("seed", "fp", F.col(name).alias("c"), keys.alias("k")).select("seed", "k.part", "k.v", "fp", "c")
    rows = index(entries, "node")
    big = cut(rows.groupBy("seed", "part", "v").count().where(F.col("count") > TILE).select("seed", "part", "v", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")))
    n_big = big.count()

    def in_own_tile(df: DataFrame) -> DataFrame:
        if not n_big:
            return df.withColumn("tile", F.lit(0))
        tiles = df.join(small_side(big, n_big), ["seed", "part", "v"], "left")
        return tiles.withColumn("tile", F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1))).cast("int")).drop("tiles")

    def in_all_tiles(df: DataFrame) -> DataFrame:
        if not n_big:
            return df.withColumn("tile", F.lit(0))
        few = small_side(big, n_big)
        many = df.join(few, ["seed", "part", "v"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
        return df.join(few, ["seed", "part", "v"], "left_anti").withColumn("tile", F.lit(0)).unionByName(many)

    hashed = lambda df, probe: df.select(F.xxhash64("seed", "part", "v", "tile").alias("key"), F.lit(probe).alias("probe"), "fp", "c")

    links = _sorted_by_key(hashed(in_own_tile(rows), False), _inside_buckets(radius))
    first = connected_components(links if same is None else links.union(same))
    known = cut(entries.join(first, "node", "left").select("seed", "fp", F.coalesce("component", "node").alias("c")))

    balls = F.when(F.lit(False), F.array().cast("array<long>"))
    for i, (_, masks) in enumerate(parts):
        balls = balls.when(F.col("part") == i, F.array(*map(F.lit, masks)))
    rows = index(known, "c")
    probes = rows.select("seed", "part", F.explode(F.transform(balls, lambda m: F.col("v").bitwiseXOR(m))).alias("v"), "fp", "c")
    meeting = hashed(in_own_tile(rows), False).union(hashed(in_all_tiles(probes), True))
    second = connected_components(_sorted_by_key(meeting, _rows_and_probes(radius)))
    # `first` names every linked node's component, `second` what became of such components and of lone nodes.
    second = second.select(F.col("node").alias("c"), F.col("component").alias("joined"))
    alone = second.join(first.select(F.col("component").alias("c")).distinct(), "c", "left_anti").select(F.col("c").alias("node"), F.col("joined").alias("component"))
    return first.select("node", F.col("component").alias("c")).join(second, "c", "left").select("node", F.coalesce("joined", "c").alias("component")).union(alone)


def link_components(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, component) for distinct fingerprints fp: those that chains of links join have one component."""
    linked = linked_nodes(fps.select(F.lit(0).alias("seed"), "fp", F.col("fp").alias("node")), radius)
    return fps.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"))


def simhash_dedup(docs: DataFrame, shingle: int = 5, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id is the smallest doc_id reachable by links."""
    rows = cut(fingerprints(docs, shingle))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    components = distinct.join(link_components(distinct.select("fp"), radius), "fp")
    least = components.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(components.join(least, "component").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """texts (text and columns c, kind: as given) with `hashes`, the text's distinct shingles, instead of text."""
    kept = [f for f in texts.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            words = Words(batch.column("text"), spaced=True)
            runs, at = words.rolling(shingle)
            first = words.first()
            cuts = np.searchsorted(at, first)
            sets = []
            for i in range(batch.num_rows):
                own = runs[cuts[i] : cuts[i + 1]]
                if not len(own) and first[i] < first[i + 1]:  # fewer words than a shingle
                    own = np.bitwise_xor.reduce(mix64(words.hash[first[i] : first[i + 1]] + np.arange(first[i + 1] - first[i], dtype=np.uint64)), keepdims=True)
                sets.append(np.unique((own >> np.uint64(32)).astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(sets, pa.binary())], names=[*(f.name for f in kept), "hashes"])

    return texts.select(*(f.name for f in kept), "text").mapInArrow(run, T.StructType([*kept, T.StructField("hashes", T.BinaryType())]))


class Sets:
    """Sets of hashes with an inverted index over them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint32)
        order = np.argsort(every, kind="stable")
        self.items = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.names, self.starts = np.unique(every[order], return_index=True)
        self.counts = np.diff(np.append(self.starts, len(every)))

    def similar(self, own: np.ndarray, least: float) -> np.ndarray:
        """Mask of the sets whose Jaccard similarity to `own` is at least `least`."""
        if not len(own) or not len(self.names):
            return np.zeros(len(self.sizes), bool)
        at = np.minimum(np.searchsorted(self.names, own), len(self.names) - 1)
        at = at[self.names[at] == own]
        both = np.bincount(self.items[_spread(self.starts[at], self.counts[at])], minlength=len(self.sizes))
        return (both > 0) & (both >= least * (self.sizes + len(own) - both) - 1e-9)


def _similar_links(least: float):
    """Links (a, b: rows) between similar sets of a group, from (key, probe, row, c, hashes), sorted by key and probe.

    Rows of a group are compared with one another, and probes with the rows that are not in their component c.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, key, held = _Links(), None, None
        rows: list[int] = []
        components: list[int] = []
        sets: list[np.ndarray] = []

        def close() -> None:
            if held is None and len(rows) > 1:  # rows that meet probes have met one another before
                index, names = Sets(sets), np.array(rows)
                links.add(names, names[_by_leaders(lambda i: index.similar(sets[i], least), len(rows))])

        for batch in batches:
            for k, probe, row, c, raw in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if k != key:
                    close()
                    key, held = k, None
                    rows, components, sets = [], [], []
                own = np.frombuffer(raw, np.uint32)
                if not probe:
                    rows.append(row)
                    components.append(c)
                    sets.append(own)
                    continue
                held = held or Sets(sets)
                hit = np.flatnonzero(held.similar(own, least) & (np.array(components, np.int64) != c))
                if len(hit):
                    links.add(np.full(len(hit), row), np.array(rows)[hit])
        close()
        yield links.batch()

    return run


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 6) -> DataFrame:
    """(row, near_id) of each row that has a near copy, from docs with a unique long `row`, `doc_id` and `text`.

    Near copies have Jaccard similarity of their shingles of at least `similarity`; chains of them are one group,
    as far as word fingerprints within `radius` bits, or chains of those, bring them together. near_id is the row
    that stays: the one with the smallest doc_id, of equal ones the smallest row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            found = [[f - (f >> 63 << 64) for f in word_fingerprints(x)] for x in batch.column("text").to_pylist()]
            _, ends = text_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(np.diff(ends, prepend=0)), pa.array(found, pa.list_(pa.int64()))], names=["row", "doc_id", "bytes", "fps"])

    made = cut(docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, bytes long, fps array<long>"))
    told = made.select("row", F.posexplode("fps").alias("seed", "fp"))
    entries = cut(told.groupBy("seed", "fp").agg(F.min("row").alias("node")))
    same = told.join(entries, ["seed", "fp"]).where("row <> node").select(F.col("row").alias("a"), F.col("node").alias("b"))
    candidates = cut(linked_nodes(entries, radius, same))
    # A shingle takes about six bytes of text.
    members = cut(made.join(candidates, F.col("row") == F.col("node")).select("row", "doc_id", "bytes", F.col("component").alias("cand")))
    sizes = cut(members.groupBy("cand").agg(F.ceil(F.sum("bytes") / (6 * TILE_SHINGLES)).cast("int").alias("tiles"), F.count("*").alias("n")))
    placed = cut(members.join(sizes, "cand").select("row", "doc_id", "cand", "tiles", "n", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int").alias("tile")))
    texts = docs.select("row", "text").join(small_side(placed, placed.count()), "row")
    sets = cut(shingle_sets(texts.select("row", "cand", "tiles", "n", "tile", "text"), shingle))

    def compared(df: DataFrame) -> DataFrame:
        keyed = df.select(F.xxhash64("cand", "tile").alias("key"), "probe", "row", "c", "hashes")
        return keyed.repartition(F.col("key")).sortWithinPartitions("key", "probe").mapInArrow(_similar_links(similarity), "a long, b long")

    # Each tile by itself; those of a component with several tiles also hold some rows of all others.
    hub = (F.col("tiles") > 1) & (F.pmod(F.xxhash64("row", F.lit(1)), F.ceil(F.col("n") / HUBS)) == 0)
    tile = F.explode(F.when(hub, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("tile"))).alias("tile")
    first = cut(compared(sets.select("row", "cand", tile, F.lit(False).alias("probe"), F.col("row").alias("c"), "hashes")))
    several = sizes.where("tiles > 1")
    if several.isEmpty():
        groups = connected_components(first)
    else:
        # Then all rows that are not in a component's largest group meet the rows of every tile.
        groups = connected_components(first)
        known = cut(sets.where("tiles > 1").join(groups, F.col("row") == F.col("node"), "left").select("row", "cand", "tiles", "tile", F.coalesce("component", "row").alias("c")))
        counts = known.groupBy("cand", "c").count().groupBy("cand").agg(F.max_by("c", F.struct("count", "c")).alias("top"), F.count("*").alias("groups"))
        known = known.join(counts, "cand").where("groups > 1").select("row", F.col("c").alias("group"), (F.col("c") != F.col("top")).alias("outside"))
        again = sets.join(known, "row")
        rows = again.select("row", "cand", "tile", F.lit(False).alias("probe"), F.col("group").alias("c"), "hashes")
        probes = again.where("outside").select("row", "cand", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(True).alias("probe"), F.col("group").alias("c"), "hashes")
        groups = connected_components(first.union(compared(rows.union(probes))))
    ids = groups.join(placed.select("row", "doc_id"), F.col("row") == F.col("node")).select("row", "doc_id", "component")
    stays = ids.groupBy("component").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("near_id"))
    return ids.join(stays, "component").select("row", "near_id")
