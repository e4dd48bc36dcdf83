"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). The cells' weights are raked: in turn, each
marginal's cells are scaled so that its tokens have the target shares, until all marginals fit. A cell's
factor is its raked weight over its tokens. Documents are kept with probability min(1, scale * factor):
the scale is the largest at which the cells that run out of documents lack no more than SHORTAGE of the
mixture's tokens, so the kept tokens have the target mixture up to that, and no more documents go than
it takes. Whether a document is kept follows from a hash of its doc_id, so a retried task decides alike.

Targets are shares by marginal and value; a marginal without given targets aims at its values' token
shares to the power TEMPER, which lifts small sources and languages. Values without tokens, and targets
for values that do not occur, are left out and the rest is scaled to 1.

The topic is the nearest of TOPICS centroids of hashed, rarity-weighted word counts less the mean of the
document's language, so that topics are no second name of languages. Rarities come from all words of all
documents, and so do means and each round's centroids; only the first centroids are documents of a sample
of about SAMPLE chosen by a hash of doc_id. Cells are few where sources are; up to DRIVER_CELLS of them are
raked on the driver, more as DataFrames.

Where empty or tiny cells make the targets contradict one another (a topic that is one language), factors
would grow without end. The rounds therefore run without a bound first; only if they do not end, the cells
that still move beyond it are bounded, and each marginal's remaining deviation is logged as a warning.

Defined results: a null source or lang counts as ""; of topics equally near the first one counts; a text without words has no tokens and
topic 0; a cell without tokens is kept as a cell of factor 1; repeated rows of a doc_id stand or fall
together; other columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.llm.common import Words, cut, text_bytes, text_chunks

LOG = logging.getLogger(__name__)

TOPICS, TEMPER, SEED = 8, 0.7, 17
MARGINALS = ("source", "lang", "topic")
ROUNDS, TOLERANCE = 200, 1e-6
#: The factor of a cell in a contradiction stays within 1 / BOUND and BOUND, as weights are trimmed in survey raking.
BOUND = 6.0
#: Targets may take so many times ROUNDS to fit, on the driver and in rounds of joins alike.
FREE_ROUNDS = 10
#: Share of the mixture's tokens that cells kept whole may lack, and halvings that find the scale.
SHORTAGE, HALVINGS = 0.02, 40
#: More cells than that are raked without the driver.
DRIVER_CELLS = 100_000
#: Hash buckets of words that topics are made of, documents that the first centroids are chosen from, and rounds over all documents.
BUCKETS, SAMPLE, KMEANS_ROUNDS = 1 << 10, 2000, 12
#: Documents whose word counts stand side by side in memory.
ROWS = 1024
#: A vector's parts are summed as multiples of 1 / FIXED.
FIXED = 1 << 30


def counted(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(carried columns, doc_id, source, lang, n_tokens, buckets, counts): the words of each row by bucket, as bytes of uint16 and uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            words = Words(batch.column("text"))
            keys, n = np.unique(words.row * BUCKETS + bucket_of(words), return_counts=True)
            ends = np.searchsorted(keys, np.arange(batch.num_rows + 1) * BUCKETS)
            pack = lambda x: pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((ends * x.itemsize).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])  # noqa: B023, E731
            total = np.bincount(words.row, minlength=batch.num_rows)
            columns = [pa.array(total, pa.int64()), pack((keys % BUCKETS).astype(np.uint16)), pack(n.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], names=[*names, "n_tokens", "buckets", "counts"])

    names = (*carry, "doc_id", "source", "lang")
    named = docs.select(*carry, "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    kept = named.select(*names).schema.fields
    return named.mapInArrow(run, T.StructType([*kept, *T.StructType.fromDDL("n_tokens long, buckets binary, counts binary").fields]))


def bucket_of(words: Words) -> np.ndarray:
    return (words.hash >> np.uint64(40)).astype(np.int64) % BUCKETS


def unpacked(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the rows' words."""
    buckets, ends = text_bytes(part.column("buckets"))
    counts, _ = text_bytes(part.column("counts"))
    sizes = np.diff(ends, prepend=0) // 2
    return np.repeat(np.arange(part.num_rows), sizes), np.frombuffer(buckets.tobytes(), np.uint16).astype(np.int64), np.frombuffer(counts.tobytes(), np.uint32)


def features(batches: Iterator[pa.RecordBatch], rarity: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of `counted`, ROWS at a time, and their unit vectors of weighted word counts."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            row, bucket, count = unpacked(part)
            vectors = np.zeros((part.num_rows, BUCKETS))
            vectors[row, bucket] = np.sqrt(count) * rarity[bucket]
            yield part, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def bucket_rarity(rows: DataFrame) -> np.ndarray:
    """A weight for each bucket of words, less for frequent ones, from all words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            _, bucket, count = unpacked(batch)
            np.add.at(total, bucket, count.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total)], names=["bucket", "n"])

    counts = np.zeros(BUCKETS)
    for row in rows.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows
        counts[row["bucket"]] = row["n"]
    return np.log1p(counts.sum() / (counts + 1.0)) / np.sqrt(counts + 1.0)


class Topics(NamedTuple):
    """Mean vectors by language ("": all), and unit centroids of what documents have beside their language's mean."""

    means: dict[str, np.ndarray]
    centres: np.ndarray

    def residuals(self, vectors: np.ndarray, langs: list[str]) -> np.ndarray:
        rest = vectors - np.stack([self.means.get(x, self.means[""]) for x in langs])
        return rest / np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-12)

    def nearest(self, vectors: np.ndarray, langs: list[str]) -> np.ndarray:
        return (self.residuals(vectors, langs) @ self.centres.T).argmax(axis=1)


def sums(rows: DataFrame, rarity: np.ndarray, topics: Topics | None) -> dict[str, tuple[int, np.ndarray]]:
    """Number and sum of all documents' vectors by language; given topics, of their residuals by the nearest centroid.

    Vectors are summed in fixed point, so that the order of the tasks does not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for part, vectors in features(batches, rarity):
            keys = part.column("lang").to_pylist()
            if topics:
                vectors = topics.residuals(vectors, keys)
                keys = list(map(str, (vectors @ topics.centres.T).argmax(axis=1).tolist()))
            fixed = np.column_stack([np.rint(vectors * FIXED).astype(np.int64), np.ones(len(vectors), np.int64)])
            keys = np.array(keys, object)
            for key in set(keys.tolist()):
                held[key] = held.get(key, 0) + fixed[keys == key].sum(axis=0)
        for key, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(total)), pa.array(np.arange(len(total))), pa.array(total)], names=["key", "bucket", "n"])

    found: dict[str, np.ndarray] = {}
    out = rows.where("n_tokens > 0").select("lang", "buckets", "counts").mapInArrow(run, "key string, bucket long, n long")
    for row in out.groupBy("key", "bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS + 1 rows for each language or centroid
        found.setdefault(row["key"], np.zeros(BUCKETS + 1))[row["bucket"]] = row["n"]
    return {key: (int(x[-1]), x[:-1] / FIXED) for key, x in found.items()}


def learn_topics(rows: DataFrame, rarity: np.ndarray) -> Topics:
    """k-means over all documents, from centroids that are documents of a sample."""
    empty = np.zeros(BUCKETS)
    by_lang = sums(rows, rarity, None)
    if not by_lang:
        return Topics({"": empty}, empty[None])
    total = sum(n for n, _ in by_lang.values())
    means = {x: v / n for x, (n, v) in by_lang.items()} | {"": sum(v for _, v in by_lang.values()) / total}
    least = int(min(1.0, SAMPLE / total) * (1 << 31))
    some = rows.where("n_tokens > 0").select("doc_id", "lang", "buckets", "counts")
    chosen = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < least).toArrow()
    table = (chosen if len(chosen) else some.limit(TOPICS).toArrow()).sort_by("doc_id").combine_chunks()
    points = np.concatenate([Topics(means, empty[None]).residuals(v, part.column("lang").to_pylist()) for part, v in features(table.to_batches(), rarity)])
    centres = points[:: -(-len(points) // TOPICS)][:TOPICS]
    for _ in range(KMEANS_ROUNDS):
        found = sums(rows, rarity, Topics(means, centres))
        new = np.stack([found[str(k)][1] if str(k) in found else centres[k] for k in range(len(centres))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if (new == centres).all():
            break
        centres = new
    return Topics(means, centres)


def tokens(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(carried columns, doc_id, source, lang, topic, n_tokens) of each row."""
    rows = cut(counted(docs, carry))
    rarity = bucket_rarity(rows)
    topics = learn_topics(rows, rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, vectors in features(batches, rarity):
            n = part.column("n_tokens").to_numpy()
            topic = np.where(n > 0, topics.nearest(vectors, part.column("lang").to_pylist()), 0)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(topic.astype(np.int32)), part.column("n_tokens")], names=[*names, "topic", "n_tokens"])

    names = (*carry, "doc_id", "source", "lang")
    return rows.mapInArrow(run, T.StructType([*rows.select(*names).schema.fields, *T.StructType.fromDDL("topic int, n_tokens long").fields]))


def default_targets(totals: dict[str, float], temper: float = TEMPER) -> dict[str, float]:
    return {k: v**temper for k, v in totals.items() if v > 0}


def rake(cells: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Weights of cells with the target sums in each marginal. codes: each cell's value in each marginal."""
    bounded = np.zeros(len(cells), bool)
    while True:
        weights = cells.astype(float)
        for _ in range(FREE_ROUNDS * ROUNDS):
            before, off = weights, 0.0
            for code, target in zip(codes, targets, strict=True):
                have = np.bincount(code, weights=weights, minlength=len(target))
                scale = np.divide(target, have, out=np.ones(len(target)), where=have > 0)
                off = max(off, np.abs(scale[have > 0] - 1).max(initial=0.0))
                weights = weights * scale[code]
                weights = np.where(bounded, np.clip(weights, cells / BOUND, cells * BOUND), weights)
            if off < TOLERANCE:
                return weights
        # Targets that fit leave no cell moving; what still moves beyond the bound belongs to a contradiction.
        moves = np.abs(weights - before) > TOLERANCE * np.maximum(weights, before)
        more = moves & ~bounded & ((weights > cells * BOUND) | (weights < cells / BOUND))
        if not more.any():
            break
        bounded |= more
    for m, (code, target) in enumerate(zip(codes, targets, strict=True)):
        apart = np.abs(np.bincount(code, weights=weights, minlength=len(target)) - target).max(initial=0.0)
        LOG.warning("raking ends %.2g from the target shares of marginal %d; %d of %d cells are bounded", apart, m, bounded.sum(), len(cells))
    return weights


def _shares(values: list[str], totals: np.ndarray, given: dict[str, float] | None) -> np.ndarray:
    wanted = {str(k): v for k, v in given.items()} if given else default_targets(dict(zip(values, totals, strict=True)))
    share = np.array([wanted.get(v, 0.0) if t > 0 else 0.0 for v, t in zip(values, totals, strict=True)])
    return share / share.sum() if share.sum() > 0 else share


def factors(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """cells (source, lang, topic, n_tokens) with a factor: the raked share over the share of tokens."""
    targets = targets or {}
    live = cells.where("n_tokens > 0")
    if cells.count() > DRIVER_CELLS:
        return _factors_by_rounds(cells, live, targets)
    table = live.toArrow()  # at most DRIVER_CELLS rows
    n = table["n_tokens"].to_numpy().astype(float)
    codes, wanted = [], []
    for m in MARGINALS:
        values, code = np.unique(table[m].cast(pa.string()).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        codes.append(code)
        wanted.append(_shares(values.tolist(), np.bincount(code, weights=n, minlength=len(values)), targets.get(m)))
    total = max(n.sum(), 1.0)
    factor = rake(n / total, codes, wanted) / np.maximum(n / total, 1e-300)
    out = cells.sparkSession.createDataFrame(table.append_column("factor", pa.array(factor)).drop_columns("n_tokens"))
    return cells.join(F.broadcast(out), list(MARGINALS), "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))


def _factors_by_rounds(cells: DataFrame, live: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    """The same rounds with a join for each marginal, for cells that are too many for the driver."""
    spark, total = cells.sparkSession, live.agg(F.sum("n_tokens")).first()[0] or 1
    state = live.select(*MARGINALS, (F.col("n_tokens") / total).alias("n")).withColumn("w", F.col("n"))
    goals = {}
    for m in MARGINALS:
        sums = state.groupBy(m).agg(F.sum("n").alias("have"))
        if m in targets:
            given = spark.createDataFrame([(str(k), float(v)) for k, v in targets[m].items()], f"_v string, goal double")
            sums = sums.join(given, F.col(m).cast("string") == F.col("_v"), "left").select(m, F.coalesce("goal", F.lit(0.0)).alias("goal"))
        else:
            sums = sums.select(m, F.pow("have", F.lit(TEMPER)).alias("goal"))
        goals[m] = cut(sums.select(m, (F.col("goal") / (sums.agg(F.sum("goal")).first()[0] or 1.0)).alias("goal")))
    state = state.withColumn("bounded", F.lit(False))
    while True:
        worst, state = 0.0, state.withColumn("w", F.col("n"))
        for _ in range(FREE_ROUNDS * ROUNDS):
            off, state = F.lit(0.0), state.withColumn("before", F.col("w"))
            for m in MARGINALS:
                scale = state.groupBy(m).agg(F.sum("w").alias("have")).join(goals[m], m).select(m, F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(1.0).alias(f"_{m}"))
                new = F.col("w") * F.col(f"_{m}")
                state = state.join(scale, m).withColumn("w", F.when(F.col("bounded"), F.greatest(F.col("n") / BOUND, F.least(F.col("n") * BOUND, new))).otherwise(new))
                off = F.greatest(off, F.when(F.col("w") > 0, F.abs(F.col(f"_{m}") - 1)).otherwise(0.0))
            state = cut(state.select(*MARGINALS, "n", "w", "bounded", "before", off.alias("off")))
            worst = state.agg(F.max("off")).first()[0] or 0.0
            if worst < TOLERANCE:
                break
            state = state.drop("off")
        if worst < TOLERANCE:
            break
        moves = F.abs(F.col("w") - F.col("before")) > TOLERANCE * F.greatest("w", "before")
        more = moves & ~F.col("bounded") & ((F.col("w") > F.col("n") * BOUND) | (F.col("w") < F.col("n") / BOUND))
        if not state.where(more).limit(1).count():
            for m in MARGINALS:
                apart = state.groupBy(m).agg(F.sum("w").alias("have")).join(goals[m], m).agg(F.max(F.abs(F.col("have") - F.col("goal")))).first()[0]
                LOG.warning("raking ends %.2g from the target shares of marginal %s", apart or 0.0, m)
            break
        state = cut(state.select(*MARGINALS, "n", "w", (F.col("bounded") | more).alias("bounded")))
    raked = state.select(*MARGINALS, (F.col("w") / F.col("n")).alias("factor"))
    return cells.join(raked, list(MARGINALS), "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))


def scale_of(cells: DataFrame, shortage: float = SHORTAGE) -> float:
    """The largest scale at which sum(tokens * max(0, scale * factor - 1)) is at most `shortage` of sum(tokens * scale * factor)."""
    live = cells.where("n_tokens > 0 and factor > 0").select("n_tokens", "factor")
    if live.count() <= DRIVER_CELLS:
        table = live.toArrow()
        n, f = (table[c].to_numpy().astype(float) for c in ("n_tokens", "factor"))
        lacking = lambda c: float((n * np.maximum(0, c * f - 1)).sum()) > shortage * float((n * c * f).sum())
        most, least = (f.max(), f.min()) if len(f) else (1.0, 1.0)
    else:
        most, least = (x or 1.0 for x in live.agg(F.max("factor"), F.min("factor")).first())

        def lacking(c: float) -> bool:
            wanted = F.col("n_tokens") * F.col("factor") * c
            lack, total = live.agg(F.sum(F.greatest(F.lit(0.0), wanted - F.col("n_tokens"))), F.sum(wanted)).first()
            return lack > shortage * total

    low, high = 1.0 / max(most, 1e-300), 1.0 / max(least, 1e-300)
    if not lacking(high):
        return high
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        low, high = (low, middle) if lacking(middle) else (middle, high)
    return low


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, seed: int = SEED, shortage: float = SHORTAGE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, factor, probability, kept) for each row of docs, with the columns to carry."""
    rows = cut(tokens(docs, carry))
    cells = cut(rows.groupBy(*MARGINALS).agg(F.sum("n_tokens").alias("n_tokens")))
    rated = cut(factors(cells, targets).select(*MARGINALS, "n_tokens", "factor"))
    rated = rated.select(*MARGINALS, "factor", F.least(F.lit(1.0), F.col("factor") * F.lit(scale_of(rated, shortage))).alias("probability"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53))
    return rows.join(rated, list(MARGINALS)).withColumn("kept", draw < F.col("probability"))
