"""Importance resampling to a target distribution: hashed n-gram weights, noise, and a distributed radix sort.

Weights: each word run's crc32 gives a bucket; a bucket's gain is the logarithm of its share in the target over
its share in the corpus; a document's weight is the sum of the gains of its runs, looked up in one array. Added
Gumbel noise, a function of the doc_id alone, turns "the highest scores" into a draw without replacement.

Order: LSD radix sort. The key is composite (score falling, doc_id rising, both brought to unsigned numbers
that start at zero) and is read in digits of 11 bits, the lowest first. A pass is a stable counting sort: counts
by block of positions and digit, their prefix sums over (digit, block), and each row's destination, which is its
prefix plus its rank among the equal digits of its block. No pass holds more than a block of one digit together,
so a digit that most rows share is no hot key. How often each digit value occurs does not depend on the order,
so one scan counts it for all passes; digits with one value are skipped. After the last pass a row's position
is its rank. Each pass is a table in the shared folder; a lost executor costs a part of one pass.

Null texts have no words. Documents without features weigh 0. A null doc_id has the noise of "42:" and comes
last among ties. Rows that repeat a doc_id have the same noise and are ranked each on its own; where the score is
equal too, they follow one another in the order in which they were read. Very long texts are read whole. Empty tables give no
rows (an empty target: gains against no target). Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.llm.common import discard, stored, text_bytes, text_chunks

#: Words in a run at most; buckets; words that a document to be drawn has at least; percent that is drawn.
RUNS, BUCKETS, LEAST_WORDS, PERCENT = 3, 10_000, 20, 5
#: Bits of a digit, and of positions in a block.
DIGIT, BLOCK = 11, 16
#: Words up to this length step byte by byte, all at once; longer ones are rare and go one by one.
SHORT = 48
#: Bytes of text of which words are found at a time.
PIECE = 1 << 20


class Crc:
    """crc32 of many words and of runs of them, in numpy. The value of a run comes from those of its words."""

    def __init__(self):
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
        self.step = step
        zeros = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
        for _ in range(SHORT + 1):
            zeros.append(self._zero(zeros[-1]))
        #: By number of zero bytes that follow: what each byte of a value becomes.
        self.zeros = np.stack(zeros)
        doubled = [zeros[1]]
        for _ in range(40):
            doubled.append(self._apply(doubled[-1][None], np.zeros(1024, np.int64), doubled[-1].ravel()).reshape(4, 256))
        self.doubled = np.stack(doubled)
        self.blank = np.uint32(zlib.crc32(b" "))

    def _zero(self, x: np.ndarray) -> np.ndarray:
        return self.step[x & np.uint32(255)] ^ (x >> np.uint32(8))

    @staticmethod
    def _apply(tables: np.ndarray, which: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = tables[which, 0, x & np.uint32(255)]
        for k in range(1, 4):
            out = out ^ tables[which, k, (x >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def followed(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The part of x in the crc of its text with n more bytes behind it."""
        out = self._apply(self.zeros, np.minimum(n, SHORT + 1), x)
        if len(far := np.flatnonzero(n > SHORT + 1)):
            value, left = x[far], n[far]
            for j in range(int(left.max()).bit_length()):
                on = np.flatnonzero(left >> j & 1)
                value[on] = self._apply(self.doubled, np.full(len(on), j), value[on])
            out[far] = value
        return out

    def words(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        value = np.full(len(start), 0xFFFFFFFF, np.uint32)
        left, i = np.flatnonzero(length <= SHORT), 0
        while len(left):
            value[left] = self.step[(value[left] ^ data[start[left] + i]) & np.uint32(255)] ^ (value[left] >> np.uint32(8))
            i += 1
            left = left[length[left] > i]
        value ^= np.uint32(0xFFFFFFFF)
        for w in np.flatnonzero(length > SHORT):
            value[w] = zlib.crc32(data[start[w] : start[w] + length[w]])
        return value

    def runs(self, words: np.ndarray, length: np.ndarray, row: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(crc32, row) of all runs of 1, 2 ... `most` words of a row, joined by one space."""
        yield words, row
        begun = words
        spaced = self.followed(np.full(len(words), self.blank), length) ^ words
        for k in range(1, most):
            if len(words) <= k:
                return
            begun = self.followed(begun[: len(words) - k], length[k:] + 1) ^ spaced[k:]
            inside = row[: len(words) - k] == row[k:]
            yield begun[inside], row[k:][inside]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(256, bool)
    inside[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return inside, lower


class Features:
    """Of texts: their numbers of words, and the buckets of their runs of words."""

    def __init__(self, buckets: int, most: int):
        self.crc, self.buckets, self.most = Crc(), buckets, most
        self.inside, self.lower = _tables()

    def _piece(self, data: np.ndarray, at: int) -> int:
        """Where the piece that begins at `at` ends: behind a byte outside words."""
        to = at + PIECE
        while to < len(data):
            out = np.flatnonzero(~self.inside[self.lower[data[to : to + PIECE]]])
            if len(out):
                return to + int(out[0]) + 1
            to += PIECE
        return len(data)

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(crc32, length, row) of each word, piece by piece, so that only these three grow with a very long text."""
        data, text_end = text_bytes(texts)
        found, at = [], 0
        while at < len(data):
            to = self._piece(data, at)
            piece = self.lower[data[at:to]]
            inside = self.inside[piece]
            cuts = text_end[np.searchsorted(text_end, at, side="right") : np.searchsorted(text_end, to, side="left")] - at
            before = np.concatenate([[False], inside[:-1]])
            before[cuts] = False
            after = np.concatenate([inside[1:], [False]])
            after[cuts - 1] = False
            start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
            found.append((self.crc.words(piece, start, end - start), end - start, np.searchsorted(text_end, start + at, side="right")))
            at = to
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Words of each text, and (bucket, row) arrays of all features."""
        value, length, row = self._words(texts)
        return np.bincount(row, minlength=len(texts)), [((c % np.uint32(self.buckets)).astype(np.int64), r) for c, r in self.crc.runs(value, length, row, self.most)]


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS, most: int = RUNS) -> np.ndarray:
    """How many features of all texts fall in each bucket; a task sends its sums, at most a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sums = Features(buckets, most), np.zeros(buckets, np.int64)
        for part in text_chunks(batches, "text"):
            for bucket, _ in features.of(part.column(0))[1]:
                sums += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["bucket", "n"])

    sums = np.zeros(buckets, np.int64)
    for bucket, n in rows.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # at most a row for each bucket
        sums[bucket] = n
    return sums


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of a bucket's smoothed share in the target over that in the corpus, rounded down."""
    n = len(corpus)
    return np.floor(1000 * np.log(((target + 1.0) * (corpus.sum() + n)) / ((corpus + 1.0) * (target.sum() + n)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, most: int = RUNS) -> DataFrame:
    """(doc_id, n_words, n_features, weight). gain has an entry for each bucket and goes along with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(len(gain), most)
        for part in text_chunks(batches, "text"):
            n_words, found = features.of(part.column(1))
            weight, n = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            for bucket, row in found:
                sums = np.concatenate([[0], np.cumsum(gain[bucket])])
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                weight += np.diff(sums[ends])
                n += np.diff(ends)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words.astype(np.int64)), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = "42") -> Column:
    """Thousandths of a Gumbel variate, the same for a doc_id wherever it is drawn."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _digits(rows: DataFrame, keys: list[tuple[str, bool]]) -> list[Column]:
    """Digits of the composite key, the lowest first, each a small number that starts at zero."""
    signed = [(F.bitwise_not(F.col(c)) if falling else F.col(c)) for c, falling in keys]
    ends = rows.agg(*[f(x) for x in signed for f in (F.min, F.max)]).first()
    found: list[Column] = []
    for i, x in reversed(list(enumerate(signed))):
        low, high = ends[2 * i], ends[2 * i + 1]
        if low is None:
            low = high = 0
        # A range beyond 63 bits is read as two halves, the upper one signed.
        halves = [(x - F.lit(low), high - low)] if high - low < (1 << 62) else [(x.bitwiseAND(F.lit(0xFFFFFFFF)), (1 << 32) - 1), (F.shiftright(x, 32) - F.lit(low >> 32), (high >> 32) - (low >> 32))]
        for value, span in halves:
            value = F.coalesce(value, F.lit(span + 1))  # null comes last
            found += [F.shiftrightunsigned(value, j).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int") for j in range(0, (span + 1).bit_length(), DIGIT)]
    return found


def radix_ranked(rows: DataFrame, keys: list[tuple[str, bool]]) -> tuple[DataFrame, str]:
    """rows with `rank` (1 for the first) by keys (long column, whether falling), and the folder that holds them.

    Distributed LSD radix sort, stable; equal keys keep the order in which rows were read.
    """
    spark, columns = rows.sparkSession, rows.columns
    rows, folder = stored(rows.withColumn("at", F.monotonically_increasing_id()))  # the partition above bit 33
    digits = _digits(rows, keys)
    have = rows.select(F.posexplode(F.array(*digits)).alias("pass", "digit")).groupBy("pass", "digit").agg(F.count("*").alias("n")).collect()  # 2**DIGIT rows for each pass at most
    shift = 33
    for p, digit in enumerate(digits):
        totals = sorted((r.digit, r.n) for r in have if r["pass"] == p)
        last = p == len(digits) - 1
        if len(totals) < 2 and not (last and shift == 33):  # the last pass, if it is the only one, makes positions dense
            continue
        bases = np.cumsum([0, *(n for _, n in totals)])[:-1].tolist()
        base = spark.createDataFrame([(d, b) for (d, _), b in zip(totals, bases, strict=True)], "digit int, base long")
        placed = rows.select(*columns, "at", F.shiftright("at", shift).alias("block"), digit.alias("digit"))
        counts = placed.groupBy("digit", "block").agg(F.count("*").alias("n"))
        before = "coalesce(sum(n) over (partition by digit order by block rows between unbounded preceding and 1 preceding), 0L)"
        first = counts.select("digit", "block", F.expr(before).alias("before")).join(F.broadcast(base), "digit").select("digit", "block", (F.col("base") + F.col("before")).alias("first"))
        rank = F.expr("row_number() over (partition by block, digit order by at)")
        moved = placed.join(first, ["block", "digit"]).select(*columns, (F.col("first") + rank - 1).alias("at"))
        old, shift = folder, BLOCK
        rows, folder = stored(moved)
        discard(spark, old)
    return rows.select(*columns, (F.col("at") + 1).alias("rank")), folder


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, most: int = RUNS, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it is not drawn."""
    gain = gains(bucket_counts(docs, buckets, most), bucket_counts(target, buckets, most))
    scored = weighted(docs, gain, most).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    scored, folder = stored(scored)
    long = scored.where(F.col("n_words") >= least_words).drop("n_words")
    drawn = percent * long.count() // 100
    ranked, _ = radix_ranked(long, [("score", True), ("doc_id", False)])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).drop("n_words").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)
