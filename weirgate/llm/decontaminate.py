"""Benchmark decontamination: edit-similar copies of benchmark items inside documents.

Windows of a document are compared with items of about their size through the CGK embedding: a random
walk reads a word sequence and stays on a word or goes on, as a hash of (step, word) says, so sequences
at a small edit distance give embeddings at a small Hamming distance. Bit-sampling LSH of the embedding
(a few sampled steps are one signature) is repeated until a pair at the least similarity meets with the
target recall; how often is measured on the items themselves, with random edits. Every meeting is
verified by an exact edit distance over words, with free ends in the document.

An item of n words matches where at most k = (1 - similarity) * n word edits turn it into a stretch of
the document. Such a stretch keeps at least n - 1 - 2k of the item's word pairs; windows that have fewer
pairs of any item of their size cannot match and are left out before they are embedded.

Items of EXACT_WORDS words or more but fewer than MIN_WORDS allow no edit; they are found by the hash of
all runs of as many words, compared word by word.

All occurrences of an item that do not overlap are reported, from left to right: of stretches that
overlap, the one with the fewest edits near the first of them.

The benchmark is the query set: it is taken in blocks of at most ITEM_BLOCK items, each sent to all
tasks, against all rows. Documents are read once for each block and never shuffled.

Defined results: words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; null and
empty texts have no words; items of fewer than EXACT_WORDS words are no evidence and match nothing;
items longer than a document match it only if few enough words are missing; very long texts are read whole;
of equally good stretches the first counts; repeated documents and repeated items are reported each; a null doc_id or item_id is reported as null;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.common import CHUNK_BYTES, Words, mix64, received, sent, text_chunks

SIMILARITY, RECALL = 0.8, 0.97
#: Items of fewer words are found verbatim only, and those of fewer than EXACT_WORDS not at all.
MIN_WORDS, EXACT_WORDS = 5, 3
ITEM_BLOCK = 4096
#: Steps of the embedding that make one signature; items of one size class differ in length by this factor.
SAMPLED, CLASS_RATIO = 3, 1.25
PAIR_BITS = 22
#: Windows that are embedded together, each of up to an item's words.
WINDOWS = 1 << 12
SEED = 20240229
SCHEMA = "doc_id long, item_id long, start long, end long, edits int, item_words int, similarity double"


class SizeClass:
    """Items of similar length, with the signatures of each repetition."""

    def __init__(self, items: list[tuple[int, np.ndarray]], similarity: float, recall: float):
        self.items = items
        lengths = np.array([len(w) for _, w in items])
        self.edits = np.floor((1 - similarity) * lengths + 1e-9).astype(int)
        self.least, self.most = int(lengths.min()), int(lengths.max())
        #: A matching stretch has so many words at most and, among them, so many pairs of its item at least.
        self.reach = int((lengths + self.edits).max())
        self.pairs = max(1, int((lengths - 1 - 2 * self.edits).min()))
        self.stride = max(1, self.least // 16)
        rng = np.random.default_rng([SEED, self.least])
        words = _matrix([w for _, w in items], self.most)
        chance = self._meeting(words, lengths, rng)
        self.steps = self._draws(rng, math.ceil(math.log(1 - recall) / math.log(1 - chance)))
        self.tables = []
        for draw in self.steps:
            marks = signatures(words, draw)
            order = np.argsort(marks, kind="stable")
            self.tables.append((marks[order], order))

    def _draws(self, rng: np.random.Generator, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each repetition, its sampled steps and the odd multipliers of its walk."""
        steps = max(SAMPLED, 2 * self.least - 2)
        return [(np.sort(rng.choice(steps, SAMPLED, replace=False)), rng.integers(0, 1 << 63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) for _ in range(n)]

    def _meeting(self, words: np.ndarray, lengths: np.ndarray, rng: np.random.Generator) -> float:
        """Share of repetitions in which an item meets a copy with all allowed edits that starts off by a stride."""
        met = []
        for draw in self._draws(rng, 24):
            some = rng.integers(0, len(words), 64)
            copies = []
            for i in some:
                w = words[i, : lengths[i]].tolist()
                for _ in range(self.edits[i]):
                    at, kind = int(rng.integers(0, len(w))), int(rng.integers(0, 3))
                    w[at : at + (kind != 0)] = [int(rng.integers(1, 1 << 63))] if kind < 2 else []
                off = int(rng.integers(0, self.stride))
                copies.append(np.array(w[off:] + rng.integers(1, 1 << 63, off).tolist(), np.uint64))
            met.append((signatures(words[some], draw) == signatures(_matrix(copies, self.most + int(self.edits.max())), draw)).mean())
        return min(0.999, max(0.01, float(np.mean(met))))

    def candidates(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that share a signature in some repetition."""
        found = []
        for draw, (marks, order) in zip(self.steps, self.tables, strict=True):
            own = signatures(windows, draw)
            low, high = np.searchsorted(marks, own, "left"), np.searchsorted(marks, own, "right")
            n = high - low
            if n.any():
                window = np.repeat(np.arange(len(own)), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                found.append(window * len(self.items) + order[at])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // len(self.items), pairs % len(self.items)


def _matrix(sequences: list[np.ndarray], width: int) -> np.ndarray:
    """One row for each sequence, zeros after its end."""
    out = np.zeros((len(sequences), width + 1), np.uint64)
    for i, w in enumerate(sequences):
        out[i, : min(width, len(w))] = w[:width]
    return out


def signatures(words: np.ndarray, draw: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Hashes of the sampled steps of each row's CGK walk."""
    steps, odd = draw
    rows, at = np.arange(len(words)), np.zeros(len(words), np.int64)
    out = np.zeros(len(words), np.uint64)
    sampled = set(steps.tolist())
    for t in range(int(steps[-1]) + 1):
        word = words[rows, at]
        if t in sampled:
            out = mix64(out + word)
        at = np.minimum(at + ((word * odd[t]) >> np.uint64(63)).astype(np.int64), words.shape[1] - 1)
    return out


def pair_hashes(words: np.ndarray) -> np.ndarray:
    return mix64(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:])


class Block:
    """What the tasks need of a block of items."""

    def __init__(self, item_ids: list[int | None], texts: pa.Array, similarity: float, recall: float):
        words = Words(texts)
        first = words.first()
        items = [(name, words.hash[first[i] : first[i + 1]]) for i, name in enumerate(item_ids) if first[i + 1] - first[i] >= MIN_WORDS]
        items.sort(key=lambda x: len(x[1]))
        #: By number of words: hashes, in order, of the items that are found verbatim, and the items.
        self.short: dict[int, tuple[np.ndarray, list[tuple[int | None, np.ndarray]]]] = {}
        for n in range(EXACT_WORDS, MIN_WORDS):
            h, at = words.rolling(n)
            whole = np.flatnonzero(np.diff(first)[words.row[at]] == n)
            if len(whole):
                whole = whole[np.argsort(h[whole], kind="stable")]
                self.short[n] = h[whole], [(item_ids[words.row[i]], words.hash[i : i + n]) for i in at[whole].tolist()]
        self.classes: list[SizeClass] = []
        while items:
            n = sum(len(w) <= CLASS_RATIO * len(items[0][1]) for _, w in items)
            self.classes.append(SizeClass(items[:n], similarity, recall))
            items = items[n:]
        pairs = [pair_hashes(w) for c in self.classes for _, w in c.items]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        self.maybe = np.zeros(1 << PAIR_BITS, bool)
        self.maybe[self.pairs >> np.uint64(64 - PAIR_BITS)] = True

    def known_pairs(self, words: Words) -> np.ndarray:
        """Where a pair of neighbouring words begins that some item has too."""
        if len(words.hash) < 2 or not len(self.pairs):
            return np.zeros(0, np.int64)
        h = pair_hashes(words.hash)
        at = np.flatnonzero(self.maybe[h >> np.uint64(64 - PAIR_BITS)])
        at = at[words.row[at] == words.row[at + 1]]
        return at[self.pairs[np.minimum(np.searchsorted(self.pairs, h[at]), len(self.pairs) - 1)] == h[at]]


def window_starts(known: np.ndarray, row_of: np.ndarray, first: np.ndarray, c: SizeClass) -> np.ndarray:
    """Starts, a stride apart, of the windows that hold enough known pairs for a match."""
    need = c.pairs
    if len(known) < need:
        return np.zeros(0, np.int64)
    low, high = known[: len(known) - need + 1], known[need - 1 :]
    enough = (high - low < c.reach) & (row_of[low] == row_of[high])
    low, high = low[enough], high[enough]
    # A stretch with these pairs starts where its reach still covers the last; the item may start earlier by what was edited.
    begin = np.maximum(high + 2 - c.reach, first[row_of[low]])
    end = low + 1
    if not len(begin):
        return np.zeros(0, np.int64)
    end = np.maximum.accumulate(end)
    begin = np.maximum(begin, np.concatenate([[0], end[:-1]]))
    n = np.maximum(0, end - begin)
    starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    return starts[starts % c.stride == 0]


def _edits_to(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
    """Word edits from a to the stretches of b that end at each of its words; they begin anywhere if `free`, else with b."""
    steps = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64) if free else steps.copy()
    for i, word in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != word))
        row = np.minimum.accumulate(new - steps) + steps
    return row


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of text with the fewest word edits from the item; the first one of several."""

    ends = _edits_to(item, text, True)
    end = int(ends.argmin())
    back = _edits_to(item[::-1], text[:end][::-1], False)
    return int(ends[end]), end - int(back.argmin()), end


def stretches(item: np.ndarray, text: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """(edits, start, end) of stretches of text that do not overlap, each at most `most` word edits from the item."""
    near = np.flatnonzero(_edits_to(item, text, True) <= most)  # where such stretches end
    at = done = 0
    while at < len(near):
        # Ends of one occurrence lie within 2 * most words.
        low = max(done, int(near[at]) - len(item) - most)
        edits, start, end = best_stretch(item, text[low : int(near[at]) + 2 * most])
        if edits <= most and end:
            yield edits, low + start, low + end
            done = low + end
            at = int(np.searchsorted(near, done, side="right"))
        else:
            at = int(np.searchsorted(near, near[at] + 2 * most, side="right"))


def verbatim(block: Block, words: Words) -> Iterator[tuple[int, int | None, int, int, int, int]]:
    """The matches of items too short for edits."""
    for n, (marks, items) in block.short.items():
        h, at = words.rolling(n)
        low, high = np.searchsorted(marks, h, "left"), np.searchsorted(marks, h, "right")
        done: dict[tuple[int, int], int] = {}
        for i in np.flatnonzero(high > low).tolist():
            start, row = int(at[i]), int(words.row[at[i]])
            for item in range(int(low[i]), int(high[i])):
                if start >= done.get((row, item), 0) and (words.hash[start : start + n] == items[item][1]).all():
                    done[row, item] = start + n
                    yield row, items[item][0], start, start + n, 0, n


def matches(block: Block, words: Words) -> Iterator[tuple[int, int | None, int, int, int, int]]:
    """(row, item_id, first word, end word, edits, the item's words)."""
    yield from verbatim(block, words)
    first = words.first()
    known = block.known_pairs(words)
    for c in block.classes:
        starts = window_starts(known, words.row, first, c)
        meets: dict[tuple[int, int], list[int]] = {}
        width = c.most
        for i in range(0, len(starts), WINDOWS):
            part = starts[i : i + (WINDOWS)]
            at = part[:, None] + np.arange(width + 1)
            inside = at < first[words.row[part] + 1][:, None]
            inside[:, -1] = False
            windows = np.where(inside, words.hash[np.minimum(at, len(words.hash) - 1)], np.uint64(0))
            for window, item in zip(*(x.tolist() for x in c.candidates(windows)), strict=True):
                start = int(part[window])
                meets.setdefault((int(words.row[start]), item), []).append(start)
        for (row, item), where in sorted(meets.items()):
            name, wanted = c.items[item]
            room = int(c.edits[item]) + c.stride
            where.sort()
            at = 0
            while at < len(where):  # windows whose surroundings meet are one region
                to = at + 1
                while to < len(where) and where[to] - where[to - 1] <= 2 * (len(wanted) + room):
                    to += 1
                low = max(int(first[row]), where[at] - room - len(wanted) // 2)
                high = min(int(first[row + 1]), where[to - 1] + len(wanted) + room)
                for edits, start, end in stretches(wanted, words.hash[low:high], int(c.edits[item])):
                    yield row, name, low + start, low + end, edits, len(wanted)
                at = to


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The matches: doc_id, item_id, start and end (code points of the text, end exclusive), edits, item_words, similarity."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text")
    blocks = max(1, -(-items.count() // (ITEM_BLOCK // 2)))  # hashed blocks vary in size
    found = [_matched(docs.select("doc_id", "text"), spark, _block(items, i, blocks, similarity, recall)) for i in range(blocks)]
    return reduce(DataFrame.union, found)


def _block(items: DataFrame, i: int, blocks: int, similarity: float, recall: float) -> Block:
    table = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).toArrow()
    return Block(table["item_id"].to_pylist(), table["text"].combine_chunks().cast(pa.string()), similarity, recall)


def _matched(docs: DataFrame, spark, block: Block) -> DataFrame:
    block_sent = sent(spark, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = received(block_sent)
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("item_words", pa.int32()), ("similarity", pa.float64())])
        for batch in text_chunks(batches, "text", CHUNK_BYTES):
            words = Words(batch.column("text"))
            rows = []
            for row, name, start, end, edits, n in matches(block, words):
                origin = int(words.text_end[row - 1]) if row else 0
                own = words.data[origin : int(words.text_end[row])]
                point = lambda byte, own=own, origin=origin: int(((own[: byte - origin] & 0xC0) != 0x80).sum())
                rows.append((batch.column("doc_id")[row].as_py(), name, point(int(words.start[start])), point(int(words.end[end - 1])), edits, n, 1 - edits / n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, SCHEMA)
