"""Language ID with a bit-sliced Bloom filter of n-grams.

The filter has one mask of languages in each slot. An n-gram's slots, ANDed, are the set of all languages
that (seem to) have it: one lookup for all languages. A text's n-grams are counted for each language,
and each count is corrected by that language's own rate of false positives, which follows from how many
slots carry its bit. The language with the largest corrected count wins.

n-grams are runs of four bytes of the text after lower-casing A-Z and turning each run of non-letters
into a space (bytes of non-ASCII characters count as letters), with spaces before the text. A language
has the n-grams that its labelled texts show at least LEAST times, and at no less than a part (SHARE) of
the rate of the language in which they are most frequent.

Training takes about `sample` labelled documents of each language, chosen by a hash of doc_id, and whole
texts of these; the filter's size is fixed, so what is sent to the tasks is bounded. Everything else
covers all rows.

Defined results: `und` and score 0 where the text is null or has no letter, or nothing could be learned;
rows with null lang teach nothing; a null doc_id is not held out and teaches nothing; repeated rows stay
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.llm.common import mix64, received, sent, text_bytes, text_chunks

UNKNOWN = "und"
#: Labelled documents of a language that teach it, and the most languages that are learned (the most frequent).
SAMPLE, LANGUAGES = 2000, 256
#: Slots of the filter (a power of two) and slots of an n-gram.
SLOTS, PROBES = 1 << 20, 2
LEAST, SHARE = 3, 0.3
HELD_OUT, FOLDS = 1, 3


class Filter(NamedTuple):
    languages: list[str]
    #: (bytes of languages, SLOTS): bit l % 8 of row l // 8 is language l.
    masks: np.ndarray
    #: Chance, for each language, that an n-gram seems to have it.
    false: np.ndarray


def _letters() -> np.ndarray:
    """Each byte lower-cased, or 0x20 if it is no letter."""
    table = np.full(256, 0x20, np.uint8)
    table[97:123] = table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram) of each letter, and of each space after one."""
    data, ends = text_bytes(texts)
    data = _letters()[data]
    row = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    space = data == 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (row[1:] == row[:-1]))
    data, row = data[keep], row[keep]
    code = data.astype(np.uint32)
    for back in (1, 2, 3):
        before = np.full(len(data), 0x20, np.uint32)
        if len(data) > back:
            same = row[back:] == row[:-back]
            before[back:] = np.where(same, data[:-back], 0x20)
        code |= before << np.uint32(8 * back)
    known = code != 0x20202020
    return row[known], code[known]


def slots_of(codes: np.ndarray) -> list[np.ndarray]:
    h = mix64(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return [((h >> np.uint64(32 * i)) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(PROBES)]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Filter:
    """The filter of all languages that the labelled documents outside the held-out fold have."""
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    languages = list(counts)
    if not languages:
        return Filter([], np.zeros((0, SLOTS), np.uint8), np.zeros(0))
    least = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, sample / n) * (1 << 31)))))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < least[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            langs = batch.column("lang").to_pylist()
            number = {x: i for i, x in enumerate(sorted(set(langs)))}
            row, code = ngrams(batch.column("text"))
            keys, n = np.unique(np.array([number[x] for x in langs], np.uint64)[row] << np.uint64(32) | code, return_counts=True)
            names = pa.array(sorted(number)).take(pa.array((keys >> np.uint64(32)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([names, pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    # Bounded by the sample's texts.
    grams = chosen.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).toArrow()
    return build(languages, grams)


def build(languages: list[str], grams: pa.Table) -> Filter:
    lang = np.array([languages.index(x) for x in grams["lang"].to_pylist()], np.int64)
    codes, where = np.unique(grams["code"].to_numpy(), return_inverse=True)
    rate = np.zeros((len(codes), len(languages)))
    rate[where, lang] = grams["n"].to_numpy()
    rate /= np.maximum(rate.sum(axis=0), 1)
    has = (rate > 0) & (rate >= SHARE * rate.max(axis=1, keepdims=True, initial=0))
    masks = np.zeros((-(-len(languages) // 8), SLOTS), np.uint8)
    for slots in slots_of(codes.astype(np.uint32)):
        for i in range(len(languages)):
            masks[i // 8, slots[has[:, i]]] |= np.uint8(1 << i % 8)
    filled = np.array([(masks[i // 8] >> (i % 8) & 1).mean() for i in range(len(languages))])
    return Filter(languages, masks, filled**PROBES)


def corrected_counts(model: Filter, texts: pa.Array) -> np.ndarray:
    """For each text and language, the number of n-grams less the expected false positives, at least 0."""
    row, code = ngrams(texts)
    n = len(texts)
    slots = slots_of(code)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)
    found = []
    for mask in model.masks:
        languages = mask[slots[0]]
        for more in slots[1:]:
            languages &= mask[more]
        found.append(np.bincount(row.astype(np.int64) * 256 + languages, minlength=n * 256).reshape(n, 256) @ bits)
    hits = np.concatenate(found, axis=1)[:, : len(model.languages)]
    total = np.bincount(row, minlength=n)[:, None]
    return np.maximum(0, (hits - total * model.false) / (1 - np.minimum(model.false, 0.999)))


def predict(model: Filter, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language of each text, and its share of all languages' corrected counts."""
    return judged(model, texts)[:2]


def judged(model: Filter, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The same, and as evidence the language's corrected count as a share of the text's n-grams."""
    counts = corrected_counts(model, texts)
    best = counts.argmax(axis=1)  # ties and no evidence: the language with the most labelled documents
    total = counts.sum(axis=1)
    score = np.where(total > 0, counts.max(axis=1) / np.maximum(total, 1e-9), 0.0)
    data, ends = text_bytes(texts)
    lower = data | 0x20
    ascii_letters = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122))])
    has = np.diff(ascii_letters[np.concatenate([[0], ends])]) > 0
    names = []
    for i, b in enumerate(best.tolist()):
        if not has[i] and not any(map(str.isalpha, texts[i].as_py() or "")):
            names.append(UNKNOWN)
            score[i] = 0.0
        else:
            names.append(model.languages[b])
    grams = np.bincount(ngrams(texts)[0], minlength=len(texts))
    return names, score, counts.max(axis=1) / np.maximum(grams, 1)


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs, learned from its labelled rows."""
    out = classify(docs.select("doc_id", "text"), learn(docs, sample))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def classify(docs: DataFrame, model: Filter) -> DataFrame:
    """docs with lang_pred, score and evidence as further columns."""
    filters = sent(docs.sparkSession, model)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(filters)
        for batch in text_chunks(batches, "text"):
            if model.languages:
                names, score, evidence = judged(model, batch.column("text"))
            else:
                names, score, evidence = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(evidence)], names=[*batch.schema.names, "lang_pred", "score", "evidence"])

    fields = docs.schema.fields
    schema = type(docs.schema)(list(fields)).add("lang_pred", "string").add("score", "double").add("evidence", "double")
    return docs.mapInArrow(run, schema)
