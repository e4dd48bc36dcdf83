import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weirgate.llm import queries as Q
from weirgate.llm import resampling as R

SF = "/root/testdata/sf0.001"


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def brute(docs, target):
    """The contract, row by row."""
    have = [(d, *features(t)) for d, t in docs]
    s = Counter(bucket(f) for _, _, fs in have for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (total_s + 10_000)) / ((s[b] + 1) * (total_t + 10_000))))
    rows = []
    for d, n_words, fs in have:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: len(able) * 5 // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert sorted(map(tuple, Q.op12_resampling(spark, SF).collect()), key=repr) == brute(docs, target)


def test_nulls_repeats_ties_long_texts_and_other_columns(spark):
    long = "lorem " + "w" * 5000 + " ipsum é日 " * 300
    rows = [(None, "some words " * 15, 1), (None, None, 1), (3, "", 1), (4, long, 1), (-5, "Good TEXT of words " * 9, 1), (-5, "Good TEXT of words " * 9, 1), (2**62, "a b", 1), (-(2**62), "one two three " * 8, 1)] + [(100 + i, f"good text number {i} " * 6, 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int").repartition(7)
    target = spark.createDataFrame([("good text",), (None,)], "text string")
    assert sorted(map(tuple, R.resample(docs, target).collect()), key=repr) == brute([r[:2] for r in rows], ["good text", None])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.resample(none, none).collect() == []
    one = spark.createDataFrame([(1, "word " * 25)], "doc_id long, text string")
    assert [tuple(r) for r in R.resample(one, none).collect()] == brute([(1, "word " * 25)], [])


def test_crc_of_runs_of_words_of_any_length():
    r = random.Random(3)
    texts = ["".join(r.choice("aZ0é- \n,日") * r.choice([1, 1, 2, 70]) for _ in range(r.randint(0, 30))) for _ in range(300)]
    n, found = R.Features(10_000, 3).of(pa.array(texts))
    got = Counter((int(row), int(b)) for bs, rows in found for b, row in zip(bs, rows))
    assert n.tolist() == [features(t)[0] for t in texts]
    assert got == Counter((i, bucket(f)) for i, t in enumerate(texts) for f in features(t)[1])


def test_pieces_of_a_long_text_lose_no_word(monkeypatch):
    monkeypatch.setattr(R, "PIECE", 16)
    texts = ["ab cd " * 50 + "x" * 100 + " end", "no", "yes it is" * 9, ""]
    n, found = R.Features(10_000, 3).of(pa.array(texts))
    assert n.tolist() == [features(t)[0] for t in texts]
    assert Counter(int(b) for bs, _ in found for b in bs) == Counter(bucket(f) for t in texts for f in features(t)[1])


@pytest.mark.parametrize("seed,low,high", [(1, -3, 3), (2, -(2**63), 2**63 - 1), (3, 0, 2**40), (4, 7, 7)])
def test_radix_ranks_are_those_of_a_stable_sort(spark, seed, low, high):
    r = random.Random(seed)
    value = lambda: r.choice([None, r.randint(low, high), r.randint(low, high), low, high])
    rows = [(i, value(), value()) for i in range(700)]
    ranked, _ = R.radix_ranked(spark.createDataFrame(rows, "i long, a long, b long").coalesce(3), [("a", True), ("b", False)])
    want = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[2] is None, x[2] or 0, x[0]))
    got = [(x.i, x.a, x.b) for x in sorted(ranked.collect(), key=lambda x: x.rank)]
    assert got == want and sorted(x.rank for x in ranked.collect()) == list(range(1, 701))


def test_a_digit_of_most_rows_meets_in_no_task(spark):
    """Counting and placing go by block of positions and digit, never by the digit alone."""
    ranked, _ = R.radix_ranked(spark.range(300).selectExpr("id", "0L a"), [("a", False)])
    assert np.array_equal([x.id for x in sorted(ranked.collect(), key=lambda x: x.rank)], np.arange(300))
