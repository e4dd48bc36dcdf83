import random

import numpy as np
import pyarrow as pa

from weirgate.llm import decontaminate as D
from weirgate.llm.common import Words

SF = "/root/testdata/sf0.01"
rng = random.Random(4)
VOCAB = [f"w{i}é" for i in range(3000)] + ["the", "of"] * 400


def passage(n):
    return [rng.choice(VOCAB) for _ in range(n)]


def edited(words, k):
    words = list(words)
    for _ in range(k):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        words[at : at + (kind != 0)] = [f"new{rng.randrange(10**6)}"] if kind < 2 else []
    return words


def written(words):
    return " , ".join(w[0].upper() + w[1:] for w in words)


def slow(item, text):
    """Fewest edits of item against any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_recall_and_precision_against_brute_force(spark):
    items = [passage(rng.randrange(8, 60)) for _ in range(30)]
    docs = []
    for i in range(240):
        item = rng.choice(items)
        k = int(0.2 * len(item))
        inner = edited(item, rng.choice([0, 1, k // 2, k, k + 3, 2 * k + 2])) if i % 2 else passage(20)
        docs.append((i, passage(rng.randrange(60)) + inner + passage(rng.randrange(60))))
    want = {(d, n) for d, text in docs for n, item in enumerate(items) if slow(item, text) <= int(0.2 * len(item) + 1e-9)}
    rows = D.decontaminate(
        spark.createDataFrame([(d, written(t)) for d, t in docs], "doc_id long, text string"),
        spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(items)], "item_id long, text string"),
    ).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 60
    for r in rows:
        text = written(dict(docs)[r.doc_id])
        assert slow(items[r.item_id], text[r.start : r.end].lower().split(" , ")) == r.edits


def test_planted_passages_are_found(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    held = {(d.doc_id, b.item_id) for d in docs.collect() for b in items.collect() if " ".join(b.text.split()) in " ".join(d.text.split())}
    got = {(r.doc_id, r.item_id) for r in D.decontaminate(docs, items).collect()}
    assert held <= got and len(got) < len(held) + 5


def test_best_stretch():
    a = np.array([1, 2, 3, 4, 5], np.uint64)
    assert D.best_stretch(a, np.array([9, 9, 1, 2, 7, 4, 5, 9], np.uint64)) == (1, 2, 7)
    assert D.best_stretch(a, a[:0]) == (5, 0, 0)


def test_every_occurrence_is_found(spark):
    item, other = passage(20), passage(30)
    docs = {
        0: item + passage(3) + item,
        1: item * 6,
        2: edited(item, 2) + passage(2) + item + passage(200) + edited(item, 4) + item,
        3: item + other + item,
        4: other[:24],
        5: passage(5),
    }
    rows = D.decontaminate(
        spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id long, text string"),
        spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other))], "item_id long, text string"),
    ).collect()
    found = {}
    for r in rows:
        found.setdefault((r.doc_id, r.item_id), []).append((r.start, r.end))
    assert {k: len(v) for k, v in found.items()} == {(0, 1): 2, (1, 1): 6, (2, 1): 4, (3, 1): 2, (3, 2): 1, (4, 2): 1}
    for spans in found.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_stretches_against_brute_force():
    for _ in range(200):
        item = np.array([rng.randrange(1, 9) for _ in range(rng.randrange(5, 12))], np.uint64)
        text = np.concatenate([np.array(edited([int(w) for w in item], rng.randrange(3)) if rng.random() < 0.5 else [rng.randrange(1, 9) for _ in range(6)], object) for _ in range(5)])
        text = np.array([hash(w) % 1000003 for w in text], np.uint64)
        most = len(item) // 5
        got = list(D.stretches(item, text, most))
        assert bool(got) == (slow(item.tolist(), text.tolist()) <= most)
        done = 0
        for edits, start, end in got:
            assert done <= start < end and edits <= most and slow(item.tolist(), text[start:end].tolist()) == edits
            assert slow(item.tolist(), text[done:start].tolist()) > most
            done = end
        assert slow(item.tolist(), text[done:].tolist()) > most


def test_short_items_are_found_verbatim(spark):
    docs = [(1, "so The answer, is forty two."), (2, "the answer is forty one"), (3, "no no no no no no no"), (4, "two"), (5, None)]
    items = [(1, "answer is forty two"), (2, "No no no"), (3, "answer is"), (4, "the answer is"), (5, "the answer is")]
    rows = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = sorted((r.doc_id, r.item_id, dict(docs)[r.doc_id][r.start : r.end], r.edits, r.item_words) for r in rows)
    assert got == [(1, 1, "answer, is forty two", 0, 4), (1, 4, "The answer, is", 0, 3), (1, 5, "The answer, is", 0, 3), (2, 4, "the answer is", 0, 3), (2, 5, "the answer is", 0, 3), (3, 2, "no no no", 0, 3), (3, 2, "no no no", 0, 3)]


def test_windows_keep_every_match():
    item = passage(40)
    block = D.Block([1], pa.array([" ".join(item)]), 0.8, 0.97)
    for _ in range(40):
        before = passage(rng.randrange(50))
        words = Words(pa.array([" ".join(before + edited(item, 8) + passage(10))]))
        (c,) = block.classes
        starts = D.window_starts(block.known_pairs(words), words.row, words.first(), c)
        assert any(abs(s - len(before)) <= c.stride for s in starts)


def test_nulls_ties_and_empty_tables(spark):
    schema, items = "doc_id long, text string, item_id string, start int", "item_id long, text string, doc_id int"
    text = " ".join(passage(20))
    docs = [(None, text, "x", 1), (1, text, "x", 1), (1, text, "x", 1), (2, None, None, None), (3, "", None, None), (4, "a b " * 400000 + text, None, None)]
    bench = [(7, text, 1), (7, text, 1), (None, text, 1), (8, None, 1), (9, "a b", 1)]
    got = D.decontaminate(spark.createDataFrame(docs, schema), spark.createDataFrame(bench, items)).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0, r.edits) for r in got) == sorted((d, i, 0) for d in (0, 1, 1, 4) for i in (7, 7, 0))
    empty = spark.createDataFrame([], schema), spark.createDataFrame([], items)
    assert D.decontaminate(spark.createDataFrame(docs, schema), empty[1]).collect() == []
    assert D.decontaminate(empty[0], spark.createDataFrame(bench, items)).collect() == []
