import random
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from weirgate.llm import common as C

TEXTS = st.lists(st.one_of(st.none(), st.text("aZ9 é,.\n😀", max_size=40)), max_size=8)


def words_of(text):
    return [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_words_equal_a_pattern(texts):
    w = C.Words(pa.array(texts, pa.string()))
    begin = [0, *w.text_end[:-1].tolist()] if texts else []
    got = [(r, s - begin[r], e - begin[r]) for r, s, e in zip(w.row.tolist(), w.start.tolist(), w.end.tolist())]
    want = [(i, s, e) for i, t in enumerate(texts) for s, e, _ in words_of(t)]
    assert got == want
    names = [x.lower() for t in texts for _, _, x in words_of(t)]
    assert len(set(names)) == len(set(w.hash.tolist())) == len(set(zip(names, w.hash.tolist())))


def test_chunks_hold_all_rows_in_order():
    texts = ["a" * n for n in (0, 5, 3, 100, 0, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(7))], names=["text", "i"])
    parts = list(C.text_chunks(iter([batch, batch.slice(0, 0), batch.slice(2, 3)]), "text", 6))
    assert [x for p in parts for x in p.column("i").to_pylist()] == [*range(7), 2, 3, 4]
    assert max(p.num_rows for p in parts) <= 4


def test_components_equal_brute_force(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, i) for i in range(1001, 1400)] + [(2000 + i, 2001 + i) for i in range(60)] + [(5, 5), (None, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in C.connected_components(df).collect()} == {x: find(x) for x in root}
    assert C.connected_components(df.limit(0)).collect() == []


def test_checkpoints_go_where_the_cluster_says(spark):
    C.shared_checkpoints(spark)
    assert spark.sparkContext.getCheckpointDir()
    assert C.cut(spark.range(3)).count() == 3
