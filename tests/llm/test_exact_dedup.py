import hashlib
import random
import re

import pyarrow as pa

from weirgate.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, task string, record int, members string"


def content(t):
    return re.sub(r"[ \t-\r]+", " ", t or "")


def documents():
    rng = random.Random(2)
    docs = [(i, rng.choice(["", " ", "\n", "a  b", "a b", "a\x0bb ", " a", "\x1c a", None, f"text {rng.randrange(40)}", "long " * 3000])) for i in range(300)]
    return docs + [(5, "a b"), (5, "a b"), (None, "a b"), (None, "alone")]


def want(docs):
    groups = {}
    for d, t in docs:
        groups.setdefault(content(t), []).append(d)
    least = {c: min((d for d in g if d is not None), default=None) for c, g in groups.items()}
    return groups, least


def check(spark, docs, partitions=3):
    rows = E.exact_dedup(spark.createDataFrame([(d, t, "x", 1, None) for d, t in docs], SCHEMA).repartition(partitions)).collect()
    groups, least = want(docs)
    sha = {hashlib.sha256(c.encode()).hexdigest(): c for c in groups}
    assert sorted((-1 if r.doc_id is None else r.doc_id, sha[r.text_sha256]) for r in rows) == sorted((-1 if d is None else d, content(t)) for d, t in docs)
    for r in rows:
        assert r.keep_id == least[sha[r.text_sha256]] and r.group_size == len(groups[sha[r.text_sha256]])
        assert not r.kept or r.doc_id == r.keep_id
    kept = [r.text_sha256 for r in rows if r.kept]
    assert sorted(kept) == sorted(sha)


def test_groups_against_brute_force(spark):
    check(spark, documents())


def test_flushes_and_spills_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(E, "SEND_BYTES", 500)
    monkeypatch.setattr(E, "TABLE_BYTES", 500)
    monkeypatch.setattr(E, "MEMBERS", 2)
    check(spark, documents(), 2)


def test_a_hot_content_takes_one_entry(spark, monkeypatch):
    docs = [(i, "hot") for i in range(3000, 0, -1)] + [(i, f"text {i % 50}") for i in range(3001, 3200)]
    monkeypatch.setattr(E, "SEND_BYTES", 300)
    check(spark, docs, 4)
    kept = list(E.grace(((1, b"hot", (i, 1)) for i in range(5, 900)), 10**6, one=lambda x: x, fold=lambda a, b: (min(a[0], b[0]), a[1] + b[1])))
    assert kept == [(5, 895)]


class OneTask:
    @staticmethod
    def get():
        return OneTask

    @staticmethod
    def partitionId():
        return 7


def test_a_sender_hands_on_before_ids_fill_its_memory(monkeypatch):
    monkeypatch.setattr(E, "TaskContext", OneTask)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    batches = (pa.RecordBatch.from_arrays([pa.array(range(i, i + 50_000)), pa.array(["hot"] * 50_000)], schema=schema) for i in range(0, 1_000_000, 50_000))
    marks, told = {}, 0
    for batch in E._sender(pa.struct(list(schema)), True)(batches):
        members = batch.column("members")
        told += len(members.flatten())
        for mark, n in zip(batch.column("mark").to_pylist(), members.value_lengths().to_pylist(), strict=True):
            marks[mark] = marks.get(mark, 0) + (n or 0)
    assert told == 1_000_000 and len(marks) == 3
    assert max(marks.values()) <= E.SEND_BYTES // E.ID_BYTES + 1


def test_ids_told_do_not_stay_in_a_receivers_memory():
    record = pa.struct([("doc_id", pa.int64()), ("text", pa.string())])
    schema = pa.schema([("bucket", pa.int64()), ("task", pa.int32()), ("mark", pa.binary()), ("rows", pa.int64()), ("members", pa.list_(pa.int64())), ("record", record)])
    mark = hashlib.sha256(b"hot").digest() + bytes(4)

    def batches():
        yield E._batch([(0, 7, mark, 4_096_000, None, {"doc_id": 0, "text": "hot"})], schema)
        for i in range(250):
            members = pa.ListArray.from_arrays(pa.array([0, 4096, 8192, 12288, 16384]), pa.array(range(4 * i * 4096, 4 * (i + 1) * 4096)))
            yield pa.RecordBatch.from_arrays([pa.array([0] * 4), pa.array([7] * 4, pa.int32()), pa.array([mark] * 4, pa.binary()), pa.array([(4 * i + j) * 4096 for j in range(4)]), members, pa.nulls(4, record)], schema=schema)

    before, most, ids, decided = pa.total_allocated_bytes(), 0, 0, []
    for batch in E._decide(batches()):
        most = max(most, pa.total_allocated_bytes() - before)
        ids += len(batch.column("members").flatten())
        decided += [x for x in batch.to_pylist() if x["members"] is None]
    assert ids == 4_096_000 and most < 4 << 20  # the ids take 32 MB
    assert [(x["keep_id"], x["group_size"]) for x in decided] == [(0, 4_096_000)]


def test_grace_recursion_and_equal_hashes():
    rng = random.Random(3)
    records = [(rng.randrange(8) << 61 | rng.randrange(4), bytes([rng.randrange(5)]) * 10, i) for i in range(400)]
    want = {}
    for h, c, i in records:
        want.setdefault((h, c), []).append(i)
    for most in (1, 1000, 10**9):
        assert sorted(sorted(g) for g in E.grace(iter(records), most)) == sorted(want.values())


def test_survivors_keep_all_columns(spark):
    docs = documents()
    rows = E.survivors(spark.createDataFrame([(d, t, "x", 1, None) for d, t in docs], SCHEMA).repartition(3)).collect()
    _, least = want(docs)
    assert sorted((content(r.text), -1 if r.doc_id is None else r.doc_id) for r in rows) == sorted((c, -1 if d is None else d) for c, d in least.items())
    assert {(r.task, r.record, r.members) for r in rows} == {("x", 1, None)}
    empty = spark.createDataFrame([], SCHEMA)
    assert E.survivors(empty).collect() == [] and E.exact_dedup(empty).collect() == []
