import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weirgate.llm import queries as Q
from weirgate.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@functools.cache
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def whole(text):
    return tokenizer().encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return T.Encoder(f.read(), "<u2")


def test_tiles_give_the_ids_of_whole_texts(encoder):
    """Brute force: random texts of letters, marks, digits and every kind of white space, encoded whole."""
    r = random.Random(5)
    letters = ["a", "the", "Größe", ",", ".\"", "-", "x,y", "ß_", "×", "%%%", "'ll", "l'été", "don't", "'s", "É", "日本語", "12", "!", "''", "\x1c", "​", "<|endoftext|>", "😀"]
    spaces = [" ", " ", " ", "  ", "\n", "\n\n", "\t", " \n", "\n ", "\r\n", "\xa0", "　", "   ", "\x85"]
    for _ in range(1500):
        text = "".join(r.choice(letters + spaces) for _ in range(r.randint(0, 25)))
        assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == whole(text), repr(text)


def test_what_is_remembered_changes_no_id(encoder, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 20)
    r = random.Random(8)
    for _ in range(60):
        texts = [" ".join(f"w{r.randint(0, 60)}," for _ in range(12)) for _ in range(3)]
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == [whole(t) for t in texts]
    assert len(encoder.known) <= 20 + 36


def test_long_texts_are_cut_where_the_tokenizer_divides(encoder, monkeypatch):
    monkeypatch.setattr(T, "STEP", 100)
    r = random.Random(6)
    text = "".join(r.choice(["word", " ", "  ", "\n", " x", "\n\n", "ab" * 80]) for _ in range(4000))
    assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == whole(text)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    at, want = 0, []
    for d in docs:
        ids = np.array([*whole(d.text or ""), 2], "<u4")
        want.append((d.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, Q.op11_token_files(spark, SF).collect())) == want


def test_files_read_back_document_by_document(spark, tmp_path):
    texts = {i: f"doc {i} " * (i % 7) for i in range(-20, 60)}
    rows = [(i, t) for i, t in texts.items()]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifest = T.write_tokens(docs, f"file://{tmp_path}/t", PATH, end_id=2, parts=4)
    files = T.TokenFiles(f"{tmp_path}/t")
    assert len(manifest["parts"]) > 1 and manifest["docs"] == len(files) == 80
    assert [files[i].tolist() for i in range(80)] == [[*whole(texts[i]), 2] for i in sorted(texts)]
    raw = b"".join((tmp_path / "t" / f"{p['name']}.bin").read_bytes() for p in manifest["parts"])
    assert np.frombuffer(raw, "<u2").tolist() == [x for i in sorted(texts) for x in [*whole(texts[i]), 2]]
    with pytest.raises(IndexError):
        files[80]
    read = {r.doc_id: r.ids for r in T.read_tokens(spark, f"{tmp_path}/t", with_ids=True).collect()}
    assert read == {i: [*whole(t), 2] for i, t in texts.items()}


def test_nulls_repeats_ties_and_other_columns(spark, tmp_path):
    """Null ids first, a doc_id that fills whole ranges spread over parts, repeats kept, clashing names not read."""
    rows = [(None, "no id", "r", 1)] * 3 + [(7, f"copy {i % 5}", "r", 2) for i in range(90)] + [(9, None, "r", 3), (1, "", "r", 4), (11, "x" * 300_000, "r", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `range` string, ids int").repartition(6)
    manifest = T.write_tokens(docs, f"{tmp_path}/t", PATH, end_id=2, parts=8)
    got = [tuple(r) for r in T.read_tokens(spark, f"{tmp_path}/t").orderBy("start").collect()]
    assert [r[0] for r in got] == [None] * 3 + [1] + [7] * 90 + [9, 11]
    starts = np.cumsum([0, *(r[2] for r in got)])
    assert [r[1] for r in got] == starts[:-1].tolist() and manifest["tokens"] == starts[-1]
    assert [r[2:] for r in got if r[0] in (1, 9)] == [(1, zlib.crc32(np.array([2], "<u4").tobytes()))] * 2
    assert sum(p["docs"] < 90 for p in manifest["parts"]) == len(manifest["parts"]) > 3


def test_empty_table_and_unfinished_folder(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.write_tokens(docs, f"{tmp_path}/t", PATH, end_id=2)["parts"] == []
    assert T.read_tokens(spark, f"{tmp_path}/t").collect() == [] and len(T.TokenFiles(f"{tmp_path}/t")) == 0
    with pytest.raises(FileNotFoundError):
        T.TokenFiles(f"{tmp_path}/none")


def test_large_ids_take_four_bytes(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert T.write_tokens(docs, f"{tmp_path}/t", PATH, end_id=100_000)["dtype"] == "<u4"
    assert T.TokenFiles(f"{tmp_path}/t")[0].tolist() == [*whole("a b"), 100_000]
