"""Token ids as flat binary files: unsigned integers one after another, and where each document starts.

A folder holds parts `part-00000.bin` (the ids, little-endian uint16 or uint32, nothing else) with
`part-00000.idx` (documents of the part: 64-bit offsets, ids), in ascending doc_id order over all parts, and
`manifest.json`, written last: a folder without it is not complete. The manifest's bases are the prefix sums
of the parts' tokens and documents, so a document's place in the corpus is its part's base plus its offset
there. Readers map the files into memory and touch only the pages of the documents they want.

How it is made: bounds of doc_id ranges from the doc_id column alone; each task encodes what it reads and
sends packed ids to their range, once; a task sorts its range and writes one part under a name of its own,
renamed when whole, so a retried or doubled task leaves the same part. Only a row for each part goes to the
driver. An id (or null) that stands in very many rows spans several ranges and is dealt among them by its text.

Null texts are empty: one document that holds the end id alone. Null doc_ids come first. Rows that share a
doc_id are documents of their own, in the order of their texts' hashes. Strings of special tokens in a text are
ordinary text, so no text can end a document. A very long text is encoded in steps that end before a space
with which a word begins, where the tokenizer divides it anyway. An empty table gives a manifest without parts.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import mmap
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.llm.common import text_bytes, text_chunks

MAGIC = b"WGTOKEN1"
#: Bytes of text, and ids, that one step works on.
STEP, READ_IDS = 1 << 20, 1 << 20
#: Pieces that a task remembers with their ids, and the length up to which it does.
REMEMBERED, PIECE = 500_000, 64
#: White space of Unicode, at which pre-tokenisers of this kind divide.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Tiles of a text that a byte-level pre-tokeniser never joins: Latin letters with the space before them, up to
#: white space or a mark that is no apostrophe; a run without white space and the space before it; one white space character before
#: a word; white space up to the space of a word; and any other white space with what follows.
LATIN, MARKS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", r"!-&(-/:-@\[-`{-~"
TILES = re.compile(f" ?[{LATIN}]++(?=[{MARKS}{SPACE}])| ?[^{SPACE}]++|[{SPACE}](?=[^{SPACE}])|[{SPACE}]+(?= [^{SPACE}])|[{SPACE}]+[^{SPACE}]*")
WORD = re.compile(f" (?=[^{SPACE}])")


class Encoder:
    """Packed ids of texts. `tokenizer` is the JSON of a tokenizer file."""

    def __init__(self, tokenizer: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.encode_special_tokens = True
        said = json.loads(tokenizer)
        first = said.get("pre_tokenizer") or {}
        #: Whether texts may be tiled: byte-level division by words, and nothing that looks beyond a tile.
        self.tiled = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", True) and not said.get("normalizer")
        self.dtype = np.dtype(dtype)
        #: Bytes of each id: a byte-level vocabulary has a character for each byte.
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        #: Ids of tiles, and the tiles met again since the last time that they were too many.
        self.known: dict[str, bytes] = {}
        self.again: set[str] = set()

    def _ids(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.dtype.itemsize == 2 else "I"
        packed = [array(kind, x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if sys.byteorder == "big":
            for x in packed:
                x.byteswap()
        return [x.tobytes() for x in packed]

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        """Of words that begin with a space and are letters else: encoded as one text, which the tokenizer divides at these spaces."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(w.encode()) for w in words]), side="left") + 1
        packed, size = ids.tobytes(), self.dtype.itemsize
        bounds = [0, *(ends * size).tolist()]
        return [packed[a:b] for a, b in itertools.pairwise(bounds)]

    def _steps(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            cut = WORD.search(text, at + STEP) if len(text) - at > STEP else None
            to = cut.start() if cut else len(text)
            yield text[at:to]
            at = to

    def _tiled(self, texts: list[str]) -> list[bytes]:
        tiles = [TILES.findall(t) for t in texts]
        there = set().union(*tiles)
        new = [t for t in there if t not in self.known]
        self.again |= there.difference(new)
        words = [t for t in new if t[0] == " " and t[1:].isalpha()]
        self.known.update(zip(words, self._ids_of_words(words), strict=True))
        other = [t for t in new if t not in self.known]
        self.known.update(zip(other, self._ids(other), strict=True))
        out = [b"".join(map(self.known.__getitem__, t)) for t in tiles]
        for t in new:
            if len(t) > PIECE:
                del self.known[t]
        if len(self.known) > REMEMBERED:  # what came only once goes
            self.known = {t: self.known[t] for t in self.again if t in self.known}
            self.again = set()
            if len(self.known) > REMEMBERED // 2:
                self.known = {}
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed."""
        if not self.tiled:
            return self._ids(texts)
        if sum(map(len, texts)) <= STEP:
            return self._tiled(texts)
        return [b"".join(self._tiled([step])[0] for step in self._steps(t)) for t in texts]


def _encoder(tokenizer: str, dtype: str) -> Encoder:
    """The worker's encoder. Functions come to workers by value, so it is kept where the next task of the process finds it."""
    kept = sys.__dict__.setdefault("_weirgate_encoders", {})
    key = (hashlib.sha256(tokenizer.encode()).digest(), dtype)
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(tokenizer, dtype)
    return kept[key]


def _packed(tokenizer, dtype: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer.value, dtype)
        end = np.array([end_id], dtype).tobytes()
        for part in text_chunks(batches, "text"):
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            ids = [x + end for x in encoder.encode([t or "" for t in texts])]
            columns = [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "range", "tie")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], names=["doc_id", "range", "tie", "ids"])

    return run


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))


def _index(offsets: array, doc_ids: array, named: bytearray, size: int) -> bytes:
    """Magic, bytes of an id, number of documents, then offsets (one more than documents), doc_ids, and 0 where a doc_id is null."""
    head = MAGIC + np.array([size, len(doc_ids)], "<u8").tobytes()
    return head + np.array(offsets, "<u8").tobytes() + np.array(doc_ids, "<i8").tobytes() + bytes(named)


def _write_parts(folder: str, dtype: str):
    size = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, root = _filesystem(folder)
        mine, out, offsets, doc_ids, named, part = uuid.uuid4().hex, None, array("q", [0]), array("q"), bytearray(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(1)[0].as_py()
            if out is None:
                out = fs.open_output_stream(f"{root}/_{mine}.bin")
            data, ends = text_bytes(batch.column(3))
            out.write(data)
            offsets.extend((ends // size + offsets[-1]).tolist())
            doc_ids.extend(batch.column(0).fill_null(0).to_pylist())
            named.extend(batch.column(0).is_valid().cast(pa.uint8()).to_pylist())
        if out is None:
            return
        out.close()
        with fs.open_output_stream(f"{root}/_{mine}.idx") as f:
            f.write(_index(offsets, doc_ids, named, size))
        name = f"part-{part:05d}"
        for kind in ("bin", "idx"):
            fs.move(f"{root}/_{mine}.{kind}", f"{root}/{name}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(doc_ids)], pa.int64()), pa.array([offsets[-1]], pa.int64())], names=["part", "name", "docs", "tokens"])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, parts: int | None = None) -> dict:
    """Encode docs (doc_id long, text) into `folder`, which all executors see, and return the manifest.

    `tokenizer` is a tokenizer file of the tokenizers library on the driver; it is sent to the tasks (a few MB).
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        said = f.read()
    dtype = "<u2" if max(Tokenizer.from_str(said).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    shares = [i / parts for i in range(1, parts)]
    bounds = docs.agg(F.percentile_approx(key, shares, max(10_000, 10 * parts))).first()[0] if shares else []
    # Places that a key may take; more than one only if it fills whole ranges.
    below, upto = (F.size(F.filter(F.lit(bounds or []).cast("array<long>"), f)) for f in (lambda b: b < key, lambda b: b <= key))
    tie = F.xxhash64("text")
    place = (below + F.pmod(tie, F.greatest(upto - below, F.lit(1)).cast("long"))).cast("int") if bounds else F.lit(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), place.alias("range"), tie.alias("tie"))
    packed = rows.mapInArrow(_packed(spark.sparkContext.broadcast(said), dtype, end_id), "doc_id long, range int, tie long, ids binary")
    placed = packed.repartitionById(parts, F.col("range")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")
    written = sorted(placed.mapInArrow(_write_parts(folder, dtype), "part int, name string, docs long, tokens long").collect())  # a row for each part
    manifest: dict = {"dtype": dtype, "end_id": end_id, "parts": [], "docs": 0, "tokens": 0}
    for _, name, n_docs, n_tokens in written:
        manifest["parts"].append({"name": name, "docs": n_docs, "tokens": n_tokens, "first_doc": manifest["docs"], "first_token": manifest["tokens"]})
        manifest["docs"] += n_docs
        manifest["tokens"] += n_tokens
    with fs.open_output_stream(f"{root}/_manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    fs.move(f"{root}/_manifest.json", f"{root}/manifest.json")
    return manifest


class Part:
    """One part, mapped into memory where the file system is a local or mounted one."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: str):
        index, self.ids = self._mapped(fs, f"{path}.idx"), np.frombuffer(self._mapped(fs, f"{path}.bin"), dtype)
        size, n = (int(x) for x in np.frombuffer(index, "<u8", 2, 8))
        if bytes(index[:8]) != MAGIC or size != np.dtype(dtype).itemsize:
            raise ValueError(f"{path}.idx is no index of such a part")
        self.offsets = np.frombuffer(index, "<u8", n + 1, 24).astype(np.int64)
        self.doc_ids = np.frombuffer(index, "<i8", n, 24 + 8 * (n + 1))
        self.named = np.frombuffer(index, np.uint8, n, 24 + 8 * (2 * n + 1))

    @staticmethod
    def _mapped(fs: pafs.FileSystem, path: str):
        if isinstance(fs, pafs.LocalFileSystem):
            with open(path, "rb") as f:
                return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        with fs.open_input_file(path) as f:
            return f.read()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


class TokenFiles:
    """Random access over a folder: len(files), files[i] -> ids of the i-th document of the corpus."""

    def __init__(self, folder: str):
        self.fs, self.root = _filesystem(folder)
        with self.fs.open_input_file(f"{self.root}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.firsts = np.array([p["first_doc"] for p in self.manifest["parts"]], np.int64)
        self.open: dict[int, Part] = {}

    def __len__(self) -> int:
        return self.manifest["docs"]

    def part(self, k: int) -> Part:
        if k not in self.open:
            self.open[k] = Part(self.fs, f"{self.root}/{self.manifest['parts'][k]['name']}", self.manifest["dtype"])
        return self.open[k]

    def __getitem__(self, i: int) -> np.ndarray:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self.firsts, i, side="right")) - 1
        return self.part(k).document(i - int(self.firsts[k]))


def _read_parts(folder: str, dtype: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = Part(fs, f"{root}/{name}", dtype)
                at = 0
                while at < len(part):
                    to = max(at + 1, int(np.searchsorted(part.offsets, part.offsets[at] + READ_IDS, side="right")) - 1)
                    docs = [part.document(i).astype("<u4") for i in range(at, to)]
                    columns = [
                        pa.array(part.doc_ids[at:to], pa.int64(), mask=part.named[at:to] == 0), pa.array(part.offsets[at:to] + first), pa.array(np.diff(part.offsets[at : to + 1])),
                        pa.array([zlib.crc32(d) for d in docs], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array([d.astype(np.int64) for d in docs], pa.list_(pa.int64()))] * with_ids, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
                    at = to

    return run


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, read from the files; a task for each part."""
    manifest = TokenFiles(folder).manifest
    rows = [(p["name"], p["first_token"], i) for i, p in enumerate(manifest["parts"])]
    frame = spark.createDataFrame(rows, "name string, first long, i int").repartitionById(max(1, len(rows)), F.col("i"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return frame.select("name", "first").mapInArrow(_read_parts(folder, manifest["dtype"], with_ids), schema)
