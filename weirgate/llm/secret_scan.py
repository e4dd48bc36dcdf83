"""Secret scans with a recursive decoding worklist.

A text is a first layer. Every layer is scanned for secrets, and what it holds in URL, Unicode-escape,
base64 or compressed form is decoded into further layers, until no layer yields an unseen one (layers
are known by digest, so a layer that decodes to an earlier one ends there). Each layer maps its
characters to a range of the original text, and so do the secrets found in it: escapes map character by
character, a base64 run as a whole.

Base64 is read in every alignment of a run, so that what stands before it in a path or URL does no harm, and
also over line breaks, as mail and keys wrap it. Compressed data is unpacked wherever it begins in a decoded
layer, all its members, PIECE bytes at a time with OVERLAP in common; deflate without a header, which has no mark, only
where it takes the whole of a decoded layer. Decoded UTF-16 is read too. Bytes that are no characters separate.

Defined results: null texts are empty; ids, ties and repeated rows pass through row by row; very long texts
are read whole; an empty table gives an empty result; other columns are ignored, whatever their names.
Some data unpacks to something new for ever: of layers deeper than DEPTH as many are opened as take DEEP bytes
together for a text, and `complete` is false where that was not enough.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from weirgate.llm.common import text_bytes, text_chunks

#: Fixed values of the contract: kinds in order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
WORDS = ("password", "passwd", "secret", "token", "api")

#: Shortest base64 run that is tried (no shorter one can hold a secret).
BASE64_LEAST = 16
#: Layers deeper than DEPTH are opened until they take DEEP bytes together, each LAYER at least.
DEPTH, DEEP, LAYER = 100, 16 << 20, 1024
#: Bytes of packed data that are read at once.
STEP = 1 << 16
#: Bytes of unpacked data that are scanned at once (also the most that packed data inside packed data may take), and what two pieces share.
PIECE, OVERLAP = 64 << 20, 1 << 16
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]++)+={0,2}")
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: Where gzip, bzip2, zstd and zlib data begins.
PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
#: Runs of ASCII characters in UTF-16, of either byte order.
WIDE = re.compile(rb"(?:[\t-~]\x00){8,}|(?<![\t-~])(?:\x00[\t-~]){8,}")
#: What decoded bytes must hold to be worth a layer.
PROMISING = re.compile(rb"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[uUx]|&#|[A-Za-z0-9+/_-]{16}|" + PACKED.pattern + b"|" + WIDE.pattern)


def find_assign(text: str) -> list[tuple[int, int]]:
    lower = text.lower()
    if not any(w in lower for w in WORDS):
        return []
    return [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]


def find_access(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST] if "AKIA" in text else []


def find_hex(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns, in order."""
    return sorted((s, k, e) for k, find in enumerate((find_assign, find_access, find_hex)) for s, e in find(text))


class Layer:
    """Decoded text; `starts` and `ends` give each character's range in the original, or `whole` that of all.

    `data` are the bytes that a layer was read from, where it may be packed.
    """

    def __init__(self, text: str, starts=None, ends=None, whole: tuple[int, int] | None = None, data: bytes | None = None, depth: int = 0):
        self.text, self.starts, self.ends, self.whole, self.data, self.depth = text, starts, ends, whole, data, depth

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        if self.starts is None:
            return start, end
        return self.starts[start], self.ends[end - 1]

    def mark(self) -> bytes:
        digest = hashlib.blake2b(repr(self.whole).encode(), digest_size=16)
        digest.update(self.text.encode("utf-8", "surrogatepass") if self.data is None else self.data)
        return digest.digest()


def replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with all matches that `decode` understands replaced, if there is one."""
    text, out, starts, ends, at = layer.text, [], [], [], 0
    for m in pattern.finditer(text):
        new = decode(m)
        if new is None:
            continue
        out += [text[at : m.start()], new]
        if not layer.whole:
            for i in range(at, m.start()):
                s, e = layer.origin(i, i + 1)
                starts.append(s)
                ends.append(e)
            s, e = layer.origin(*m.span())
            starts += [s] * len(new)
            ends += [e] * len(new)
        at = m.end()
    if not out:
        return None
    out.append(text[at:])
    if not layer.whole:
        for i in range(at, len(text)):
            s, e = layer.origin(i, i + 1)
            starts.append(s)
            ends.append(e)
    return Layer("".join(out), starts, ends, layer.whole, depth=layer.depth + 1)


def from_url(m: re.Match) -> str:
    return bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")


def from_escape(m: re.Match) -> str | None:
    point = int(m[6]) if m[6] else int(next(x for x in m.groups() if x), 16)
    return chr(point) if point < 0x110000 and not 0xD800 <= point < 0xE000 else None


def is_zlib(data: bytes) -> bool:
    return data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0


def _unpacked(data: bytes | memoryview) -> Iterator[bytes]:
    """What gzip, zlib, bzip2 or zstd data holds, all members, up to where it breaks off."""
    try:
        if data[:4] == b"\x28\xb5\x2f\xfd":
            with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as reader:
                while chunk := reader.read(1 << 20):
                    yield chunk
            return
        at = 0
        while data[at : at + 2] == b"\x1f\x8b" or is_zlib(data[at : at + 3]):
            member, held = zlib.decompressobj(47), b""
            while not member.eof:
                if not held:
                    held = bytes(data[at : at + STEP])
                    at += len(held)
                    if not held:
                        yield member.flush()
                        return
                if chunk := member.decompress(held, 1 << 20):
                    yield chunk
                held = member.unconsumed_tail
            at -= len(member.unused_data)
        while data[at : at + 3] == b"BZh":
            member = bz2.BZ2Decompressor()
            while not member.eof:
                held = bytes(data[at : at + STEP]) if member.needs_input else b""
                at += len(held)
                if member.needs_input and not held:
                    return
                if chunk := member.decompress(held, 1 << 20):
                    yield chunk
            at -= len(member.unused_data)
    except (zlib.error, OSError, zstandard.ZstdError, EOFError, ValueError):
        return


def _inflated(data: bytes) -> Iterator[bytes]:
    """What deflate data without a header holds, nothing unless it is the whole of data."""
    for giving in (False, True):
        stream, held, at = zlib.decompressobj(-15), b"", 0
        while not stream.eof:
            if not held:
                held = data[at : at + STEP]
                at += len(held)
                if not held:
                    return
            try:
                chunk = stream.decompress(held, 1 << 20)
            except zlib.error:
                return
            if giving and chunk:
                yield chunk
            held = stream.unconsumed_tail
        if stream.unused_data or at < len(data):
            return


def is_deflate(data: bytes) -> bool:
    return any(PROMISING.search(x) for x in pieces(_inflated(data)))


def wide(data: bytes) -> str:
    """The ASCII runs of UTF-16 data, apart from each other."""
    return "\ufffd".join(m[0].replace(b"\0", b"").decode() for m in WIDE.finditer(data))


def unpacked(data: bytes | memoryview) -> Iterator[bytes]:
    """Pieces of what packed data holds."""
    return pieces(_unpacked(data))


def pieces(chunks: Iterator[bytes]) -> Iterator[bytes]:
    held, size = [], 0
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk)
        if size >= PIECE:
            piece = b"".join(held)
            yield piece
            held, size = [piece[-OVERLAP:]], 0
    if size or held and len(held) > 1:
        yield b"".join(held)


def decoded(run: str) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of a base64 run in its four alignments, where they are worth a layer."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    for offset in range(4):
        own = body[offset:]
        own = own[: len(own) - (len(own) % 4 == 1)]
        if len(own) >= BASE64_LEAST:
            data = base64.b64decode(own + "=" * (-len(own) % 4))
            if PROMISING.search(data) or not offset and (is_zlib(data) or is_deflate(data)):
                yield offset, data


def runs_of_base64(text: str) -> list[tuple[int, int]]:
    """Base64 runs, each by itself and joined over line breaks."""
    return [m.span() for m in BASE64.finditer(text)] + wrapped_runs(text)


def wrapped_runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in WRAPPED.finditer(text)] if "\n" in text else []


def opened(layer: Layer, runs: list[tuple[int, int]]) -> Iterator[Layer]:
    """The layers directly inside a layer."""
    text, depth = layer.text, layer.depth + 1
    if layer.data is not None:
        data = memoryview(layer.data)
        begins = [m.start() for m in PACKED.finditer(layer.data)]
        for at in begins if 0 in begins or not is_zlib(layer.data) else [0, *begins]:
            for piece in unpacked(data[at:] if at else layer.data):
                yield Layer(piece.decode("utf-8", "replace"), whole=layer.whole, data=piece, depth=depth)
        if 0 not in begins:
            for piece in pieces(_inflated(layer.data)):
                yield Layer(piece.decode("utf-8", "replace"), whole=layer.whole, data=piece, depth=depth)
        if told := wide(layer.data):
            yield Layer(told, whole=layer.whole, data=told.encode(), depth=depth)
    if "%" in text and (new := replaced(layer, URL, from_url)):
        yield new
    if ("\\" in text or "&#" in text) and (new := replaced(layer, ESCAPE, from_escape)):
        yield new
    for s, e in runs:
        run = re.sub(r"\s+", "", text[s:e])
        for offset, data in decoded(run):
            # Offsets are less than the first line of a run.
            yield Layer(data.decode("utf-8", "replace"), whole=layer.origin(s + offset, e), data=data, depth=depth)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, kind's number, end) in the original."""
    return worked_off(text)[:2]


def worked_off(text: str, base: list[tuple[int, int, int]] | None = None, runs: list[tuple[int, int]] | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], bool]:
    """The same, and whether all layers were opened. What is known of the first layer may be given."""
    base = find_secrets(text) if base is None else base
    first = Layer(text)
    found, seen, deep = set(base), {first.mark()}, 0
    work = [opened(first, runs_of_base64(text) if runs is None else runs)]
    while work:  # children are made one at a time, so that few layers are held at once
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        mark = layer.mark()
        if mark in seen:
            continue
        seen.add(mark)
        for s, k, e in find_secrets(layer.text):
            start, end = layer.origin(s, e)
            found.add((start, k, end))
        if layer.depth > DEPTH:
            deep += len(layer.text) + LAYER
        if deep <= DEEP:
            work.append(opened(layer, runs_of_base64(layer.text)))
    return base, sorted(found), deep <= DEEP


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def long_runs(inside: np.ndarray, text_end: np.ndarray, least: int) -> list[list[tuple[int, int]]]:
    """For each text, the byte ranges, from its own start, of maximal runs of at least `least` bytes that are inside."""
    edges = np.zeros(len(inside) + 1, bool)
    edges[1:-1] = inside[1:] != inside[:-1]
    if len(inside):
        edges[0], edges[-1] = inside[0], inside[-1]
    edges[text_end[:-1]] |= np.append(inside, False)[text_end[:-1]]
    at = np.flatnonzero(edges)
    out: list[list[tuple[int, int]]] = [[] for _ in text_end]
    if len(at) > 1:
        begin, end = at[:-1], at[1:]
        keep = (end - begin >= least) & inside[begin]
        row = np.searchsorted(text_end, begin[keep], side="right")
        first = np.concatenate([[0], text_end[:-1]])[row]
        for r, s, e in zip(row.tolist(), (begin[keep] - first).tolist(), (end[keep] - first).tolist(), strict=True):
            out[r].append((s, e))
    return out


def byte_class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def secret_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans, complete) for each row; base and spans as in `written`, by code point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexes = byte_class(b"0123456789abcdef")
        b64 = byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
        for batch in text_chunks(batches, "text"):
            data, text_end = text_bytes(batch.column("text"))
            hex_runs = long_runs(hexes[data], text_end, HEX_LEAST)
            b64_runs = long_runs(b64[data], text_end, BASE64_LEAST)
            raw, first, out = data.tobytes(), 0, []
            for text, to, hs, bs in zip(batch.column("text").to_pylist(), text_end.tolist(), hex_runs, b64_runs, strict=True):
                text, own = text or "", raw[first:to]
                first = to
                if len(text) == len(own):
                    point = lambda i: i
                else:
                    point = lambda i, own=own: len(own[:i].decode("utf-8", "surrogatepass"))
                base = sorted([(s, 0, e) for s, e in find_assign(text)] + [(s, 1, e) for s, e in find_access(text)] + [(point(s), 2, point(e)) for s, e in hs])
                runs = []
                for s, e in bs:
                    e += len(own[e : e + 2]) - len(own[e : e + 2].lstrip(b"="))
                    if next(decoded(own[s:e].decode()), None):
                        runs.append((point(s), point(e)))
                if bs:
                    runs += wrapped_runs(text)
                if not base and not runs and "%" not in text and "\\" not in text and "&#" not in text:
                    out.append((0, 0, 0, "", "", True))
                    continue
                base, spans, complete = worked_off(text, base, runs)
                out.append((*(sum(k == i for _, k, _ in base) for i in range(3)), written(base), written(spans), complete))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "complete"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string, complete boolean")
