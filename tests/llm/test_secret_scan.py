import base64
import bz2
import gzip
import random
import re
import time
import zlib
from urllib.parse import quote

import zstandard

from weirgate.llm import secret_scan as s

KEY = "AKIA" + "ABCDEFGHIJ234567"


def brute(text):
    found = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    for k, p, n in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        found += [(m.start(), k, m.end()) for m in re.finditer(p, text) if m.end() - m.start() >= n]
    return sorted(found)


def spans(text):
    return s.written(s.scan(text)[1])


def test_base_patterns():
    text = f'é "Api_Key": "abc.def=" token=token:abcdefgh {KEY} x{"0a" * 12}g passſword=abcdefgh'
    assert s.find_secrets(text) == brute(text)
    assert [k for _, k, _ in s.find_secrets(text)] == [0, 1, 2]


def test_nested_layers_map_to_their_run():
    inner = f"password = hunter2hunter2 and {KEY}"
    for wrap in (lambda b: b, gzip.compress, zstandard.compress):
        run = base64.b64encode(wrap(inner.encode())).decode()
        text = f"é see {run} end"
        at, to = 6, 6 + len(run)
        assert f"assign:{at}:{to},access:{at}:{to}" == ",".join(x for x in spans(text).split(",") if x.endswith(f":{at}:{to}"))
        twice = base64.b64encode(run.encode()).decode()
        assert f"assign:0:{len(twice)}" in spans(twice)


def test_escapes_map_by_character():
    assert spans("x " + quote("token=abcdef", safe="").replace("token", "%74oken")) == "assign:2:18"
    assert spans("\\u0074oken=abcdef\\u0021") == "assign:0:17"
    assert spans("%2574oken=abcdef") == "assign:0:16"  # unwrapped twice
    assert spans("&#116;oken: abcdef") == "assign:0:18"


def test_ends_on_cycles_and_junk():
    assert spans("%%%%25%25 \\u00ZZ &#x110000; " + "A" * 400) == ""
    assert s.scan("") == ([], [])


def test_frame_equals_row_by_row(spark):
    rng = random.Random(2)
    parts = ["é", "über ", "token=abcdef1 ", KEY + " ", "0123456789abcdef" * 2, " ", "deadbeef", "\n", base64.b64encode(f"secret: {KEY}".encode()).decode() + " ", "%41%4b%49%41" + KEY[4:], "\\x41"]
    docs = [(i, "".join(rng.choices(parts, k=rng.randrange(40)))) for i in range(300)] + [(None, None), (5, ""), (5, "x" * 3_000_000 + "token=abcdef1")]
    got = s.secret_scan(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id as base", "text as spans").repartition(3)).collect()
    want = sorted((d or -1, s.written(brute(t or "")), s.written(s.scan(t or "")[1])) for d, t in docs)
    assert sorted((-1 if r.doc_id is None else r.doc_id or -1, r.base, r.spans) for r in got) == want
    assert s.secret_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def inside(text, span):
    at, to = span
    return {x.split(":")[0] for x in spans(text).split(",") if x and at <= int(x.split(":")[1]) and int(x.split(":")[2]) <= to and x.split(":")[0] in ("assign", "access")}


def test_layers_that_are_wrapped_packed_twice_or_stand_in_a_path():
    secret = f"x = 1; password = hunter2hunter2; {KEY}".encode()
    rest = random.Random(1).randbytes(400).hex().encode()
    b64 = lambda b: base64.b64encode(b).decode()
    lines = lambda t, n=76, end="\n": end.join(t[i : i + n] for i in range(0, len(t), n))
    for data in (secret, rest + secret + rest, gzip.compress(rest + secret), gzip.compress(rest) + gzip.compress(secret), bz2.compress(rest) + bz2.compress(secret), zstandard.compress(rest) + zstandard.compress(secret),
                 zlib.compress(secret), gzip.compress(b64(gzip.compress(secret)).encode()), gzip.compress(bz2.compress(zstandard.compress(secret))), b"\x01\xff" + secret + b"\x00\xfe"):
        for form in (lambda t: t, lines, lambda t: lines(t, 64, "\r\n"), lambda t: lines(t, 20, "\n  ")):
            text = f"é see {form(b64(data))} end"
            assert inside(text, (6, len(text) - 4)) == {"assign", "access"}, (data[:20], form("x" * 100))
    for before in ("/data/", "a/", "ab-", "https://example.org/q/"):
        text = before + b64(b"\x01" + secret)
        assert inside(text, (0, len(text))) == {"assign", "access"}, before
        text = before + b64(gzip.compress(secret))
        assert inside(text, (0, len(text))) == {"assign", "access"}, before
    assert spans("%FF%74oken=abcdef") == "assign:0:17"


def test_pieces_of_unpacked_data(monkeypatch):
    monkeypatch.setattr(s, "PIECE", 1 << 20)
    for where in (0, 1_000_000, (1 << 20) - 10, 2_500_000):
        plain = b" " * where + f"token=abcdef1 {KEY}".encode() + b" " * (3_000_000 - where)
        for pack in (gzip.compress, bz2.compress, zstandard.compress):
            run = base64.b64encode(pack(plain)).decode()
            assert inside(run, (0, len(run))) == {"assign", "access"}, (where, pack)


def test_data_that_unpacks_to_itself_ends(monkeypatch):
    calls = []

    def same(data):
        calls.append(1)
        yield data

    monkeypatch.setattr(s, "unpacked", same)
    assert spans(base64.b64encode(gzip.compress(b"nothing")).decode()) == "" and len(calls) <= 2
    monkeypatch.setattr(s, "unpacked", lambda data: iter([data + b"!"]))  # something new for ever
    assert spans(base64.b64encode(gzip.compress(b"nothing")).decode()) == ""


def deflated(data):
    stream = zlib.compressobj(wbits=-15)
    return stream.compress(data) + stream.flush()


def test_zlib_behind_a_head_utf_16_and_bare_deflate():
    plain = f"token=abcdef1 {KEY}".encode()
    b64 = lambda data: base64.b64encode(data).decode()
    bare = (deflated(plain), deflated(plain * 9000))
    for data in (b"head" + zlib.compress(plain), zlib.compress(b"x" + zlib.compress(plain)), plain.decode().encode("utf-16"), plain.decode().encode("utf-16-be"), *bare, gzip.compress(plain.decode().encode("utf-16-le"))):
        run = b64(data)
        assert inside(run, (0, len(run))) == {"assign", "access"}, data[:40]
        if data not in bare:  # which has no mark
            assert {x.split(":")[0] for x in spans(f"data/{run}").split(",")} == {"assign", "access"}, data[:40]
    whole = "é Größe token=abcdef1"
    assert spans(b64(whole.encode("utf-16-le"))) and spans(b64(zlib.compress(plain)[:-6]))  # cut short, too
    assert spans(b64(deflated(b"nothing to be found here"))) == spans(b64(bytes(range(256)))) == ""


def test_layers_deeper_than_any_limit():
    data = f"token=abcdef1 {KEY}".encode()
    for _ in range(130):
        data = gzip.compress(data)
    run = base64.b64encode(data).decode()
    base, found, complete = s.worked_off(run)
    assert {k for _, k, _ in found} == {0, 1} and complete and not base


def test_what_never_ends_is_reported(spark, monkeypatch):
    monkeypatch.setattr(s, "unpacked", lambda data: iter([bytes(data) + b"!"]))
    assert not s.worked_off(base64.b64encode(gzip.compress(b"nothing")).decode())[2]
    monkeypatch.undo()
    docs = spark.createDataFrame([(1, "token=abcdef1"), (2, None), (3, "plain")], "doc_id long, text string")
    assert [r.complete for r in s.secret_scan(docs).collect()] == [True] * 3


def test_false_headers_cost_little():
    data = b"\x78\x9c" * 500_000 + b"token=abcdef1"
    run = base64.b64encode(data).decode()
    begin = time.perf_counter()
    assert inside(run, (0, len(run))) == {"assign"}
    assert time.perf_counter() - begin < 20


def wrap(data, rng, depth):
    """A text with `data` under `depth` layers, and that many layers as functions of text."""
    text = data
    for _ in range(depth):
        kind = rng.randrange(5)
        raw = text.encode()
        if kind == 0:
            text = "".join(f"%{b:02X}" for b in raw)
        elif kind == 1:
            text = "".join(f"\\u{ord(c):04x}" for c in text)
        elif kind == 2:
            text = base64.b64encode(raw).decode()
        elif kind == 3:
            text = base64.urlsafe_b64encode(rng.choice([gzip.compress, zstandard.compress, bz2.compress, zlib.compress])(raw)).decode()
        else:
            text = "".join(f"&#{ord(c)};" for c in text)
    return text


def test_nested_layers_are_all_found():
    rng = random.Random(9)
    for _ in range(200):
        plain = rng.choice(["token=abcdef12", f"see {KEY} there", "secret: 'qwertz99'"])
        text = wrap(plain, rng, rng.randrange(1, 6))
        assert {k for _, k, _ in s.scan(f"a {text} b")[1]} >= {k for _, k, _ in brute(plain)}, text[:200]
