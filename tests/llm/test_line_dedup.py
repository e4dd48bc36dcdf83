import random

from pyspark.sql import functions as F

from weirgate.llm import line_dedup as L

SCHEMA = "doc_id long, text string, words string, body int, pos int"


def brute(docs, min_docs, keep_first):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    lines = {i: (d, (t or "").split("\n")) for i, (d, t) in enumerate(docs)}
    where = {}
    for d, ls in sorted(lines.values(), key=lambda x: (x[0] is not None, x[0] or 0)):
        for p, line in enumerate(ls):
            where.setdefault(key(line), []).append((d, p))
    out = []
    for d, ls in lines.values():
        drop = []
        for p, line in enumerate(ls):
            at = where[key(line)]
            first = min(at, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
            if key(line) and len({x for x, _ in at}) >= min_docs and not (keep_first and (d, p) == first):
                drop.append(p)
        out.append((d or -1, len(ls), len(drop), "\n".join(x for p, x in enumerate(ls) if p not in drop)))
    return sorted(out)


def run(spark, docs, min_docs, keep_first):
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in docs], SCHEMA)
    out = L.apply_bitmaps(df, L.line_dedup(df, min_docs, keep_first))
    return sorted((-1 if r.doc_id is None else r.doc_id or -1, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect())


def test_both_policies_against_brute_force(spark):
    rng = random.Random(1)
    pool = ["", " ", "Common", "common ", "\tCOMMON\x0b", "É", "é", " x", "rare"] + [f"line {i}" for i in range(30)]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randrange(0, 90)))) for i in range(60)]
    docs += [(1000, None), (1001, ""), (1002, "\n\n"), (None, "common\nown"), (7, "another text\ncommon"), (1003, "\n".join(["common"] * 500 + ["tail"])), (1004, "z" * 200_000)]
    for min_docs, keep_first in ((10, False), (2, True), (1, False)):
        assert run(spark, docs, min_docs, keep_first) == brute(docs, min_docs, keep_first)


def test_repeated_rows_and_empty_table(spark):
    docs = [(1, "a\nb"), (1, "a\nb"), (2, "b")]
    assert run(spark, docs, 2, False) == [(1, 2, 1, "a"), (1, 2, 1, "a"), (2, 1, 1, "")]
    assert run(spark, [], 2, True) == []


def test_bitmaps_are_sparse(spark):
    df = spark.createDataFrame([(1, "\n".join(["x"] * 3 + [f"l{i}" for i in range(1000)])), (2, "x")], "doc_id long, text string")
    rows = {r.doc_id: r.words for r in L.line_dedup(df, 2, False).select("doc_id", F.col("words")).collect()}
    assert rows == {1: {0: 7}, 2: {0: 1}}
