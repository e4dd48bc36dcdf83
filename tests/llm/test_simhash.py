import random
import re

import pytest
import xxhash

from weirgate.llm import simhash

SCHEMA = "doc_id long, text string, component_id string, fp string, c long"


def slow_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    pieces = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps, radius):
    """fps: doc_id -> fingerprint; brute force over all pairs."""
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in fps}


def made_up_documents(n=260, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.choice([3, 20, 120]))) for _ in range(n // 4)]
    texts = list(base)
    while len(texts) < n:
        ws = rng.choice(base[: len(base) // 3]).split(" ")
        for _ in range(rng.choice([0, 1, 1, 2])):
            ws[rng.randrange(len(ws))] = rng.choice(words).upper()
        texts.append("\n ".join(ws))
    return [(i, t) for i, t in enumerate(texts)]


def test_components_equal_brute_force(spark):
    docs = made_up_documents()
    docs += [(1000, None), (1001, ""), (1002, " \t"), (1003, "one Two"), (1004, "é" * 30000)]
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_dedup(spark.createDataFrame(docs, "doc_id long, text string"), 4, 4).collect()}
    fps = {d: slow_fingerprint(t, 4) for d, t in docs}
    assert {d: f for d, (f, _) in got.items()} == fps
    want = slow_components(fps, 4)
    assert {d: c for d, (_, c) in got.items()} == want
    assert len(set(want.values())) < len(docs) - 50


@pytest.mark.parametrize("dense", [2, 64])
def test_dense_fingerprints_lose_no_link(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(5)
    fps = {0}
    while len(fps) < 400:  # a walk: one large component, and outliers a few bits off
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ rng.choice([0, 0, 0, (1 << rng.randrange(64)) * 7 & (2**64 - 1)]))
    signed = [(f - (f >> 63 << 64),) for f in fps]
    got = {r.fp & (2**64 - 1): r.component for r in simhash.link_components(spark.createDataFrame(signed, "fp long"), 4).collect()}
    want = slow_components({f: f for f in fps}, 4)
    pairs = lambda m: {frozenset(k for k in m if m[k] == c) for c in set(m.values())}
    assert pairs(got) == pairs(want)


def test_empty_table_nulls_and_clashing_columns(spark):
    assert simhash.simhash_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    nothing = spark.createDataFrame([(1, None), (None, None), (2, "")], "doc_id long, text string")
    assert [(r.fp, r.component_id) for r in simhash.simhash_dedup(nothing).collect()] == [(0, 1)] * 3
    rows = spark.createDataFrame([(None, "a b c d e f", "x", "y", 1), (7, "A b c d e  f", "x", "y", 1), (7, "a b c d e f", None, None, None)], SCHEMA)
    assert [r.component_id for r in simhash.simhash_dedup(rows).collect()] == [7, 7, 7]


def test_thresholds_satisfy_the_generalised_pigeonhole():
    import numpy as np

    n = 1000
    together = np.full((64, 64), n / 4)
    np.fill_diagonal(together, n / 2)
    for parts in (2, 3, 4, 5):
        groups, chances = simhash.group_bits(n, together, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        _, thresholds = simhash.allocate(n, chances, 4)
        assert sum(t + 1 for t in thresholds) == 5


def test_word_fingerprints():
    rng = random.Random(11)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    edited = list(words)
    for at in rng.sample(range(400), 8):  # five-word shingles about 0.8 similar
        edited[at] = "changed"
    a, b, other = (simhash.word_fingerprints(" ".join(x)) for x in (words, edited, words[:200][::-1] + [f"x{i}" for i in range(300)]))
    assert len(a) == simhash.SEEDS and min((x ^ y).bit_count() for x, y in zip(a, b)) <= 6 < min((x ^ y).bit_count() for x, y in zip(a, other))
    assert simhash.word_fingerprints(" ".join(words)) == simhash.word_fingerprints("\n ".join(words).upper()) == a
    assert len(simhash.word_fingerprints("a few words only")) == simhash.SEEDS_OF_FEW and simhash.word_fingerprints(None) == simhash.word_fingerprints(" ") == []


@pytest.mark.parametrize("radius", [4, 6])
def test_a_large_group_of_near_copies_equals_brute_force(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "TILE", 300)  # its buckets are dealt to several tasks
    rng = random.Random(radius)
    fps = set()
    for centre in (0x0123456789ABCDEF, 0x0123456789ABCDEF ^ 0xFF00000000, 0):
        for _ in range(2000 if centre & 0xFF else 100):
            fps.add(centre ^ sum(1 << b for b in set(rng.choices(range(64), k=rng.choice([1, 2, 3, 5, 7, 7, 20])))))
    import numpy as np

    names = np.array(sorted(fps), np.uint64)
    root = np.arange(len(names))
    for i in range(len(names)):
        hit = np.unique(root[np.bitwise_count(names ^ names[i]) <= radius])
        root[np.isin(root, hit)] = hit[0]
    want = {int(f): int(r) for f, r in zip(names, root)}
    got = {r.fp & (2**64 - 1): r.component for r in simhash.link_components(spark.createDataFrame([(f - (f >> 63 << 64),) for f in want], "fp long"), radius).collect()}
    sets = lambda m: {frozenset(k for k in m if m[k] == c) for c in set(m.values())}
    assert sets(got) == sets(want) and len(sets(want)) > 5


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def slow_near_copies(texts, radius=6, similarity=0.8):
    """texts: row -> text; links by pairs, within chains of candidates. Gives row -> smallest row of its group."""
    prints, sets = {r: simhash.word_fingerprints(t) for r, t in texts.items()}, {r: shingles(t) for r, t in texts.items()}

    def grouped(linked):
        root = {r: r for r in texts}

        def find(r):
            while root[r] != r:
                r = root[r]
            return r

        rows = sorted(texts)
        for i, b in enumerate(rows):
            for a in rows[:i]:
                if linked(a, b):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        return {r: find(r) for r in rows}

    near = grouped(lambda a, b: any((x ^ y).bit_count() <= radius for x, y in zip(prints[a], prints[b])))
    return grouped(lambda a, b: near[a] == near[b] and bool(sets[a]) and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9)


@pytest.mark.parametrize(("tile", "hubs"), [(1 << 21, 8), (3000, 2), (1000, 1)])
def test_near_copies_equal_brute_force(spark, monkeypatch, tile, hubs):
    monkeypatch.setattr(simhash, "TILE_SHINGLES", tile)  # a group's sets are dealt to several tasks
    monkeypatch.setattr(simhash, "HUBS", hubs)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for size, copies, edits in ((200, 150, (0, 1, 2, 4, 6)), (200, 40, (3, 8, 12)), (60, 40, (0, 1, 2)), (15, 20, (0, 1)), (3, 5, (0, 1))):
        base = rng.choices(words, k=size)
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice(edits)):
                own[rng.randrange(size)] = rng.choice(words)
            texts.append(" ".join(own))
    texts += [" ".join(rng.choices(words, k=rng.choice([3, 30, 300]))) for _ in range(60)] + [None, "", "...", "?", "a b", "A  b"]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, 1000 - i, t, "x") for i, t in enumerate(texts)], "row long, doc_id long, text string, hashes string")
    got = {r.row: r.near_id for r in simhash.near_copies(docs).collect()}
    want = slow_near_copies(dict(enumerate(texts)))
    largest = {c: max(r for r in want if want[r] == c) for c in set(want.values())}  # the smallest doc_id
    assert {r: got.get(r, r) for r in want} == {r: largest[c] for r, c in want.items()}
    assert 3 < len({c for r, c in got.items() if r != c}) and len(got) > 100
    # Recall by pairs: what is 0.8 similar is in one group.
    sets = [shingles(t) for t in texts]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sum(got.get(a, -1) == got.get(b, -2) for a, b in pairs) >= 0.97 * len(pairs)


def test_near_copies_of_nothing_and_of_one_id(spark):
    schema = "row long, doc_id long, text string"
    assert simhash.near_copies(spark.createDataFrame([], schema)).collect() == []
    assert simhash.near_copies(spark.createDataFrame([(0, None, None), (1, None, "")], schema)).collect() == []
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, None, text), (3, None, text + "."), (4, 9, text), (6, 9, text)]
    assert {tuple(r) for r in simhash.near_copies(spark.createDataFrame(rows, schema)).collect()} == {(5, 4), (3, 4), (4, 4), (6, 4)}
