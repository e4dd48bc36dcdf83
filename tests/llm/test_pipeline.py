import re

import corpus_pipeline as P
from weirgate.llm import mixing
from weirgate.llm.simhash import word_fingerprints

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def holds(item, text, k):
    """Whether some stretch of text is within k word edits of item."""
    if len(set(item) & set(text)) < len(set(item)) * 0.5:
        return False
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row) <= k


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def grouped(ids, linked):
    """id -> smallest id that links reach."""
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(ids)
    for i, b in enumerate(ids):
        for a in ids[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, "12 %", "en", "src0", 4), (-2, None, None, None, None), (10**6, docs.first().text, "en", "src0", 5)], docs.schema)
    docs = docs.unionByName(odd)
    kept = []
    for _, stage in P.STAGES:
        rows = stage(spark, docs, SF).collect()
        kept.append(rows)
        docs = spark.createDataFrame([r[:5] for r in rows], docs.schema)
        assert rows and set(P.COLUMNS) <= set(rows[0].asDict())
    start = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()} | {10**6: kept[0][0].text}
    language, exact, near, clean, mixed = ([r.doc_id for r in rows] for rows in kept)
    # Language ID rejects what has no letter, and keeps all else.
    assert not {-1, -2} & set(language) and len(language) == 1 + sum(bool(re.search(r"[^\W\d_]", t)) for d, t in start.items() if d < 10**6)
    # Exact dedup keeps the first of equal contents.
    first = {}
    for d in sorted(language):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", start[d]), d)
    assert sorted(exact) == sorted(first.values())
    # Near-dedup keeps the first of each group of documents whose five-word shingles are 0.8 similar.
    prints, sets = {d: word_fingerprints(start[d]) for d in exact}, {d: shingles(start[d]) for d in exact}
    candidates = grouped(exact, lambda a, b: any((x ^ y).bit_count() <= P.NEAR_BITS for x, y in zip(prints[a], prints[b])))
    groups = grouped(exact, lambda a, b: candidates[a] == candidates[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert sorted(near) == sorted(set(groups.values())) and len(near) < len(exact)
    # Decontamination drops what holds an item.
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d in near if any(holds(i, words(start[d]), int(0.2 * len(i) + 1e-9)) for i in items if len(i) >= 5)}
    assert set(clean) == set(near) - leaks and leaks
    # Mixing keeps documents by their probability alone.
    probability = {r.doc_id: r for r in mixing.mix(spark.createDataFrame([r[:5] for r in kept[3]], docs.schema)).collect()}
    assert set(mixed) == {d for d, r in probability.items() if r.kept}


def test_rows_with_null_or_shared_ids_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    long = max((r.text for r in docs.where("lang = 'en'").collect()), key=len)
    some = [" ".join(f"{w}{i}" for w in "one two three four five six seven eight nine ten".split()) for i in range(4)]
    rows = [(None, some[0]), (None, some[0] + " more"), (None, some[1]), (7, some[2]), (7, item), (7, long * 20), (8, f"{some[3]} {item}"), (None, item)]
    odd = spark.createDataFrame([(d, t, "en", "src0", 1, "x", 5, True) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, near_id int, kept boolean")
    near = [(r.doc_id, r.text) for r in P.drop_near_copies(spark, odd, SF).collect()]
    key = lambda x: (x[0] or 0, x[1])
    assert sorted(near, key=key) == sorted((x for x in rows if x not in ((None, some[0] + " more"), (None, item))), key=key)
    clean = [(r.doc_id, r.text) for r in P.drop_benchmark_leaks(spark, odd, SF).collect()]
    assert sorted(clean, key=key) == sorted((x for x in rows if item not in x[1]), key=key)
    mixed = P.mix_sources(spark, odd, SF)
    assert mixed.columns == [*P.COLUMNS, "topic", "n_tokens", "probability"] and len(mixed.collect()) == len({(r.doc_id, r.text) for r in mixed.collect()})


def test_run_and_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []


def test_language_stage_rejects_what_no_language_explains(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = next(r.text for r in docs.where("lang = 'fr'").orderBy("doc_id").collect() if len(r.text) > 300)
    odd = [(-1, "qzxv kjwq xzzq vvkq zzxj wqxk jjzx " * 5, None), (-2, "Быстрая коричневая лиса прыгает через ленивую собаку", None), (-3, "szybki brązowy lis przeskakuje nad leniwym psem i biegnie do domu przez las", "en"), (-4, text, None)]
    odd = spark.createDataFrame([(d, t, lang, "src0", len(t)) for d, t, lang in odd], docs.schema)
    rows = {r.doc_id: r for r in P.identify_language(spark, docs.unionByName(odd), SF).collect()}
    assert not {-1, -2, -3} & set(rows) and rows[-4].lang == "fr"
    assert len(rows) == 1 + docs.count()
