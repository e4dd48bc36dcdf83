import numpy as np
import pytest
from pyspark.sql import functions as F

from weirgate.llm import mixing

SF = "/root/testdata/sf0.01/documents.parquet"


def test_raked_marginals_meet_the_targets(spark):
    docs = spark.read.parquet(SF)
    targets = {"source": {f"src{i}": 1.0 + (i % 3) for i in range(20)}, "lang": {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}}
    got = mixing.mix(docs, targets).toPandas()
    assert len(got) == docs.count() and got.probability.between(0, 1).all() and got.probability.max() == 1
    w = got.n_tokens * got.probability
    for m, want in targets.items():
        share = w.groupby(got[m]).sum() / w.sum()
        for value, x in want.items():
            assert share[value] == pytest.approx(x / sum(want.values()), abs=mixing.SHORTAGE + 0.002)
    assert got.kept.mean() > 0.3
    exact = mixing.mix(docs, targets, shortage=0.0).toPandas()
    w = exact.n_tokens * exact.probability
    assert exact.probability.max() == pytest.approx(1) and (w.groupby(exact.lang).sum() / w.sum())["en"] == pytest.approx(0.4, rel=1e-2)
    words = {r.doc_id: r.n for r in docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[A-Za-z0-9\\u0080-\\uFFFF]+"), F.lit(0))).alias("n")).collect()}
    assert dict(zip(got.doc_id, got.n_tokens)) == words
    assert abs(got.kept.mean() - got.probability.mean()) < 0.06
    again = mixing.mix(docs.repartition(3), targets).toPandas().set_index("doc_id")
    assert (again.kept == got.set_index("doc_id").kept[again.index]).all()


def test_both_ways_to_rake_agree(spark, monkeypatch):
    cells = spark.createDataFrame([("a", "x", 0, 10), ("a", "y", 1, 30), ("b", "x", 1, 5), ("b", "y", 0, 50), ("", "y", 0, 0)], "source string, lang string, topic int, n_tokens long")
    targets = {"source": {"a": 0.5, "b": 0.5, "nowhere": 9.0}}
    assert mixing.scale_of(mixing.factors(cells, targets), 0.0) == pytest.approx(1 / max(r.factor for r in mixing.factors(cells, targets).where("n_tokens > 0").collect()))
    scale = mixing.scale_of(mixing.factors(cells, targets), 0.1)
    one = {r[:3]: r.factor for r in mixing.factors(cells, targets).select("source", "lang", "topic", "factor").collect()}
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-3)
    two = {r[:3]: r.factor for r in mixing.factors(cells, targets).select("source", "lang", "topic", "factor").collect()}
    assert mixing.scale_of(mixing.factors(cells, targets), 0.1) == pytest.approx(scale, rel=5e-2)
    assert one.keys() == two.keys() and one[("", "y", 0)] == 1.0
    for k in one:
        assert one[k] == pytest.approx(two[k], rel=2e-2)


def test_both_ways_stop_after_the_same_rounds(spark, monkeypatch):
    # Feasible only in the limit, as the cell (a, y) must vanish.
    cells = spark.createDataFrame([("a", "x", 0, 10), ("a", "y", 0, 30), ("b", "x", 0, 5)], "source string, lang string, topic int, n_tokens long")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.9, "y": 0.1}}
    monkeypatch.setattr(mixing, "ROUNDS", 2)
    monkeypatch.setattr(mixing, "FREE_ROUNDS", 3)
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-12)
    found = []
    for limit in (100, 0):
        monkeypatch.setattr(mixing, "DRIVER_CELLS", limit)
        found.append({(r.source, r.lang): r.factor for r in mixing.factors(cells, targets).collect()})
    assert found[0] == pytest.approx(found[1], rel=1e-9)


def test_rake_equals_hand_computed():
    w = mixing.rake(np.array([0.25, 0.25, 0.25, 0.25]), [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])], [np.array([0.8, 0.2]), np.array([0.5, 0.5])])
    assert np.allclose(w, [0.4, 0.4, 0.1, 0.1])


def test_nulls_empty_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, topic string, factor int"
    rows = [(None, None, None, None, "t", 1), (1, "", "en", "s", "t", 1), (2, "some words here", "en", "s", "t", 1), (2, "some words here", "en", "s", "t", 1), (3, "é " * 10000, "fr", None, None, None)]
    got = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 0), (1, 0), (2, 3), (2, 3), (3, 10000)]
    assert len({r.kept for r in got if r.doc_id == 2}) == 1
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []


def test_feasible_targets_are_met_beyond_the_bound(spark, monkeypatch):
    rows = [("big", "x", 0, 90_000), ("big", "y", 1, 109_000), ("small", "x", 0, 600), ("small", "y", 1, 400), ("none", "y", 1, 50)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic int, n_tokens long")
    targets = {"source": {"big": 0.9, "small": 0.1, "none": 0.0}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"0": 0.5, "1": 0.5}}
    for limit in (mixing.DRIVER_CELLS, 0):
        monkeypatch.setattr(mixing, "DRIVER_CELLS", limit)
        got = mixing.factors(cells, targets).toPandas()
        w = got.n_tokens * got.factor / 200_050
        assert w[got.source == "small"].sum() == pytest.approx(0.1, rel=1e-4) and w[got.lang == "x"].sum() == pytest.approx(0.5, rel=1e-4)
        assert w[got.source == "none"].sum() == 0 and 0 < mixing.scale_of(mixing.factors(cells, targets)) < 10


def test_contradictions_are_bounded_and_logged(caplog):
    # The third cell alone holds the second value of both marginals, whose targets differ.
    w = mixing.rake(np.array([0.5, 0.3, 0.2]), [np.array([0, 0, 1]), np.array([0, 0, 1])], [np.array([0.9, 0.1]), np.array([0.5, 0.5])])
    assert np.isfinite(w).all() and "raking ends" in caplog.text


def test_all_documents_teach_means_and_centroids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SAMPLE", 5)
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 3} more", "rare" if i in (50, 150) else "en", "s") for i in range(300)], "doc_id long, text string, lang string, source string")
    rows = mixing.counted(docs).persist()
    rarity = mixing.bucket_rarity(rows)
    topics = mixing.learn_topics(rows, rarity)
    table = rows.toArrow().combine_chunks().to_batches()
    vectors = np.concatenate([v for _, v in mixing.features(table, rarity)])
    langs = np.array(table[0].column("lang").to_pylist())
    for x in ("rare", "en"):
        assert np.allclose(topics.means[x], vectors[langs == x].mean(axis=0), atol=1e-8)
    assert np.allclose(topics.means[""], vectors.mean(axis=0), atol=1e-8)
    rest = topics.residuals(vectors, langs.tolist())
    near = (rest @ topics.centres.T).argmax(axis=1)
    for k in set(near.tolist()):
        mean = rest[near == k].sum(axis=0)
        assert np.allclose(topics.centres[k], mean / np.linalg.norm(mean), atol=1e-6)
