import numpy as np
import pytest

from weirgate.llm import queries as Q
from weirgate.llm import whitening as W

SF = "/root/testdata/sf0.01"
FLAT = "vec_id long, embedding array<float>"


def brute(vectors, k=32):
    """All rows at once, in extended precision; eigenvectors in double, good where eigenvalues lie apart."""
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    z = (n * x - s).astype(object)
    c = (n * x - s).astype(np.longdouble) / n
    cov = c.T @ c / n
    value, vector = np.linalg.eigh(cov.astype(np.float64))
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    return n, (z * z).sum(axis=1).tolist(), np.asarray(c, np.float64) @ vector / np.sqrt(value), value / np.trace(cov).astype(float)


def as_matrix(rows, k):
    out = sorted(rows, key=lambda r: (r.vec_id, r.component))
    return np.array([r.whitened for r in out]).reshape(-1, k), out


def test_query_against_brute_force(spark):
    have = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect() if r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding)]
    n, deviation, whitened, explained = brute([r.embedding for r in have])
    got, rows = as_matrix(Q.op13_whitening(spark, SF).collect(), 32)
    signs = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got * signs - whitened).max() < 1e-8
    assert [r.deviation for r in rows[::32]] == deviation and {r.n for r in rows} == {n} and [r.vec_id for r in rows[::32]] == [r.vec_id for r in have]
    assert np.allclose([r.explained for r in rows[:32]], explained, rtol=1e-10)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    assert np.abs(got.T @ got / n - np.eye(32)).max() < 1e-9


def orthogonal(n, seed):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0].astype(np.longdouble)
    for _ in range(4):  # orthogonal to extended precision
        q = q @ (1.5 * np.eye(n) - q.T @ q / 2)
    return q


@pytest.mark.parametrize("values", [
    np.geomspace(1, 1e-6, 24), np.linspace(3, 1, 24), [5] * 3 + [1 + 1e-9 * i for i in range(10)] + [0.5] * 11,
    [2 + 1e-13 * i for i in range(24)], [1] * 24, [1e6, 1e6 * (1 + 1e-7)] + [1e-3] * 22, [1.0, 0.5] + [0.0] * 22, [1 + 1e-5 * i for i in range(24)],
])
def test_refinement_reaches_extended_precision(values):
    """Matrices of known eigenvectors; single vectors are compared where their gap tells them apart, spans elsewhere."""
    values = np.sort(np.array(values, np.longdouble))[::-1]
    n = len(values)
    q = orthogonal(n, 7)
    a = q * values @ q.T
    a = (a + a.T) / 2
    got, x = W.refined_eigen(a)
    assert np.abs(got - values).max() <= 1e-17 * values[0]
    assert np.abs(x.T @ x - np.eye(n)).max() < 1e-15
    assert np.abs(a @ x - x * got).max() < 1e-16 * values[0]
    gap = np.array([np.abs(np.delete(values, i) - values[i]).min() for i in range(n)])
    for i in np.flatnonzero(gap > 1e-10 * values[0]):
        assert 1 - abs(float(x[:, i] @ q[:, i])) < 1e-16 + (1e-18 * float(values[0] / gap[i])) ** 2 * 100


@pytest.mark.parametrize("values", [[1] * 24, [3] * 12 + [1] * 12, [2 + 1e-13 * i for i in range(24)]])
def test_vectors_of_clusters_are_orthonormal_in_extended_precision(values):
    """Not in doubles only, whatever the last round has turned within a cluster."""
    for seed in range(20):
        q = orthogonal(24, seed)
        a = q * np.sort(np.array(values, np.longdouble))[::-1] @ q.T
        x = W.refined_eigen((a + a.T) / 2)[1]
        assert np.abs(x.T @ x - np.eye(24)).max() < 1e-17


def test_float32_alone_would_not_do():
    values = [2 + 1e-9 * i for i in range(12)]
    q = orthogonal(12, 3)
    a = q * np.array(values, np.longdouble) @ q.T
    x = W.refined_eigen(a)[1]
    assert np.abs(np.abs((x.T @ q)[::1, ::-1]) - np.eye(12)).max() < 1e-8
    rough = np.linalg.eigh(a.astype(np.float32))[1]
    assert np.abs(np.abs(rough.T @ q.astype(float)) - np.eye(12)).max() > 1e-2


def test_what_is_dropped_and_what_is_kept(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=3).tolist()) for i in range(40)] + [(None, [1.0, 2.0, 3.0]), (5, [0.5, 0.5, 0.5]), (5, [0.5, 0.5, 0.5])]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, float("nan"), 2.0]), (94, [1.0, float("inf"), 0.0]), (95, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "c") for r in good + bad], FLAT + ", component string").repartition(5)
    rows = W.whiten(df).collect()
    assert len(rows) == 43 * 3 and {r.n for r in rows} == {43} and {r.component for r in rows} == {1, 2, 3}
    assert sorted(str(r.vec_id) for r in rows if r.component == 1) == sorted(str(i) for i, _ in good)
    single = np.array([np.float32(v) for _, v in good], np.float32).astype(float)
    assert sorted(r.deviation for r in rows if r.component == 1) == sorted(brute(single, 3)[1])
    assert rows[0].identity_error < 1e-9 and abs(sum(r.explained for r in rows[:3]) - 1) < 1e-9


def test_no_variance_no_component(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, None)]):
        assert W.whiten(spark.createDataFrame(rows, FLAT)).collect() == []
    flat = W.whiten(spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(50)], FLAT)).collect()
    assert {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1)


def test_large_entries_keep_exact_deviations(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [2.0, 5e8])]
    got = {r.vec_id: r.deviation for r in W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    want = [sum((3 * c - t) ** 2 for c, t in zip(v, s)) for v in x]
    assert got == {i + 1: w if w < 2**63 else None for i, w in enumerate(want)}


def test_result_does_not_depend_on_the_partitions(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    one, many = W.fit(W._named(df.coalesce(1), "vec_id", "embedding")), W.fit(W._named(df.repartition(13), "vec_id", "embedding"))
    assert np.array_equal(one.vectors, many.vectors) and np.array_equal(one.values, many.values)
