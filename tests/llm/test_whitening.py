import numpy as np
import pytest

from lodestone.llm.whitening import deviations, inertia, leading_components, whitened


def test_components_of_many_spectra():
    rng = np.random.default_rng(1)
    for trial in range(150):
        d = int(rng.integers(1, 40))
        m = rng.standard_normal((d, int(rng.integers(1, 60))))
        a = m @ m.T
        if trial % 3 == 1:  # repeated eigenvalues
            q = np.linalg.qr(rng.standard_normal((d, d)))[0]
            a = q @ np.diag(np.round(rng.random(d) * 3)) @ q.T
            a = (a + a.T) / 2
        if trial % 3 == 2:
            a = np.diag(np.round(rng.random(d) * 3))
        want = np.linalg.eigvalsh(a)
        shift = rng.random() * want.max()
        if np.abs(want - shift).min() > 1e-9:
            assert inertia(a, shift) == (want < shift).sum()
        values, vectors = leading_components(a, 32)
        want = want[::-1][:32]
        want = want[want > 1e-10 * max(want.max(), 1e-300)]
        assert np.allclose(values[: len(want)], want, rtol=1e-10)
        assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-9
        assert np.abs(a @ vectors.T - vectors.T * values).max() <= 1e-8 * max(want.max(initial=0), 1e-300)


def test_whitened_matches_dense_solution(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 40)) @ rng.standard_normal((40, 40))
    vectors = [v.tolist() for v in base] + [base[0].tolist()] * 100
    bad = [None, [], [1.0] * 39, [None] + [1.0] * 39, [float("nan")] + [1.0] * 39, [float("inf")] + [1.0] * 39]
    rows = [(i, v, i) for i, v in enumerate(vectors + bad)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long")
    got = whitened(frame).toPandas()
    assert len(got) == 400 * 32 and set(got.n) == {400}
    x = np.floor(64 * np.array(vectors)).astype(int) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    z = x - sums / n
    values, turn = np.linalg.eigh(z.T @ z / n)
    values, turn = values[::-1], turn[:, ::-1]
    want = z @ turn[:, :32] / np.sqrt(values[:32])
    made = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(made - want * np.sign((made * want).sum(axis=0))).max() < 1e-8
    one = got.drop_duplicates("component").sort_values("component")
    assert np.allclose(one.explained, values[:32] / values.sum(), rtol=1e-10)
    assert got.identity_error.max() < 1e-9
    deviation = got.drop_duplicates("vec_id").sort_values("vec_id").deviation
    assert deviation.tolist() == ((n * x - sums) ** 2).sum(axis=1).tolist()


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]] * 3])
def test_no_variance_gives_no_components(spark, vectors):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    assert whitened(frame).count() == 0


def test_deviation_beyond_64_bits_is_null():
    y = np.array([[1 << 40, 3], [2, 3]])
    assert deviations(y, 10, [0, 0]) == [None, 400 + 900]
