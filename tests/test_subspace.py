"""Leading directions against a dense decomposition."""

import numpy as np
import pytest

from omiclattice.operators import latent
from omiclattice.operators.subspace import leading_directions


def vecs(spark, x):
    return spark.createDataFrame([(f"f{i:04d}", [float(t) for t in r]) for i, r in enumerate(x)], "feature_id string, vec array<double>").repartition(3)


@pytest.mark.parametrize(("features", "samples", "kind"), [(200, 40, "noise"), (12, 90, "few features"), (30, 2500, "many samples"), (50, 30, "decay")])
def test_directions_match_svd(spark, features, samples, kind):
    rng = np.random.default_rng(samples)
    x = rng.normal(size=(features, samples))
    if kind == "decay":
        u, _, v = np.linalg.svd(x, full_matrices=False)
        x = (u * 0.5 ** np.arange(30)) @ v
    found, values, total = leading_directions(vecs(spark, x), 3)
    u = np.array([r.u for r in found.orderBy("i").collect()])
    c = x - x.mean(axis=1, keepdims=True)
    _, s, v = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(values, s[:3] ** 2, rtol=1e-9) and np.isclose(total, (s**2).sum())
    want = v[:3].T
    want = want * np.sign(want[np.abs(want).argmax(0), np.arange(3)])
    assert np.allclose(u, want, atol=1e-7)


def test_fewer_directions_than_asked_for(spark):
    a = np.array([1.0, -1, 2, -2, 0])
    found, values, _ = leading_directions(vecs(spark, [a, 3 * a, a + 5]), 3)
    assert len(values) == 1 and np.isclose(values[0], 11 * 10) and all(len(r.u) == 1 for r in found.collect())
    constant = vecs(spark, np.ones((4, 5)))
    assert leading_directions(constant, 2)[1] == [] and latent.batch_score(constant).first()[0] == 0.0
    assert latent.pca_table(constant, list("abcde"), 2).count() == 0
