import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from omiclattice.operators import corr, latent, network


def vecs(spark, x, prefix="f"):
    return spark.createDataFrame([(f"{prefix}{i:02d}", [float(t) for t in r]) for i, r in enumerate(x)], "feature_id string, vec array<double>")


def blocks(rng, n=3, size=8, samples=14):
    base = rng.normal(size=(n, samples))
    return np.vstack([base[i] + 0.35 * rng.normal(size=(size, samples)) for i in range(n)])


def test_overlap_matches_dense(spark):
    rng = np.random.default_rng(0)
    x = blocks(rng)
    unit = corr.unit_vectors(vecs(spark, x))
    a = np.abs(0.5 * (1 + np.corrcoef(x))) ** 3
    np.fill_diagonal(a, 0)
    k = a.sum(axis=1)
    want = (a @ a + a) / (np.minimum.outer(k, k) + 1 - a)
    got = network.tom_edges(unit, 3, 0.0, size=7).collect()
    assert len(got) == 24 * 23 // 2
    for r in got:
        i, j = int(r.src[1:]), int(r.dst[1:])
        assert r.src < r.dst and abs(r.weight - want[i, j]) < 1e-9 and 0 <= r.weight <= 1


def _brute_heights(sim):
    groups = [[i] for i in range(len(sim))]
    out = []
    while len(groups) > 1:
        best = max(itertools.combinations(range(len(groups)), 2), key=lambda p: np.mean([sim[a, b] for a in groups[p[0]] for b in groups[p[1]]]))
        out.append(1 - np.mean([sim[a, b] for a in groups[best[0]] for b in groups[best[1]]]))
        groups = [g for t, g in enumerate(groups) if t not in best] + [groups[best[0]] + groups[best[1]]]
    return sorted(out)


@pytest.mark.parametrize("local_limit", [1000, 3])
def test_average_linkage_is_exact(spark, local_limit):
    rng = np.random.default_rng(1)
    s = rng.random((13, 13))
    s = (s + s.T) / 2
    e = spark.createDataFrame([(f"n{i:02d}", f"n{j:02d}", float(s[i, j])) for i in range(13) for j in range(i + 1, 13)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(13)], "feature_id string")
    m = network.average_linkage(e, nodes, local_limit=local_limit).toPandas()
    assert len(m) == 12 and np.allclose(sorted(m.height), _brute_heights(s), atol=1e-9)


def test_modules_find_planted_blocks(spark):
    x = blocks(np.random.default_rng(2), n=3, size=12, samples=20)
    unit = corr.unit_vectors(vecs(spark, x))
    mod = {r.feature_id: r.module for r in network.tom_modules(unit, 6, min_size=5, deep_split=0).collect()}
    for b in range(3):
        assert len({mod[f"f{i:02d}"] for i in range(b * 12, b * 12 + 12)}) == 1


def test_eigengene_matches_svd(spark):
    x = blocks(np.random.default_rng(3))
    v = vecs(spark, x)
    lab = spark.createDataFrame([(f"f{i:02d}", 1 + i // 8) for i in range(24)], "feature_id string, module int")
    for r in network.eigengenes(v, lab).collect():
        m = x[(r.module - 1) * 8:r.module * 8]
        c = m - m.mean(axis=1, keepdims=True)
        pc = np.linalg.svd(c, full_matrices=False)[2][0]
        pc = pc if np.mean([np.corrcoef(pc, row)[0, 1] for row in c]) >= 0 else -pc
        assert np.allclose(r.vec, pc, atol=1e-8)


def _random_graph(spark, n=14, p=0.25, seed=4):
    rng = np.random.default_rng(seed)
    e = [(f"n{i:02d}", f"n{j:02d}", float(rng.integers(1, 5))) for i in range(n) for j in range(i + 1, n) if rng.random() < p]
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(n)], "feature_id string")
    return e, spark.createDataFrame(e, "src string, dst string, weight double"), nodes


def _brute_betweenness(e, ids):
    n = len(ids)
    at = {v: i for i, v in enumerate(ids)}
    w = np.full((n, n), np.inf)
    for a, b, c in e:
        w[at[a], at[b]] = w[at[b], at[a]] = c
    d = w.copy()
    np.fill_diagonal(d, 0)
    for k in range(n):
        d = np.minimum(d, d[:, [k]] + d[[k], :])
    sig = np.zeros((n, n))
    for s in range(n):
        sig[s, s] = 1
        for t in sorted(range(n), key=lambda t: d[s, t]):
            if t != s and np.isfinite(d[s, t]):
                sig[s, t] = sum(sig[s, u] for u in range(n) if np.isfinite(w[u, t]) and abs(d[s, u] + w[u, t] - d[s, t]) < 1e-9)
    out = {}
    for v in range(n):
        tot = 0.0
        for s in range(n):
            for t in range(n):
                if v not in (s, t) and s != t and np.isfinite(d[s, t]) and abs(d[s, v] + d[v, t] - d[s, t]) < 1e-9:
                    tot += sig[s, v] * sig[v, t] / sig[s, t]
        out[ids[v]] = tot / ((n - 1) * (n - 2))
    return out


def test_betweenness_matches_brute_force(spark):
    e, edges, nodes = _random_graph(spark)
    got = {r.feature_id: r.betweenness for r in network.betweenness(edges, nodes).collect()}
    want = _brute_betweenness(e, sorted(got))
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_components_on_a_long_chain(spark):
    e = [(f"c{i:03d}", f"c{i + 1:03d}", 1.0) for i in range(60)] + [("z1", "z2", 1.0)]
    edges = spark.createDataFrame(e, "src string, dst string, weight double")
    nodes = spark.createDataFrame([(f"c{i:03d}",) for i in range(61)] + [("z1",), ("z2",), ("solo",)], "feature_id string")
    got = {r.feature_id: r.component for r in network.components(edges, nodes).collect()}
    assert {got[f"c{i:03d}"] for i in range(61)} == {"c000"} and got["z2"] == "z1" and got["solo"] == "solo"


def test_communities_split_two_cliques(spark):
    cl = lambda p: [(f"{p}{i}", f"{p}{j}", 1.0) for i in range(5) for j in range(i + 1, 5)]
    edges = spark.createDataFrame(cl("a") + cl("b") + [("a0", "b0", 0.1)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(f"{p}{i}",) for p in "ab" for i in range(5)], "feature_id string")
    got = {r.feature_id: r.community for r in network.label_communities(edges, nodes).collect()}
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and got["a1"] != got["b1"]


def test_pca_matches_svd(spark):
    x = np.random.default_rng(7).normal(size=(40, 9))
    found, ratio = latent.pca_samples(vecs(spark, x), 3)
    scores = np.array([r.scores for r in found.orderBy("i").collect()])
    c = (x - x.mean(axis=1, keepdims=True)).T
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs(scores), np.abs(u[:, :3] * s[:3]), atol=1e-8)
    assert np.allclose(ratio, (s**2 / (s**2).sum())[:3])


def _nipals(x, y, k):
    x, y = x.copy(), y.copy()
    out = []
    for _ in range(k):
        u = y[:, [np.argmax((y**2).sum(axis=0))]]
        for _ in range(2000):
            w = x.T @ u
            w /= np.linalg.norm(w)
            t = x @ w
            q = y.T @ t / (t.T @ t)
            new = y @ q / (q.T @ q)
            if np.linalg.norm(new - u) < 1e-13:
                break
            u = new
        p = x.T @ t / (t.T @ t)
        x, y = x - t @ p.T, y - t @ (y.T @ t / (t.T @ t)).T
        out.append((w[:, 0], t[:, 0], p[:, 0]))
    return out


def test_joint_pls_matches_nipals(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(size=(16, 2))
    x = z @ rng.normal(size=(2, 12)) + 0.3 * rng.normal(size=(16, 12))
    y = z @ rng.normal(size=(2, 5)) + 0.3 * rng.normal(size=(16, 5))
    res = latent.joint_pls(vecs(spark, x.T), vecs(spark, y.T, "m"), n_joint=2)
    std = lambda m: (m - m.mean(axis=0)) / m.std(axis=0, ddof=1)
    want = _nipals(std(x), std(y), 2)
    got = {r.feature_id: r for r in res["x_variables"].collect()}
    w = np.array([got[f"f{i:02d}"].weights for i in range(12)])
    p = np.array([got[f"f{i:02d}"].loadings for i in range(12)])
    t = np.array([r.scores for r in res["scores"].orderBy("sample_index").collect()])
    for a, (ww, tt, pp) in enumerate(want):
        sign = np.sign(w[:, a] @ ww)
        assert np.allclose(w[:, a] * sign, ww, atol=1e-6) and np.allclose(t[:, a] * sign, tt, atol=1e-5) and np.allclose(p[:, a] * sign, pp, atol=1e-6)
    s = res["summary"].first()
    xs = std(x)
    fit = sum(np.outer(tt, pp) for _, tt, pp in want)
    assert abs(s.x_joint_variance - (1 - ((xs - fit)**2).sum() / (xs**2).sum())) < 1e-6
    ssy = np.array([tt @ tt for _, tt, _ in want])
    vip = np.sqrt(12 * (np.array([ww**2 for ww, _, _ in want]).T @ ssy) / ssy.sum())
    assert np.allclose([got[f"f{i:02d}"].vip for i in range(12)], vip, atol=1e-6)


def test_cross_validation_matches_direct_prediction(spark):
    rng = np.random.default_rng(9)
    z = rng.normal(size=(15, 1))
    x, y = z @ rng.normal(size=(1, 8)) + 0.5 * rng.normal(size=(15, 8)), z @ rng.normal(size=(1, 3)) + 0.5 * rng.normal(size=(15, 3))
    x, y = x - x.mean(axis=0), y - y.mean(axis=0)
    # fold_states sees centred features, whatever their scale
    states = latent.fold_states(vecs(spark, x.T), vecs(spark, y.T, "m"), 3, latent._folds(15, 5, 42))
    quality = latent.component_quality(states).orderBy("n_comp").collect()
    q2, r2 = [r.q2 for r in quality], [r.r2 for r in quality]
    assert states.count() == 18
    press = 0.0
    for test in latent._folds(15, 5, 42):
        train = np.setdiff1d(np.arange(15), test)
        mx, my = x[train].mean(axis=0), y[train].mean(axis=0)
        comps = _nipals(x[train] - mx, y[train] - my, 2)
        w = np.array([c[0] for c in comps]).T
        p = np.array([c[2] for c in comps]).T
        t = np.array([c[1] for c in comps]).T
        beta = w @ np.linalg.inv(p.T @ w) @ np.linalg.inv(t.T @ t) @ t.T @ (y[train] - my)
        press += ((y[test] - my - (x[test] - mx) @ beta)**2).sum()
    assert abs(q2[1] - round(1 - press / (y**2).sum(), 4)) < 2e-4 and r2[1] >= q2[1]


def test_closure_depths(spark):
    t = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c")], "node string, parent string")
    got = {(r.node, r.ancestor): r.depth for r in network.closure(t).collect()}
    assert got == {("b", "a"): 1, ("c", "b"): 1, ("c", "a"): 2, ("d", "c"): 1, ("d", "b"): 2, ("d", "a"): 3}
