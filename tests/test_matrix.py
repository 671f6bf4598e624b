import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from omiclattice.operators import align, clean, corr, enrich, stats


def long(spark, rows):
    return spark.createDataFrame(rows, "feature_id string, sample_id string, value double")


def wide(spark, mat, samples=None, prefix="G"):
    samples = samples or [f"S{j}" for j in range(mat.shape[1])]
    return long(spark, [(f"{prefix}{i}", s, float(v)) for i, row in enumerate(mat) for s, v in zip(samples, row)])


def test_size_factor_ratio_is_two(spark):
    d = long(spark, [("g1", "S1", 100.0), ("g1", "S2", 200.0), ("g2", "S1", 50.0), ("g2", "S2", 100.0),
                     ("g3", "S1", 80.0), ("g3", "S2", 160.0), ("g4", "S1", 0.0), ("g4", "S2", 9.0)])
    f = {r.sample_id: r.size_factor for r in clean.size_factors(d).collect()}
    assert abs(f["S2"] / f["S1"] - 2.0) < 1e-9


def test_moderated_t_known_answers(spark):
    a, b = [1.0, 1.2, 1.1, 0.9, 1.3], [5.0, 5.2, 4.8, 5.1, 5.3]
    same = [1.0, 1.1, 0.9, 1.05, 0.95]
    rows = []
    for name, x, y in (("far", a, b), ("near", same, [v + 0.01 for v in same])):
        rows.append((name, 5, 5, float(np.mean(x)), float(np.mean(y)), float(np.var(x, ddof=1)), float(np.var(y, ddof=1))))
    df = spark.createDataFrame(rows, "feature_id string, n_a int, n_b int, mean_a double, mean_b double, var_a double, var_b double")
    r = {x.feature_id: x for x in stats.moderated_t(df, F.lit(0.1)).collect()}
    assert r["far"].p_value < 0.001 and abs(r["far"].t_stat) > 5
    assert r["near"].p_value > 0.5


def test_missing_stays_missing(spark):
    d = long(spark, [("g", "a", None), ("g", "b", 3.0)])
    got = {r.sample_id: r.value for r in clean.log2_transform(d).collect()}
    assert got == {"a": None, "b": 2.0}
    texts = spark.createDataFrame([(t,) for t in ("1.5", " NA ", "-", "inf", "-inf", "x", "", "nan", "None")], "t string")
    assert [r[0] for r in texts.select(clean.parse_number(F.col("t"))).collect()] == [1.5] + [None] * 8


def test_names_groups_tissues(spark):
    s = spark.createDataFrame([("Leaf_1",), ("Leaf_2",), ("Root-1",), ("Root-2",), ("odd",)], "sample_id string")
    got = {r.sample_id: r.grp for r in align.infer_groups(s).collect()}
    assert got == {"Leaf_1": "Leaf", "Leaf_2": "Leaf", "Root-1": "Root", "Root-2": "Root", "odd": "other"}
    few = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    assert {r.grp for r in align.infer_groups(few).collect()} == {"all"}
    t = s.select("sample_id", align.tissue_of(F.col("sample_id")).alias("t"))
    assert {r.t for r in t.collect()} == {"leaf", "root", "unknown"}
    k = spark.createDataFrame([(" A - b..C_ ",)], "s string").select(align.sample_key(F.col("s"))).first()[0]
    assert k == "a_b_c"


def test_quadrants(spark):
    q = spark.createDataFrame([(2.0, 1.5), (-2.0, 1.5), (0.5, 0.3), (2.0, -0.3)], "g double, m double").select(
        stats.quadrant(F.col("g"), F.col("m")).alias("a"), stats.quadrant(F.col("g"), F.col("m"), 1.0).alias("b")
    ).collect()
    assert (q[0].a, q[1].a, q[2].b, q[3].b) == ("Q1", "Q2", "Q9", "Q5")


def test_shuffled_groups_find_little(spark):
    rng = np.random.default_rng(5)
    d = wide(spark, rng.normal(8, 1, (200, 12)))
    g = spark.createDataFrame([(f"S{j}", "x" if j % 2 else "y") for j in range(12)], "sample_id string, grp string")
    res = stats.deg_multigroup(d, g).toPandas()
    assert (res.q_value >= res.p_value - 1e-12).all() and res.is_fdr_sig.sum() <= 2


def test_correlation_blocks_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(23, 15))
    v = spark.createDataFrame([(f"f{i:02d}", [float(t) for t in r]) for i, r in enumerate(x)], "feature_id string, vec array<double>")
    for method, want in (("pearson", np.corrcoef(x)), ("spearman", pd.DataFrame(x.T).corr("spearman").to_numpy())):
        got = corr.correlated_pairs(corr.unit_vectors(v, method), size=6).collect()
        assert len(got) == 23 * 22 // 2
        for r in got:
            i, j = int(r.feature_a[1:]), int(r.feature_b[1:])
            assert abs(r.r - want[i, j]) < 1e-9
    a, b = v.where("feature_id < 'f09'"), v.where("feature_id >= 'f09'")
    cross = corr.correlated_pairs(corr.unit_vectors(a), corr.unit_vectors(b), size=4).collect()
    assert len(cross) == 9 * 14
    screen = corr.correlation_screen(corr.unit_vectors(v), min_abs_r=0.0, alpha=0.9, size=6).toPandas()
    assert (screen.q_value < 0.9).all()


def test_pairwise_spearman_with_gaps(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 6, (5, 9)).astype(float), rng.integers(0, 6, (4, 9)).astype(float)
    x[rng.random(x.shape) < 0.2] = np.nan
    y[rng.random(y.shape) < 0.2] = np.nan
    mk = lambda m, p: spark.createDataFrame([(f"{p}{i}", [None if np.isnan(t) else float(t) for t in r]) for i, r in enumerate(m)], "feature_id string, vec array<double>")
    got = {(r.feature_a, r.feature_b): r.r for r in corr.spearman_pairwise(mk(x, "a"), mk(y, "b"), 0.0, size=2).collect()}
    for i in range(5):
        for j in range(4):
            ok = ~np.isnan(x[i]) & ~np.isnan(y[j])
            want = pd.Series(x[i][ok]).rank().corr(pd.Series(y[j][ok]).rank())
            if ok.sum() >= 3 and not np.isnan(want):
                assert abs(got[(f"a{i}", f"b{j}")] - want) < 1e-9


def test_partial_correlation_removes_batch(spark):
    rng = np.random.default_rng(6)
    batch = np.repeat([0.0, 1.0], 10)
    v = spark.createDataFrame([(f"f{i}", [float(t) for t in rng.normal(size=20) + 9 * batch]) for i in range(4)], "feature_id string, vec array<double>")
    raw = corr.correlated_pairs(corr.unit_vectors(v)).agg(F.min("r")).first()[0]
    left = corr.correlated_pairs(corr.unit_vectors(corr.residual_vectors(v, batch[:, None])), lost_df=1).agg(F.max(F.abs("r"))).first()[0]
    assert raw > 0.9 and left < 0.8


def test_fisher_and_gene_match(spark):
    p = spark.createDataFrame([("a", .01), ("a", .01), ("b", .5), ("b", .5), ("c", .03), ("d", 0.0)], "k string, p double")
    got = {r.k: r.p_combined for r in enrich.fisher_combined(p, ["k"], "p").collect()}
    assert got["a"] < 0.01 and got["b"] > 0.05 and 0.02 < got["c"] < 0.05 and got["d"] == 1.0
    names = spark.createDataFrame([("CHS",), ("pal",)], "name string")
    ids = spark.createDataFrame([("AT5G13930_CHS",), ("AT2G37040_PAL",), ("AT1G01010",)], "feature_id string")
    assert {(r.name, r.feature_id) for r in enrich.match_gene_names(names, ids).collect()} == {("CHS", "AT5G13930_CHS"), ("pal", "AT2G37040_PAL")}


def test_spearman_blocks_equal_ranks_redone_per_pair():
    rng = np.random.default_rng(3)
    for hole_a, hole_b in ((0.3, 0.0), (0.0, 0.3), (0.3, 0.3)):
        x, y = (np.where(rng.random((n, 9)) < hole, np.nan, rng.integers(0, 6, (n, 9)).astype(float)) for n, hole in ((7, hole_a), (8, hole_b)))
        r, n = corr._spearman_block(x, y)
        for i, j in np.ndindex(*r.shape):
            ok = ~np.isnan(x[i]) & ~np.isnan(y[j])
            u, v = pd.Series(x[i, ok]).rank(), pd.Series(y[j, ok]).rank()
            want = u.corr(v) if ok.sum() > 1 and u.nunique() > 1 and v.nunique() > 1 else 0.0
            assert n[i, j] == ok.sum() and abs(r[i, j] - want) < 1e-12


def test_spearman_hits_keep_all_that_reach_the_cut():
    """Ties, infinite values and missing samples on both sides; and no more work than half the pairs of samples."""
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 9, (40, 10)).astype(float), rng.integers(0, 5, (30, 10)).astype(float)
    x[rng.random(x.shape) < 0.3] = np.nan
    y[rng.random(y.shape) < 0.1] = np.nan
    y[0, :2] = np.inf
    want = {}
    for i, u in enumerate(x):
        for j, v in enumerate(y):
            ok = ~np.isnan(u) & ~np.isnan(v)
            ru, rv = pd.Series(u[ok]).rank(), pd.Series(v[ok]).rank()
            if ok.sum() >= 3 and ru.std() > 0 and rv.std() > 0 and abs(c := ru.corr(rv)) >= 0.5 - 1e-12:
                want[i, j] = c, ok.sum()
    got = {(i, j): (r, n) for part in corr._spearman_hits(x, y, 0.5, 3) for i, j, r, n in zip(*(z.tolist() for z in part))}
    assert got.keys() == want.keys() and len(want) > 50
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
