"""Results that must not depend on depth, size, repeated cells or line ends."""

import itertools
import math
from decimal import Decimal, getcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from omiclattice.functions import tails
from omiclattice.operators import clean, corr, enrich, network
from omiclattice.sources import matrices, spectra


def exact_tail(k, h):
    """P(chi2 with 2k degrees > 2h), summed with many digits."""
    getcontext().prec = 60
    term = total = Decimal(1)
    for i in range(1, k):
        term = term * Decimal(h) / i
        total += term
    return float(total * (-Decimal(h)).exp())


@pytest.mark.parametrize("k, h", [(1, 0.5), (5, 9.0), (100, 180.0), (600, 590.0), (600, 720.0), (2000, 2050.0), (2000, 1900.0), (100_000, 100_400.0)])
def test_fisher_tail(k, h):
    assert math.isclose(float(np.exp(tails.log_gammaincc(k, h))), exact_tail(k, h), rel_tol=1e-9)


def test_fisher_with_many_p_values(spark):
    p = spark.range(1, 601).select(F.lit(1).alias("k"), (F.col("id") / 1200.0).alias("p"))
    h = -sum(math.log(i / 1200) for i in range(1, 601))
    assert math.isclose(enrich.fisher_combined(p, ["k"], "p").first().p_combined, exact_tail(600, h), rel_tol=1e-6)


def test_closure_of_deep_chain_and_cycle(spark):
    chain = [(i, i + 1) for i in range(24)]
    got = network.closure(spark.createDataFrame(chain + [(100, 101), (101, 100)], "node int, parent int")).collect()
    depth = {(r.node, r.ancestor): r.depth for r in got}
    assert [depth[0, i] for i in range(1, 25)] == list(range(1, 25))
    assert depth[100, 100] == 2 and depth[100, 101] == 1 and len(depth) == 24 * 25 // 2 + 4


def upgma(n, sim):
    """One merge at a time; ties to the smaller ids. Returns the merges."""
    size, alive, out = [1.0] * n, list(range(n)), []
    s = sim.copy()
    while len(alive) > 1:
        d, a, b = min((-s[i, j], i, j) for i, j in itertools.combinations(alive, 2))
        out.append((f"g{a:02d}", f"g{b:02d}", round(1 + d, 9)))
        for k in alive:
            s[a, k] = s[k, a] = (size[a] * s[a, k] + size[b] * s[b, k]) / (size[a] + size[b])
        size[a] += size[b]
        alive.remove(b)
    return out


@pytest.mark.parametrize("ties", [False, True])
def test_linkage_in_one_task_equals_one_at_a_time(ties):
    rng = np.random.default_rng(4)
    for n in range(2, 14):
        sim = rng.integers(0, 4, (n, n)) / 4 if ties else rng.random((n, n))
        sim = np.maximum(sim, sim.T)
        got = network._upgma_local(np.array([f"g{i:02d}" for i in range(n)]), np.ones(n), sim)
        assert [(a, b, round(h, 9)) for a, b, h in got] == upgma(n, sim)


def test_linkage_of_a_path_in_rounds(spark):
    n, w = 6, [0.9, 0.7, 0.8, 0.6, 0.5]
    sim = np.zeros((n, n))
    for i, x in enumerate(w):
        sim[i, i + 1] = sim[i + 1, i] = x
    edges = spark.createDataFrame([(f"g{i:02d}", f"g{i + 1:02d}", x) for i, x in enumerate(w)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(f"g{i:02d}",) for i in range(n)], "feature_id string")
    got = sorted(round(r.height, 9) for r in network.average_linkage(edges, nodes, local_limit=1).collect())
    assert got == sorted(h for _, _, h in upgma(n, sim))


def test_repeated_cells_are_averaged(spark):
    df = spark.createDataFrame([("g1", "s2", 4.0), ("g1", "s1", 1.0), ("g1", "s2", 6.0), ("g2", "s3", None), ("g2", "s1", 2.0), ("g2", "s1", None)], "feature_id string, sample_id string, value double")
    got = {r.feature_id: r.vec for r in clean.to_vectors(df).collect()}
    assert got == {"g1": [1.0, 5.0, None], "g2": [2.0, None, None]}
    some = {r.feature_id: r.vec for r in clean.to_vectors(df, F.array(F.lit("s1"), F.lit("s3"))).collect()}
    assert some == {"g1": [1.0, None], "g2": [2.0, None]}
    assert {(r.feature_id, r.sample_id): r.value for r in clean.densify(df).collect()} == {
        ("g1", "s1"): 1.0, ("g1", "s2"): 5.0, ("g1", "s3"): None, ("g2", "s1"): 2.0, ("g2", "s2"): None, ("g2", "s3"): None}
    assert {(r.feature_id, r.sample_id): r.value for r in clean.impute_mean(df).collect()}[("g1", "s3")] == 3.0


def test_strongest_pairs_of_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(f"g{i:02d}", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(30, 8)))]
    unit = corr.unit_vectors(spark.createDataFrame(rows, "feature_id string, vec array<double>"))
    every = corr.correlated_pairs(unit, size=7).orderBy(F.desc(F.abs("r"))).limit(5).collect()
    top = corr.correlated_pairs(unit, size=7, top=5).orderBy(F.desc(F.abs("r"))).limit(5).collect()
    assert [(r.feature_a, r.feature_b) for r in top] == [(r.feature_a, r.feature_b) for r in every]


@pytest.mark.parametrize("end, blank", [("\n", ""), ("\r\n", ""), ("\n", "  "), ("\r\n", " \t")])
def test_msp_line_ends(spark, tmp_path, end, blank):
    lines = ["Name: one", "PrecursorMZ: 303.05", "Num Peaks: 2", "153.0 10", "137.0 5", blank, "Name: two", "PrecursorMZ: 200.5", "Num Peaks: 1", "77.0 3", ""]
    (tmp_path / "x_pos.msp").write_bytes(end.join(lines).encode())
    got = {r.scan_id: (r.polarity, [f.mz for f in r.fragments]) for r in spectra.load_spectra(spark, str(tmp_path), "msp").collect()}
    assert got == {"one": ("positive", [153.0, 137.0]), "two": ("positive", [77.0])}


def test_chinese_matrix_is_read(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes(("基因,样本1,样本2\n" + "".join(f"醇{i},{i},1\n" for i in range(6))).encode("gb18030"))
    (tmp_path / "u.csv").write_bytes(("基因,样本1,样本2\n" + "".join(f"酮{i},{i},1\n" for i in range(6))).encode("utf-8"))
    got = {(r.feature_id, r.sample_id): r.value for r in matrices.read_expression(spark, str(tmp_path)).collect()}
    assert got[("醇3", "样本1")] == got[("酮3", "样本1")] == 3.0 and len(got) == 24
