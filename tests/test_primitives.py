import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from omiclattice.functions import ranks, tails


@pytest.fixture(scope="module")
def skewed(spark):
    # one group holds most rows and one value a third of them
    rng = np.random.default_rng(0)
    g = np.where(rng.random(3000) < 0.7, "hot", rng.choice(["a", "b"], 3000))
    v = np.where(rng.random(3000) < 0.33, 5.0, rng.integers(0, 400, 3000) / 7.0)
    return spark.createDataFrame(pd.DataFrame({"g": g, "v": v}))


@pytest.mark.parametrize("buckets", [None, 8])
def test_counts_match_sorted_positions(skewed, buckets):
    got = ranks.cumulative_counts(skewed, ["g"], "v", buckets).toPandas()
    for g, part in skewed.toPandas().groupby("g"):
        mine = got[got.g == g]
        for _, r in mine.iterrows():
            assert r.below == (part.v < r.v).sum() and r.cnt == (part.v == r.v).sum() and r.total == len(part)


def test_ranks_and_quantiles(skewed):
    pdf = ranks.average_ranks(skewed, ["g"], "v").toPandas()
    assert np.allclose(pdf.rnk, pdf.groupby("g").v.rank())
    q = ranks.exact_quantile(skewed, ["g"], "v", 0.37).toPandas().set_index("g")["quantile"]
    want = skewed.toPandas().groupby("g").v.quantile(0.37)
    assert np.allclose(q.sort_index(), want.sort_index())


def _bh(p):
    p = np.asarray(p)
    order = np.argsort(p)
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.minimum(q, 1)
    return out


@pytest.mark.parametrize("buckets", [None, 16])
def test_benjamini_hochberg(spark, buckets):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.random(500), rng.random(200) ** 6, np.full(250, 1.0)])
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(p)), "p": p}))
    got = ranks.benjamini_hochberg(df, "p", buckets=buckets).toPandas().sort_values("id")
    assert np.allclose(got.q_value, _bh(p), atol=1e-12)


def test_bh_hand_checked(spark):
    df = spark.createDataFrame([(0.01,), (0.03,), (0.04,), (0.5,)], "p double")
    q = [round(r.q_value, 6) for r in ranks.benjamini_hochberg(df, "p").orderBy("p").collect()]
    assert q == [0.04, 0.053333, 0.053333, 0.5]


def test_bh_on_kept_small_p_equals_full(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.random(2000), rng.random(60) * 1e-4])
    full = _bh(p)
    kept = p <= 0.05
    df = spark.createDataFrame(pd.DataFrame({"p": p[kept], "want": full[kept]}))
    got = ranks.benjamini_hochberg(df, "p", n_tests=F.lit(len(p))).toPandas()
    sig = got.want < 0.05
    assert sig.sum() > 20 and np.allclose(got.q_value[sig], got.want[sig])
    assert (got.q_value[~sig] >= 0.05).all()


def test_known_tails():
    f = tails.betainc(10 / 2, 4 / 2, 10 / (10 + 4 * 3.478))
    assert abs(float(f) - 0.050) < 1e-4
    assert abs(float(tails.gammaincc(0.5, 3.841458820694124 / 2)) - 0.05) < 1e-9
    assert abs(float(tails.betainc(2.5, 0.5, 5 / (5 + 2.570581836**2))) - 0.05) < 1e-8
    assert tails.hypergeom_tail(5, 10, 20, 1000) < 0.001
    assert tails.hypergeom_tail(1, 100, 20, 1000) > 0.05
    assert tails.hypergeom_tail(0, 10, 20, 1000) == 1.0
    assert tails.hypergeom_tail(10, 10, 20, 1000) < 1e-10


def test_even_forms_agree(spark):
    df = spark.createDataFrame([(float(x), k) for x in (0.5, 3.0, 40.0) for k in (1, 2, 5)], "x double, k int")
    d = df.select(
        tails.chi2_tail("x", (F.col("k") * 2).cast("double")).alias("a"), tails.chi2_tail_even(F.col("x"), F.col("k")).alias("b"),
        tails.f_tail("x", F.lit(4.0), F.lit(11.0)).alias("c"), tails.f_tail_even(F.col("x"), 4, F.lit(11.0)).alias("d"),
    ).toPandas()
    assert np.allclose(d.a, d.b, rtol=1e-9) and np.allclose(d.c, d.d, rtol=1e-9)
